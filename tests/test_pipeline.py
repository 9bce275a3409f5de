"""The whole detection in tiny chunks against plain loops over whole recordings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutspark.operators import access, bouts, summary
from boutspark.operators import detect as detection
from boutspark.operators.baseline import running_median, subtract_baseline, thresholds
from boutspark.operators.detect import detect
from boutspark.params import REC, Params
from boutspark.plans.experiment import load_window
from tests.test_runs import loop_link, loop_runs

CHUNK = 7
SHARED = Params(
    feeding_threshold=30.0,
    feeding_minimum=10.0,
    tasting_minimum=2.0,
    tasting_maximum=9.0,
    feeding_minevents=2,
    tasting_minevents=2,
    feeding_event_link_gap=3,
    samples_per_second=1.0,
)


def make_signals(seed=11):
    rng = np.random.default_rng(seed)
    out = {}
    for dfm in (1, 2):
        n = int(rng.integers(40, 120))
        for well in range(1, 13):
            x = rng.normal(0, 6, n)
            for start in rng.integers(0, n, 6):
                x[start : start + int(rng.integers(1, 25))] += rng.choice([15.0, 40.0])
            out[dfm, well] = np.round(x, 2)
    return out


SIGNALS = make_signals()


def to_frame(spark, signals=SIGNALS, shuffled=False):
    rows = [
        ("p", dfm, well, i, i + 1, float(i), float(v), int(i % 9 < 4) * 21)
        for (dfm, well), x in signals.items()
        for i, v in enumerate(x)
    ]
    if shuffled:
        np.random.default_rng(0).shuffle(rows)
        rows = [tuple(r) for r in rows]
        rows = [("p", int(a), int(b), int(c), int(d), float(e), float(f), int(g)) for _, a, b, c, d, e, f, g in rows]
    df = spark.createDataFrame(
        rows,
        "project string, dfm bigint, well bigint, pos bigint, sample bigint, minutes double, signal double, opto bigint",
    )
    return df.withColumn("chunk", F.expr(f"pos div {CHUNK}")).withColumn(
        "lit", F.getbit("opto", (F.col("well") - 1).cast("int")) == 1
    )


def loop_feeding(x, p):
    runs = [
        (s, e)
        for s, e in loop_runs(x > p.feeding_minimum)
        if (x[s : e + 1] > p.feeding_threshold).any() and e - s + 1 >= p.feeding_minevents
    ]
    return runs, loop_link(runs, p.feeding_event_link_gap)


def mask(spans, n):
    out = np.zeros(n, bool)
    for s, e in spans:
        out[s : e + 1] = True
    return out


def loop_detect(base, p):
    """Expected licks (before, after) and bouts of every well."""
    before = {k: mask(loop_feeding(x, p)[0], len(x)) for k, x in base.items()}
    fixed = {k: x.copy() for k, x in base.items()}
    for dfm in {d for d, _ in base}:
        for a, b in p.chamber_sets:
            both = before[dfm, a] & before[dfm, b]
            xa, xb = base[dfm, a], base[dfm, b]
            fixed[dfm, a][both & (xa <= xb)] = 0.0
            fixed[dfm, b][both & (xb <= xa)] = 0.0
    found = {k: loop_feeding(x, p) for k, x in fixed.items()}
    return before, found


@pytest.fixture(scope="module")
def labelled(spark):
    seats = access.seats_from_params(spark, SHARED)
    rows = access.seat_samples(to_frame(spark), seats).withColumn("base", F.col("signal"))
    return detect(rows, SHARED, chunk_rows=CHUNK).cache()


def test_detection_against_loops(labelled):
    before, found = loop_detect(SIGNALS, SHARED)
    got = labelled.toPandas().set_index(["dfm", "well", "pos"]).sort_index()
    assert len(got) == sum(map(len, SIGNALS.values()))
    for (dfm, well), x in SIGNALS.items():
        mine = got.loc[dfm, well]
        licks, linked = found[dfm, well]
        assert mine["lick_before"].tolist() == before[dfm, well].tolist()
        lick = mask(licks, len(x))
        assert mine["lick"].tolist() == lick.tolist()
        bout = pd.Series(np.nan, range(len(x)))
        for s, e in linked:
            bout[s : e + 1] = s
        assert mine["bout"].fillna(-1).tolist() == bout.fillna(-1).tolist()
        assert np.flatnonzero(mine["bout_head"]).tolist() == [s for s, _ in linked]
        assert np.flatnonzero(mine["lick_head"]).tolist() == [s for s, _ in licks]
        assert np.flatnonzero(mine["gap_head"]).tolist() == [s for s, _ in loop_runs(bout.isna().to_numpy())]
        assert np.flatnonzero(mine["rest_head"]).tolist() == [s for s, _ in loop_runs(~lick)]
        taste = (x > 2.0) & (x < 9.0) & ~lick
        assert mine["taste"].tolist() == taste.tolist()


def test_bouts_gaps_and_tasting(labelled):
    _, found = loop_detect(SIGNALS, SHARED)
    pdf = {
        "bouts": bouts.feeding_bouts(labelled, SHARED).toPandas(),
        "gaps": bouts.feeding_intervals(labelled, SHARED, chunk_rows=CHUNK).toPandas(),
        "rests": bouts.tasting_intervals(labelled, SHARED, chunk_rows=CHUNK).toPandas(),
    }
    from boutspark.operators.detect import tasting_runs

    tasting = tasting_runs(labelled, SHARED, chunk_rows=CHUNK).toPandas()
    for (dfm, well), x in SIGNALS.items():
        pick = lambda df: df[(df.dfm == dfm) & (df.well == well)]
        licks, linked = found[dfm, well]
        b = pick(pdf["bouts"]).sort_values("start")
        assert list(zip(b.start, b.start + b.Licks - 1)) == linked
        for r in b.itertuples():
            seg = x[r.start : r.start + r.Licks]
            assert r.TotalIntensity == pytest.approx(seg.sum())
            assert (r.MinIntensity, r.MaxIntensity) == (seg.min(), seg.max())
            assert r.VarIntensity == pytest.approx(seg.var(ddof=1))
        for name, spans in (("gaps", linked), ("rests", licks)):
            g = pick(pdf[name]).sort_values("pos")
            want = loop_runs(~mask(spans, len(x)))
            assert list(zip(g.pos, g.IntervalSec)) == [(s, e - s + 1.0) for s, e in want]
        t = pick(tasting).sort_values("start")
        taste = (x > 2.0) & (x < 9.0) & ~mask(licks, len(x))
        assert list(zip(t.start, t.end)) == [(s, e) for s, e in loop_runs(taste) if e > s]


def test_summary_against_loops(labelled):
    got = summary.feeding_summary(labelled, SHARED, start=5, end=33, transform_licks=False).toPandas()
    _, found = loop_detect(SIGNALS, SHARED)
    assert len(got) == 12
    for r in got.itertuples():
        for side, well in zip("AB", SHARED.chamber_sets[r.chamber - 1]):
            x = SIGNALS[r.dfm, well]
            licks, linked = found[r.dfm, well]
            inside = (np.arange(len(x)) > 5) & (np.arange(len(x)) <= 33)
            assert getattr(r, f"Licks{side}") == (mask(licks, len(x)) & inside).sum()
            chosen = [(s, e) for s, e in linked if 5 < s <= 33]
            assert getattr(r, f"Events{side}") == len(chosen)
            if chosen:
                assert getattr(r, f"MedDuration{side}") == np.median([e - s + 1 for s, e in chosen])
            values = x[mask(linked, len(x)) & inside]
            if len(values):
                assert getattr(r, f"MedianInt{side}") == pytest.approx(np.median(values))
                assert getattr(r, f"MeanInt{side}") == pytest.approx(values.mean())
            gaps = [e - s + 1 for s, e in loop_runs(~mask(linked, len(x))) if 5 < s <= 33]
            assert getattr(r, f"MedTimeBtw{side}") == (np.median(gaps) if gaps else 0)


def test_order_and_partitions_do_not_matter(spark, labelled):
    seats = access.seats_from_params(spark, SHARED)
    rows = access.seat_samples(to_frame(spark, shuffled=True).repartition(1), seats)
    again = detect(rows.withColumn("base", F.col("signal")), SHARED, chunk_rows=CHUNK)
    cols = ["dfm", "well", "pos", "lick", "bout", "taste"]
    assert again.select(cols).exceptAll(labelled.select(cols)).count() == 0
    assert labelled.count() == again.count()


@pytest.mark.parametrize("window", [1, 5, 31, 201])
def test_running_median_in_chunks(spark, window):
    x = SIGNALS[1, 1].copy()
    df = to_frame(spark, {(1, 1): x}).withColumn(
        "signal", F.when(F.col("pos") % 13 != 5, F.col("signal"))
    )
    got = running_median(df, REC, window, chunk_rows=CHUNK).toPandas().sort_values("pos")
    x[np.arange(len(x)) % 13 == 5] = np.nan
    want = pd.Series(x).rolling(window, center=True, min_periods=1).median()
    assert got["median"].tolist() == pytest.approx(want.tolist(), nan_ok=True)
    assert got["pos"].tolist() == list(range(len(x)))


def test_medians_leave_in_order(spark):
    rows = to_frame(spark, shuffled=True)
    got = running_median(rows, REC, 5, chunk_rows=CHUNK).select("dfm", "chunk", "well", "pos").collect()
    for key in {(r["dfm"], r["chunk"]) for r in got}:
        places = [(r["well"], r["pos"]) for r in got if (r["dfm"], r["chunk"]) == key]
        assert places == sorted(places)
    assert len(got) == sum(map(len, SIGNALS.values()))


def test_levels_of_the_settings_do_not_travel(spark, labelled, monkeypatch):
    sent = []
    plain = detection._with_marks
    monkeypatch.setattr(detection, "_with_marks", lambda rows, *a: (sent.append(rows.columns), plain(rows, *a))[1])
    rows = access.seat_samples(to_frame(spark), access.seats_from_params(spark, SHARED)).withColumn("base", F.col("signal"))
    got = detect(rows, SHARED, chunk_rows=CHUNK, staged=False)
    levels = ["feeding_max", "feeding_min", "tasting_max", "tasting_min"]
    assert "base" in sent[-1] and not set(levels) & set(sent[-1])
    assert [tuple(r) for r in got.select(*levels).distinct().collect()] == [(30.0, 10.0, 9.0, 2.0)]
    assert sorted(got.columns) == sorted(labelled.columns)


def test_parameters_per_device(spark):
    """A parameter table gives what shared parameters give device by device."""
    fields = [
        f for f in Params.__dataclass_fields__ if f != "chamber_sets"
    ]
    each = {
        1: SHARED.with_updates(pi_direction="right", baseline_window_minutes=0.15),
        2: SHARED.with_updates(
            feeding_threshold=-0.6, feeding_minimum=-0.2, tasting_minimum=-0.05, tasting_maximum=-0.15,
            feeding_event_link_gap=0, correct_for_dual_feeding=False, baseline_window_minutes=0.35,
            samples_per_second=2.0,
        ),
    }
    rows = [
        ("p", d, *[getattr(p, f) for f in fields], [list(s) for s in p.chamber_sets]) for d, p in each.items()
    ]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    schema = ", ".join(
        ["project string", "dfm bigint"]
        + [f"{f} {kinds[type(getattr(SHARED, f))]}" for f in fields]
        + ["chamber_sets array<array<int>>"]
    )
    table = spark.createDataFrame(rows, schema)
    seated = access.seat_samples(to_frame(spark), access.seats_from_table(table))
    base = subtract_baseline(seated, table, chunk_rows=CHUNK)
    got = detect(base, table, chunk_rows=CHUNK).cache()
    whole = bouts.feeding_bouts(got, table)
    cols = ["dfm", "well", "side", "pos", "base", "lick", "bout", "taste"]
    for d, p in each.items():
        mine = access.seat_samples(
            to_frame(spark).filter(F.col("dfm") == d), access.seats_from_params(spark, p)
        )
        alone = detect(subtract_baseline(mine, p, chunk_rows=CHUNK), p, chunk_rows=CHUNK)
        part = got.filter(F.col("dfm") == d)
        assert part.count() == alone.count() > 0
        assert part.select(cols).exceptAll(alone.select(cols)).count() == 0
        lengths = bouts.feeding_bouts(alone, p).select("well", "start", "Duration", "VarIntensity")
        assert whole.filter(F.col("dfm") == d).select(lengths.columns).exceptAll(lengths).count() == 0


def test_relative_thresholds(spark):
    p = SHARED.with_updates(feeding_threshold=-0.5, feeding_minimum=0.25)
    df = spark.createDataFrame(
        [("p", 1, 1, 5.0), ("p", 1, 1, 3.0), ("p", 1, 2, None), ("p", 1, 2, 7.0)],
        "project string, dfm int, well int, base double",
    )
    got = {r["well"]: (r["feeding_max"], r["feeding_min"]) for r in thresholds(df, p).collect()}
    assert got == {1: (2.0, 1.0), 2: (4.0, 2.0)}  # 2.5 and 3.5 round half to even


def test_load_window_renumbers(spark):
    got = load_window(to_frame(spark), REC, 10, 15).filter("well = 3 and dfm = 1").orderBy("pos")
    assert [(r["pos"], r["minutes"]) for r in got.collect()] == [(i, 11.0 + i) for i in range(4)]


def test_bins_check_their_arguments():
    for bad in (
        {"size": 0},
        {"edges": [1, 1]},
        {"edges": [1]},
        {"size": 5, "edges": [1, 2]},
        {},
        {"size": 5, "start": 9, "end": 3},
    ):
        with pytest.raises(ValueError):
            summary.Bins(**bad)
    for points in ([], [0, 4], [5, 2]):
        with pytest.raises(ValueError):
            summary.Bins.from_breakpoints(points)


def test_float_edges_decide_bins(spark):
    bins = summary.Bins(size=0.1)
    values = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.7, 0.25]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    got = [r["b"] for r in df.select(bins.number(F.col("m")).alias("b")).collect()]
    want = []
    for v in values:
        k = [i for i in range(10) if i * 0.1 < v <= (i + 1) * 0.1]
        want.append(k[0] if k else None)
    assert got == want


def test_single_sample_device_has_no_bins(spark):
    rows = to_frame(spark, {(1, 1): np.array([50.0])})
    seats = access.seats_from_params(spark, SHARED)
    one = detect(access.seat_samples(rows, seats).withColumn("base", F.col("signal")), SHARED, chunk_rows=CHUNK)
    bins = summary.Bins(size=5, scope="device")
    assert summary.binned_summary(one, SHARED, bins).count() == 0
    assert summary.feeding_summary(one, SHARED).count() == 1


def test_segments_are_written_in_one_job(spark, labelled, tmp_path):
    from boutspark.sources.sinks import write_segments

    design = labelled.select(*REC, "chamber").distinct().filter("chamber < 6").withColumn("Treatment", F.lit("t"))
    path = str(tmp_path / "segments")
    write_segments(labelled, SHARED, design, [10, 33], path, transform_licks=False)
    back = spark.read.option("header", "true").csv(path)
    counts = {r["segment"]: r["n"] for r in back.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    assert counts == {"0_10": 10, "10_33": 10, "33_end": 10}
    whole = summary.feeding_summary(labelled, SHARED, start=0, transform_licks=False)
    want = whole.filter("chamber < 6").agg(F.sum("LicksA")).first()[0]
    assert back.agg(F.sum(F.col("LicksA").cast("double"))).first()[0] == want


def test_sweep_equals_single_runs(spark):
    from boutspark.plans.experiment import parameter_sweep

    seats = access.seats_from_params(spark, SHARED)
    rows = access.seat_samples(to_frame(spark), seats)
    design = rows.select(*REC, "chamber").distinct().withColumn("Treatment", F.lit("t"))
    p = SHARED.with_updates(samples_per_second=1.0)
    for field, values in (
        ("baseline_window_minutes", [0.1, 0.4]),
        ("feeding_threshold", [-0.5, 25.0]),
        ("feeding_minevents", [1, 4]),
    ):
        got = parameter_sweep(rows, design, p, field, values).toPandas().set_index("sweep_value")
        for v in values:
            q = p.with_updates(**{field: v})
            one = detect(subtract_baseline(rows, q), q)
            s = summary.feeding_summary(one, q).toPandas()
            assert got.mean_Licks[v] == pytest.approx((s.LicksA + s.LicksB).mean()), (field, v)
            assert got.mean_Events[v] == pytest.approx((s.EventsA + s.EventsB).mean())
            assert got.n_chambers[v] == 12
    with pytest.raises(ValueError):
        parameter_sweep(rows, design, p, "pi_direction", [1.0])
