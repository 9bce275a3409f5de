"""Medians of many windows from one structure, and sweeps that read the samples once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutspark.operators import sweep
from boutspark.operators.wavelet import WaveletMatrix, WindowMedians
from boutspark.params import Params, Swept


@pytest.mark.parametrize("kinds", [1, 2, 3, 50, 10_000])
def test_kth_smallest_of_ranges(kinds):
    r = np.random.default_rng(kinds)
    x = r.integers(0, kinds, 700) / 7.0
    left = r.integers(0, 700, 900)
    right = np.array([r.integers(a + 1, 701) for a in left])
    k = np.array([r.integers(0, b - a) for a, b in zip(left, right)])
    want = [np.sort(x[a:b])[i] for a, b, i in zip(left, right, k)]
    assert np.array_equal(WaveletMatrix(x).kth(left, right, k), want)


def test_window_medians_equal_rolling_ones():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 9, 400):
        x = r.normal(size=n).round(1)
        x[r.random(n) < 0.2] = np.nan
        medians = WindowMedians(x)
        for width in (1, 3, 11, 51, 999):
            want = pd.Series(x).rolling(width, center=True, min_periods=1).median().to_numpy()
            assert np.array_equal(medians.at(np.arange(n), width), want, equal_nan=True)


def test_level_sets_are_nested_runs():
    r = np.random.default_rng(2)
    pos = np.flatnonzero(r.random(500) < 0.8)
    base = r.integers(0, 9, len(pos)).astype(float)
    got = {level: list(zip(*map(np.ndarray.tolist, rest))) for level, *rest in sweep.level_sets(pos, base, [5, 1, 3, 8])}
    assert 8 not in got and set(got) == {1, 3, 5}
    level_at = dict(zip(pos.tolist(), base.tolist()))
    for level, runs in got.items():
        inside = {p for s, e, _ in runs for p in range(s, e + 1)}
        assert inside == {p for p, b in level_at.items() if b > level}
        assert all(s - 1 not in inside and e + 1 not in inside for s, e, _ in runs)
        assert all(h == max(level_at[p] for p in range(s, e + 1)) for s, e, h in runs)


@pytest.fixture(scope="module")
def recording(spark):
    """Two devices; long contacts over many small chunks, shared ones, a silent well, missing samples."""
    r = np.random.default_rng(8)
    rows = []
    for dfm in (1, 2):
        for well in range(1, 7):
            x = r.normal(0, 2, 300)
            if well != 6:
                for at in r.integers(0, 290, 14):
                    x[at : at + r.integers(1, 30)] += r.choice([8, 15, 30, 45])
            for pos in range(300):
                signal = None if r.random() < 0.02 else float(x[pos].round(2))
                chamber = (well + 1) // 2
                rows.append(("p", dfm, chamber, "AB"[(well + 1) % 2], (well - 1) % 2 + 1, well, pos, pos / 60.0, signal, False))
    return spark.createDataFrame(
        rows,
        "project string, dfm bigint, chamber bigint, side string, slot int, well bigint, pos bigint, minutes double, signal double, lit boolean",
    ).withColumns({"chunk": F.expr("pos div 65536"), "sample": F.col("pos") + 1})


def runs_of(mask):
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(int), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def plain(wells, q):
    """Licks, events and median durations of every chamber, well by well."""
    base, levels = {}, {}
    for (dfm, chamber, side, well), x in wells.groupby(["dfm", "chamber", "side", "well"]):
        n = sweep.window_of(q.baseline_window_minutes, q.samples_per_second)
        b = (x.signal - x.signal.rolling(n, center=True, min_periods=1).median()).to_numpy()
        base[dfm, chamber, side] = b
        low, up = q.feeding_minimum, q.feeding_threshold
        if up < 0:
            low, up = np.rint(np.nanmax(b) * abs(low)), np.rint(np.nanmax(b) * abs(up))
        levels[dfm, chamber, side] = low, up

    def surviving(at, b):
        low, up = levels[at]
        with np.errstate(invalid="ignore"):
            return [(s, e) for s, e in runs_of(b > low) if b[s:e].max() > up and e - s >= q.feeding_minevents]

    out = {}
    for dfm, chamber, side in base:
        at = dfm, chamber, side
        b = base[at].copy()
        other = base.get((dfm, chamber, {"A": "B", "B": "A"}.get(side)))
        if q.correct_for_dual_feeding and other is not None:
            both = np.zeros(len(b), bool)
            for s, e in surviving(at, b):
                both[s:e] = True
            theirs = np.zeros(len(b), bool)
            for s, e in surviving((dfm, chamber, {"A": "B", "B": "A"}[side]), other):
                theirs[s:e] = True
            both &= theirs
            b[both] = np.where(b[both] <= other[both], 0.0, b[both])
        runs = surviving(at, b)
        bouts = []
        for s, e in runs:
            if bouts and s - bouts[-1][1] <= q.feeding_event_link_gap:
                bouts[-1][1] = e
            else:
                bouts.append([s, e])
        out.setdefault((dfm, chamber), {}).update(
            {
                f"Licks{side}": sum(e - s for s, e in runs) ** 0.25,
                f"Events{side}": float(len(bouts)),
                f"MedDuration{side}": float(np.median([(e - s) / q.samples_per_second for s, e in bouts])) if bouts else np.nan,
            }
        )
    return out


@pytest.mark.parametrize(
    "field, values, two",
    [
        ("feeding_threshold", [-0.5, 12.0, 33.0, -0.2], True),
        ("feeding_minimum", [2.0, 6.0, 10.0, 14.0], True),
        ("feeding_minevents", [1, 3, 9], True),
        ("feeding_event_link_gap", [0, 1, 6, 50], True),
        ("feeding_minimum", [1.0, 9.0], False),
        ("baseline_window_minutes", [5 / 60, 31 / 60, 91 / 60], True),
    ],
)
def test_sweep_equals_detection_value_by_value(spark, recording, field, values, two):
    p = (Params.two_well if two else Params.single_well)(
        feeding_threshold=20.0, feeding_minimum=6.0, samples_per_second=1.0, feeding_event_link_gap=2, baseline_window_minutes=1.0
    )
    rows = recording if two else recording.withColumn("chamber", F.col("well")).withColumn("side", F.lit(""))
    swept = Swept(p, field, tuple(map(float, values)))
    got = sweep.swept_summary(rows, p, swept, chunk_rows=16).toPandas().set_index(["sweep_value", "dfm", "chamber"])
    wells = rows.select("dfm", "chamber", "side", "well", "pos", "signal").toPandas().sort_values(["dfm", "well", "pos"])
    for v in values:
        want = plain(wells, p.with_updates(**{field: v}))
        assert set(got.loc[float(v)].index) == set(want)
        for at, measures in want.items():
            mine = got.loc[(float(v), *at)]
            for c, x in measures.items():
                assert mine[c] == pytest.approx(x, nan_ok=True), (v, at, c)
    assert len(got) == len(want) * len(values)


def test_sweep_of_an_empty_recording(spark, recording):
    p = Params.two_well(samples_per_second=1.0)
    assert sweep.swept_summary(recording.where("false"), p, Swept(p, "feeding_threshold", (20.0,))).count() == 0
