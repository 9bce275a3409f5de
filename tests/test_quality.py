"""Masks of wells and shared licks against plain counts."""

import random

import pytest

from boutspark import Params
from boutspark.operators import detect, quality
from boutspark.plans.experiment import quality_results


def recording(devices=3, ticks=400, seed=2):
    r = random.Random(seed)
    level = {}
    for d in range(1, devices + 1):
        for p in range(ticks):
            for w in range(1, 13):
                # device 3 has no well 12; some values are missing
                if not (d == 3 and w == 12) and r.random() > 0.05:
                    level[d, p, w] = None if r.random() < 0.02 else float(r.choice([0, 5, 60, 200]) + r.randrange(5))
    return level


def frame(spark, level, chunk=64):
    rows = [("p", d, w, (w + 1) // 2, 2 - w % 2, p // chunk, p, float(p), p / 60, v) for (d, p, w), v in level.items()]
    kinds = "project string, dfm int, well int, chamber int, slot int, chunk bigint, pos bigint, seconds double, minutes double, base double"
    df = spark.createDataFrame(rows, kinds).repartition(5)
    return df.selectExpr("*", "base > 50 as lick_before", "base > 50 and not (base > 202 and slot = 1) as lick")


def test_bleeding_matrix_equals_plain_means(spark):
    level = recording()
    matrix, overall = quality.bleeding_matrix(frame(spark, level), 50.0)
    got = {(r["dfm"], r["Signal"]): r for r in matrix.collect()}
    assert len(got) == 3 * 12
    for d in (1, 2, 3):
        for i in range(1, 13):
            ticks = [p for p in range(400) if (level.get((d, p, i)) or 0) > 50]
            for j in range(1, 13):
                values = [v for p in ticks if (v := level.get((d, p, j))) is not None]
                want = sum(values) / len(values) if values else 0.0
                assert got[d, f"W{i}Sig"][f"W{j}Resp"] == pytest.approx(want)
    means = {(r["dfm"], r["well"]): r["MeanBase"] for r in overall.collect()}
    assert (3, 12) not in means and len(means) == 35
    for (d, w), m in means.items():
        values = [v for (a, _, b), v in level.items() if (a, b) == (d, w) and v is not None]
        assert m == pytest.approx(sum(values) / len(values))


def test_masks_are_few_rows_a_device(spark):
    level = recording(devices=1, ticks=3000)
    rows = quality.mask_histogram(frame(spark, level), 1e9).collect()
    assert [(r["mask"], r["Ticks"]) for r in rows] == [(0, 3000)]
    plan = quality.mask_histogram(frame(spark, level), 50.0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_shared_licks_of_both_stages(spark):
    level = recording()
    rows = frame(spark, level)
    got = {(r["dfm"], r["chamber"], r["stage"]): r for r in detect.simultaneous_matrices(rows).collect()}
    assert len(got) == 3 * 6 * 2
    for (d, c, name), r in got.items():
        lick = lambda v, slot: (v or 0) > 50 and not (name == "after" and slot == 1 and v > 202)
        one = {p: v for (a, p, w), v in level.items() if a == d and w == 2 * c - 1 and lick(v, 1)}
        two = {p: v for (a, p, w), v in level.items() if a == d and w == 2 * c and lick(v, 2)}
        both = one.keys() & two.keys()
        assert (r["Licks1"], r["Licks2"], r["Both"]) == (len(one), len(two), len(both))
        assert r["MaxMinSignalAtBoth"] == max([min(one[p], two[p]) for p in both], default=0.0)
        assert r["HigherInCol1AtBoth"] == sum(one[p] > two[p] for p in both)
    after = detect.simultaneous_matrix(rows, stage_name="after")
    assert {(r["dfm"], r["chamber"]): r["Both"] for r in after.collect()} == {
        k[:2]: r["Both"] for k, r in got.items() if k[2] == "after"
    }


def test_quality_results_of_every_device(spark):
    level = recording(ticks=120)
    rows = frame(spark, level).selectExpr(
        # device 2 stops for a minute twelve times
        "* except (seconds)",
        "seconds + if(dfm = 2, 60 * least(floor(pos / 8), 12), 0) as seconds",
    )
    params = Params.two_well(samples_per_second=1.0)
    got = quality_results(rows, rows, params, bleeding_cutoff=50.0)
    devices = {r["dfm"]: r for r in got.devices.collect()}
    assert {d: r["Breaks"] for d, r in devices.items()} == {1: 0, 2: 12, 3: 0}
    assert [r["BreakNr"] for r in got.first_breaks.orderBy("BreakNr").collect()] == list(range(1, 11))
    assert got.breaks.count() == 12 and got.simultaneous.count() == 36
    strongest = {}
    for r in got.bleeding.collect():
        others = [r[f"W{w}Resp"] for w in range(1, 13) if r["Signal"] != f"W{w}Sig"]
        strongest[r["dfm"]] = max([strongest.get(r["dfm"], 0.0), *others])
    assert {d: r["StrongestResponse"] for d, r in devices.items()} == pytest.approx(strongest)


def test_quality_of_nothing(spark):
    rows = frame(spark, recording(devices=1, ticks=2)).limit(0)
    got = quality_results(rows, rows, Params.two_well())
    assert [t.count() for t in got] == [0] * 6
