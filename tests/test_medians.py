"""Exact medians by radix selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutspark.operators import medians


def test_close_values_of_one_group_never_meet(spark, monkeypatch):
    """200,000 values between 1,000,000 and 1,000,020, one group: what is put in order stays small."""
    met = []
    plain = medians._ordered

    def watched(inside, keys):
        met.append(inside.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return plain(inside, keys)

    monkeypatch.setattr(medians, "_ordered", watched)
    df = spark.range(200_000).select(
        F.lit("g").alias("g"), (F.lit(1_000_000.0) + F.pmod(F.xxhash64("id"), F.lit(200_003)) / 10_000.0).alias("x")
    )
    want = np.median(np.array([r["x"] for r in df.collect()]))
    assert medians.group_median(df, ["g"], "x", "m").first()["m"] == want
    assert all(n <= medians.ORDERED for n in met)


@pytest.mark.parametrize("ordered", [0, 5, 10_000])
def test_equal_to_sorting(spark, monkeypatch, ordered):
    monkeypatch.setattr(medians, "ORDERED", ordered)
    monkeypatch.setattr(medians, "DIGITS", 4)
    r = np.random.default_rng(4)
    groups = {
        "one": [3.5],
        "two": [1.0, 2.0],
        "same": [7.25] * 500,
        "signs": [-1.0, 0.0, -0.0, 1.0, -2.0, 2.0],
        "even": [1.0] * 50 + [9.0] * 50,
        "close": (1e6 + r.random(301) / 1e3).tolist(),
        "wide": (10.0 ** r.uniform(-300, 300, 200) * r.choice([-1, 1], 200)).tolist(),
        "tiny": (r.random(100) * 1e-310).tolist(),
        "ends": [float("-inf")] * 3 + [1.0, 2.0] + [float("inf")] * 3,
        "gaps": [None, float("nan"), 4.0, 5.0],
        "none": [None, float("nan")],
    }
    df = spark.createDataFrame([(g, float(x) if x is not None else None) for g, xs in groups.items() for x in xs], "g string, x double")
    got = {r["g"]: r["m"] for r in medians.group_median(df.repartition(5), ["g"], "x", "m").collect()}
    want = {g: [x for x in xs if x is not None and x == x] for g, xs in groups.items()}
    want = {g: np.sort(xs) for g, xs in want.items() if xs}
    assert got == {g: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 for g, x in want.items()}
    assert medians.group_median(df.where("false"), ["g"], "x", "m").count() == 0
