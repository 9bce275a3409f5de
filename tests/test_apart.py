"""Results of several experiments with the same treatment names stay apart; ticks of phases are counted as bits."""

import pytest
from pyspark.sql import functions as F

from boutspark.operators import compare, groups, light
from boutspark.params import Params


@pytest.fixture(scope="module")
def two_projects(spark):
    rows = [
        (p, d, c, t, float(k * x), float(k + x), float(k * c), float(x), float(k), float(c), b, b * 10.0)
        for p, k in (("one", 1), ("two", 100))
        for d in (1, 2)
        for c, t in ((1, "a"), (2, "a"), (3, "b"))
        for b in (0, 1)
        for x in (c + d + b,)
    ]
    return spark.createDataFrame(
        rows,
        "project string, dfm bigint, chamber bigint, Treatment string, LicksA double, LicksB double, MedDurationA double,"
        " MedDurationB double, EventsA double, EventsB double, bin bigint, Minutes double",
    )


def by_project(df, build, keys):
    """What `build` gives over both projects must be what it gives over each alone."""
    both = {tuple(r[k] for k in keys): r.asDict() for r in build(df).collect()}
    alone = {}
    for p in ("one", "two"):
        for r in build(df.where(F.col("project") == p)).collect():
            alone[tuple(r[k] for k in keys)] = r.asDict()
    assert set(both) == set(alone) and {k[0] for k in both} == {"one", "two"}
    for at, row in both.items():
        for name, x in row.items():
            want = alone[at][name]
            assert x == (pytest.approx(want) if isinstance(want, float) else want), (at, name)


def test_group_tables_keep_projects_apart(two_projects):
    by_project(two_projects, lambda d: groups.time_course(d, [], "Licks"), ["project", "Group", "bin"])
    by_project(two_projects, lambda d: groups.time_courses(d, [], ["Licks", "Events"]), ["project", "Group", "Metric", "bin"])
    by_project(two_projects, groups.weighted_durations, ["project", "Treatment"])
    swept = two_projects.withColumn("v", F.lit(1.0))
    by_project(swept, lambda d: compare.sweep_table(d, "v"), ["project", "Group", "v"])
    by_project(
        two_projects, lambda d: compare.compare_experiments(d, d.where("bin = 1"), apart=["project"]), ["project", "Group", "Metric"]
    )


def test_comparison_of_different_projects_and_observations(two_projects):
    one, two = (two_projects.where(F.col("project") == p) for p in ("one", "two"))
    got = {(r["Group"], r["Metric"]): r for r in compare.compare_experiments(one, two.where("Treatment = 'a'")).collect()}
    assert got["a", "Licks"]["n_a"] == 8 and got["a", "Licks"]["n_b"] == 8
    assert got["b", "Licks"]["n_b"] == 0 and got["b", "Licks"]["mean_b"] is None
    assert groups.time_course(two_projects, [], "Licks", apart=()).count() == 4


def test_phase_seconds_count_ticks_once(spark):
    """Ticks over several bitmap buckets, wells that share ticks, a well that misses some."""
    rows = spark.range(100_000).select(
        F.lit("p").alias("project"), F.lit(1).alias("dfm"), F.col("id").alias("pos"), F.expr("id div 65536").alias("chunk"),
        F.expr("if(id % 7 < 2, 3, 0)").alias("opto"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"),
    )
    rows = rows.where("side = 'A' or pos % 5 > 0").selectExpr("*", "1 as chamber", "false as lick", "false as bout_head")
    got = {r["Phase"]: r["PhaseSeconds"] for r in light.light_phases(rows, Params.two_well(samples_per_second=5.0)).collect()}
    lit = sum(i % 7 < 2 for i in range(100_000))
    assert got == {"light": lit / 5.0, "dark": (100_000 - lit) / 5.0}
