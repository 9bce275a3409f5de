"""The join that deals a small table to the chunks of its keys."""

import random

import pytest
from pyspark.sql import functions as F

from boutspark.operators.scan import spread_join

ROWS = [("p", 1, w, i // 10, i) for w in (1, 2) for i in range(400)] + [("p", 2, 1, 0, 3), ("q", 1, 3, 0, 5)]


@pytest.fixture(scope="module")
def samples(spark):
    random.Random(1).shuffle(ROWS)
    return spark.createDataFrame(ROWS, "project string, dfm int, well int, chunk bigint, pos bigint")


@pytest.fixture(scope="module")
def wells(spark):
    rows = [("p", 1, 1, 1.5, "a"), ("p", 1, 2, None, "b"), ("p", 9, 1, 9.0, "c"), ("q", 1, 1, 2.5, "d")]
    return spark.createDataFrame(rows, "project string, dfm int, well int, level double, name string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("within", ["well", None])
def test_equals_the_plain_join(samples, wells, how, within):
    keys = ["project", "dfm"] if within else ["project", "dfm", "well"]
    got = spread_join(samples, wells, keys, how, within=within)
    want = samples.join(wells, ["project", "dfm", "well"], how).select(*samples.columns, "level", "name")
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_without_values_it_only_filters(samples, wells):
    got = spread_join(samples, wells.select("project", "dfm", "well"), ["project", "dfm", "well"])
    assert rows_of(got) == rows_of(samples.join(wells, ["project", "dfm", "well"], "left_semi").select(*samples.columns))


def test_empty_sides(samples, wells):
    keys = ["project", "dfm", "well"]
    assert spread_join(samples.limit(0), wells, keys).count() == 0
    assert spread_join(samples, wells.limit(0), keys).count() == 0
    assert spread_join(samples, wells.limit(0), keys, "left").count() == len(ROWS)


def test_a_long_recording_is_many_tasks(spark, samples, wells):
    """Nothing is broadcast; no task holds more than the chunks that hash to it."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        dealt = spread_join(samples.repartition("project", "dfm", "chunk"), wells, ["project", "dfm"], within="well")
        sizes = dealt.where("dfm = 1 and project = 'p'").groupBy(F.spark_partition_id().alias("task")).count().collect()
        plain = samples.join(wells, ["project", "dfm", "well"])
        whole = plain.where("dfm = 1 and project = 'p'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in whole) >= 400
    # 40 chunks of 20 rows over 64 tasks
    assert len(sizes) > 20 and max(r["count"] for r in sizes) <= 5 * 20
