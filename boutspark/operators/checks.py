"""Checks of parameters and designs of many experiments at once.

Every check returns rows (project, severity, subject, message); nothing raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.operators.config import known_parameter, normal_name
from boutspark.params import REC, WELLS_PER_DEVICE

# Chamber size each experiment type asks for.
TYPE_SIZES = {"hedonic": 2, "progressive_ratio": 2, "single_well": 1, "two_well": 2}


def _issue(df: DataFrame, severity: str, subject: Column, message: str) -> DataFrame:
    return df.select(
        "project",
        F.lit(severity).alias("severity"),
        subject.cast("string").alias("subject"),
        F.lit(message).alias("message"),
    )


def _device() -> Column:
    return F.col("dfm").cast("string")


def _seat() -> Column:
    return F.concat_ws(":", F.col("dfm").cast("string"), F.col("chamber").cast("string"))


def chamber_sizes(params: DataFrame) -> DataFrame:
    size = F.col("chamber_size")
    mixed = (
        params.filter(size.isNotNull())
        .groupBy("project")
        .agg(F.min(size).alias("low"), F.max(size).alias("high"))
        .filter("low <> high")
    )
    return (
        _issue(params.filter(size.isNull()), "error", _device(), "chamber_size is missing")
        .unionByName(
            _issue(params.filter(~size.isin(1, 2)), "error", _device(), "chamber_size must be 1 or 2")
        )
        .unionByName(_issue(mixed, "error", F.col("project"), "devices differ in chamber_size"))
    )


def directions(params: DataFrame) -> DataFrame:
    bad = params.filter(~F.col("pi_direction").isin("left", "right"))
    return _issue(bad, "error", _device(), "pi_direction must be left or right")


def duplicate_devices(devices: DataFrame) -> DataFrame:
    twice = devices.groupBy(*REC).count().filter("count > 1")
    return _issue(twice, "error", _device(), "device is listed more than once")


def factor_levels(design: DataFrame, factors: DataFrame) -> DataFrame:
    """`design.levels` holds comma-separated levels; `factors` one row per factor
    (project, factor, place, level) and declared level."""
    count = factors.groupBy("project").agg(F.count_distinct("factor").alias("n"))
    given = design.withColumn(
        "_parts", F.transform(F.split("levels", ","), lambda x: F.trim(x))
    ).join(count, "project")
    wrong = given.filter(F.size("_parts") != F.col("n"))
    level = (
        given.filter(F.size("_parts") == F.col("n"))
        .select(*REC, "chamber", F.posexplode("_parts").alias("place", "level"))
        .withColumn("place", F.col("place").cast("bigint"))
    )
    unknown = level.join(
        factors.select("project", F.col("place").cast("bigint").alias("place"), "level"),
        ["project", "place", "level"],
        "left_anti",
    )
    return _issue(wrong, "error", _seat(), "wrong number of factor levels").unionByName(
        _issue(unknown, "error", _seat(), "factor level is not declared")
    )


def unknown_parameters(written: DataFrame) -> DataFrame:
    bad = written.filter(known_parameter(F.col("name")).isNull())
    subject = F.concat_ws(":", F.col("dfm").cast("string"), normal_name(F.col("name")))
    return _issue(bad, "warning", subject, "unknown parameter")


def well_sets(params: DataFrame) -> DataFrame:
    columns = params.filter(
        F.exists("chamber_sets", lambda s: F.size(s) != F.col("chamber_size"))
    )
    wells = params.filter(
        F.exists(
            "chamber_sets",
            lambda s: F.exists(
                s, lambda w: w.isNull() | (w < 1) | (w > WELLS_PER_DEVICE)
            ),
        )
    )
    return _issue(
        columns, "error", _device(), "chamber_sets do not fit chamber_size"
    ).unionByName(_issue(wells, "error", _device(), "chamber_sets name a well outside 1 to 12"))


def experiment_types(experiments: DataFrame, params: DataFrame) -> DataFrame:
    """`experiments` has project and experiment_type (null when left open)."""
    known = F.create_map(*[F.lit(x) for item in TYPE_SIZES.items() for x in item])
    typed = experiments.filter(F.col("experiment_type").isNotNull()).withColumn(
        "_size", known[F.col("experiment_type")]
    )
    unknown = typed.filter(F.col("_size").isNull())
    clash = typed.join(params.select(*REC, "chamber_size"), "project").filter(
        F.col("chamber_size") != F.col("_size")
    )
    return _issue(unknown, "error", F.col("experiment_type"), "unknown experiment type").unionByName(
        _issue(clash, "error", _device(), "experiment type does not fit chamber_size")
    )


def unassigned_devices(devices: DataFrame, design: DataFrame) -> DataFrame:
    bare = devices.select(*REC).distinct().join(design.select(*REC), list(REC), "left_anti")
    return _issue(bare, "warning", _device(), "no chamber assignments")


def missing_params(devices: DataFrame, written: DataFrame) -> DataFrame:
    common = written.filter(F.col("dfm").isNull()).select("project").distinct()
    own = written.filter(F.col("dfm").isNotNull()).select(*REC).distinct()
    bare = (
        devices.select(*REC)
        .distinct()
        .join(common, "project", "left_anti")
        .join(own, list(REC), "left_anti")
    )
    return _issue(bare, "error", _device(), "no parameters for the device or the experiment")


def chamber_entries(design: DataFrame, params: DataFrame) -> DataFrame:
    have = params.select(*REC, F.size("chamber_sets").alias("_n"))
    beyond = design.join(have, list(REC)).filter(
        (F.col("chamber") < 1) | (F.col("chamber") > F.col("_n"))
    )
    twice = design.groupBy(*REC, "chamber").count().filter("count > 1")
    return _issue(beyond, "error", _seat(), "device has no such chamber").unionByName(
        _issue(twice, "error", _seat(), "chamber is assigned more than once")
    )


def all_checks(
    devices: DataFrame,
    written: DataFrame,
    params: DataFrame,
    design: DataFrame,
    factors: DataFrame,
    experiments: DataFrame,
) -> DataFrame:
    found = [
        chamber_sizes(params),
        directions(params),
        duplicate_devices(devices),
        factor_levels(design, factors),
        unknown_parameters(written),
        well_sets(params),
        experiment_types(experiments, params),
        unassigned_devices(devices, design),
        missing_params(devices, written),
        chamber_entries(design, params),
    ]
    return reduce(DataFrame.unionByName, found)
