"""Comparing experiments and parameter values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.functions.scalars import standard_error
from boutspark.operators.groups import APART, group_label, kept_apart, sweep_metric

# Metrics of sweeps and comparisons.
METRICS = ("Licks", "Events", "MedDuration")


def _group_means(
    summary: DataFrame, factors: Sequence[str], metrics: Sequence[str], apart: Sequence[str]
) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("Metric"), sweep_metric(summary.columns, m).alias("v"))
            for m in metrics
        ]
    )
    return (
        summary.select(*apart, group_label(factors).alias("Group"), F.inline(cells))
        .groupBy(*apart, "Group", "Metric")
        .agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    )


def compare_experiments(
    first: DataFrame,
    second: DataFrame,
    factors: Sequence[str] = (),
    metrics: Sequence[str] = METRICS,
    apart: Sequence[str] = (),
) -> DataFrame:
    """Group means of two summaries beside each other; groups of either appear.

    `n_a` and `n_b` are the observations behind a mean. Two detections of several
    experiments are compared experiment by experiment with `apart=["project"]`.
    """
    a, b = (
        _group_means(t, factors, metrics, apart).withColumnsRenamed({"mean": f"mean_{x}", "n": f"n_{x}"})
        for t, x in ((first, "a"), (second, "b"))
    )
    both = a.join(b, [*apart, "Group", "Metric"], "full_outer").fillna(0, ["n_a", "n_b"])
    delta = F.col("mean_b") - F.col("mean_a")
    return both.withColumn("delta", delta).withColumn(
        "pct_change", F.when(F.col("mean_a") != 0, F.col("delta") / F.col("mean_a") * 100.0)
    )


def sweep_table(
    summary: DataFrame,
    value_column: str,
    factors: Sequence[str] = (),
    metrics: Sequence[str] = METRICS,
    apart: Sequence[str] = APART,
) -> DataFrame:
    """Chambers, mean and error of every metric per parameter value and group."""
    apart = kept_apart(summary, apart)
    rows = summary.select(
        *apart,
        value_column,
        group_label(factors).alias("Group"),
        *[sweep_metric(summary.columns, m).alias(m) for m in metrics],
    )
    stats = [F.count(F.lit(1)).alias("n_chambers")]
    for m in metrics:
        stats += [F.avg(m).alias(f"mean_{m}"), standard_error(m).alias(f"sem_{m}")]
    return rows.groupBy(*apart, value_column, "Group").agg(*stats)
