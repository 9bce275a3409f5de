"""Tables per treatment or factor group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.functions.scalars import standard_error
from boutspark.operators.summary import PAIRED_COLUMNS
from boutspark.params import REC
from boutspark.staging import stage

# The metrics of the summary figures.
SINGLE_FIGURE = (
    "Licks",
    "Events",
    "MeanDuration",
    "MedDuration",
    "MeanTimeBtw",
    "MedTimeBtw",
    "MeanInt",
    "MedianInt",
)
TWO_WELL_FIGURE = ["PI", "EventPI", *[f"{m}{s}" for m in SINGLE_FIGURE for s in "AB"]]

# Columns by which results of several experiments stay apart.
APART = ("project",)


def group_label(factors: Sequence[str]) -> Column:
    """Factor values joined with ` / `, or the treatment without factors."""
    return F.concat_ws(" / ", *factors) if factors else F.col("Treatment")


def split_levels(raw: Column, factors: Sequence[str]) -> tuple[Column, dict[str, Column], Column]:
    """Treatment name, level per factor, and whether the count is right.

    `raw` holds comma-separated levels in factor order; without factors it is
    the treatment itself.
    """
    if not factors:
        return raw, {}, F.lit(True)
    parts = F.transform(F.split(raw, ","), lambda level: F.trim(level))
    levels = {f: F.get(parts, i) for i, f in enumerate(factors)}
    return F.array_join(parts, "_"), levels, F.size(parts) == len(factors)


def separate_treatment(df: DataFrame, into: Sequence[str]) -> DataFrame:
    """Split a compound `Treatment` at underscores into columns."""
    parts = F.split("Treatment", "_")
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(into)})


# ---- choosing a metric ---------------------------------------------------


def _pair(columns: Sequence[str], metric: str) -> tuple[Column, Column]:
    a, b = f"{metric}A", f"{metric}B"
    if a not in columns or b not in columns:
        raise ValueError(f"metric {metric!r} is not in the summary")
    return F.col(a), F.col(b)


def display_metric(columns: Sequence[str], metric: str, mode: str = "total") -> Column:
    """For time courses and dot plots: a total treats one missing side as 0."""
    if metric in columns:
        return F.col(metric)
    if metric not in PAIRED_COLUMNS or metric in ("MinInt", "MaxInt"):
        raise ValueError(f"unknown metric {metric!r}")
    a, b = _pair(columns, metric)
    if mode == "A":
        return a
    if mode == "B":
        return b
    if mode == "mean_ab":
        return (a + b) / 2.0
    total = F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    return F.when(a.isNotNull() | b.isNotNull(), total)


def inference_metric(columns: Sequence[str], metric: str, mode: str = "total") -> Column:
    """For tests and intervals: a missing side makes the value missing."""
    if metric in columns:
        return F.col(metric)
    a, b = _pair(columns, metric)
    modes = {"A": a, "B": b, "total": a + b, "diff": a - b}
    if mode not in modes:
        raise ValueError(f"mode {mode!r} is not one of {sorted(modes)}")
    return modes[mode]


def sweep_metric(columns: Sequence[str], metric: str) -> Column:
    """For sweeps and comparisons: A + B, but the median duration of A."""
    if metric in columns:
        return F.col(metric)
    if f"{metric}A" not in columns:
        return F.lit(None).cast("double")
    a, b = _pair(columns, metric)
    return a if metric == "MedDuration" else a + b


# ---- means and errors ----------------------------------------------------


def mean_and_error(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Mean, Std, N, SEM and mean -/+ SEM of the non-null values."""
    stats = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys)
        .agg(
            F.avg(column).alias("Mean"),
            F.stddev_samp(column).alias("Std"),
            F.count(column).alias("N"),
        )
    )
    return (
        stats.withColumn("SEM", F.col("Std") / F.sqrt(F.greatest(F.col("N"), F.lit(1))))
        .withColumn("Lower", F.col("Mean") - F.col("SEM"))
        .withColumn("Upper", F.col("Mean") + F.col("SEM"))
    )


def kept_apart(df: DataFrame, apart: Sequence[str] = APART) -> list[str]:
    """Those of the columns that keep experiments apart which a table has."""
    return [c for c in apart if c in df.columns]


def time_course(
    binned: DataFrame, factors: Sequence[str], metric: str, mode: str = "total", apart: Sequence[str] = APART
) -> DataFrame:
    """Group means per bin; `Label` names the group with its largest n.

    Experiments stay apart by the columns of `apart`; () pools them.
    """
    apart = kept_apart(binned, apart)
    rows = binned.select(
        *apart,
        group_label(factors).alias("Group"),
        "bin",
        "Minutes",
        display_metric(binned.columns, metric, mode).alias("MetricValue"),
    )
    stats = mean_and_error(rows, [*apart, "Group", "bin", "Minutes"], "MetricValue")
    largest = stats.groupBy(*apart, "Group").agg(F.max("N").alias("_n"))
    label = F.concat("Group", F.lit(" (n="), F.col("_n").cast("string"), F.lit(")"))
    return stats.join(largest, [*apart, "Group"]).withColumn("Label", label).drop("_n")


def time_courses(
    binned: DataFrame,
    factors: Sequence[str],
    metrics: Sequence[str],
    mode: str = "total",
    apart: Sequence[str] = APART,
) -> DataFrame:
    """Several metrics at once; unknown ones are skipped."""
    apart = kept_apart(binned, apart)
    cells = []
    for m in metrics:
        try:
            cells.append(
                F.struct(
                    F.lit(m).alias("Metric"),
                    display_metric(binned.columns, m, mode).alias("MetricValue"),
                )
            )
        except ValueError:
            continue
    rows = binned.select(
        *apart, group_label(factors).alias("Group"), "bin", "Minutes", F.inline(F.array(*cells))
    )
    return mean_and_error(rows, [*apart, "Group", "Metric", "bin", "Minutes"], "MetricValue")


def dot_rows(
    summary: DataFrame, factors: Sequence[str], metric: str, mode: str = "total"
) -> DataFrame:
    """Metric per chamber with the columns of both plot directions."""
    if len(factors) >= 2:
        x, facet = F.col(factors[0]), F.col(factors[1])
    else:
        x, facet = group_label(factors), F.lit("All")
    value = display_metric(summary.columns, metric, mode)
    return summary.select(
        *[c for c in REC if c in summary.columns],
        "chamber",
        x.alias("X"),
        facet.alias("Facet"),
        value.alias("MetricValue"),
    ).filter(F.col("MetricValue").isNotNull())


def metric_grid(summary: DataFrame, factors: Sequence[str], by: Sequence[str] = REC) -> DataFrame:
    """Every figure metric as (Metric, Value) rows."""
    metrics = [
        m
        for m in (TWO_WELL_FIGURE if "PI" in summary.columns else SINGLE_FIGURE)
        if m in summary.columns
    ]
    return summary.select(
        group_label(factors).alias("Group"), *by, "chamber", *metrics
    ).unpivot(["Group", *by, "chamber"], metrics, "Metric", "Value")


def well_rows(
    summary: DataFrame,
    factors: Sequence[str],
    metric: str,
    by: Sequence[str] = REC,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """A and B under each other, with the event count of the well as weight."""
    names = {"A": "WellA", "B": "WellB", **(names or {})}
    wells = F.array(
        *[
            F.struct(
                F.lit(f"Well{s}").alias("Well"),
                F.lit(names[s]).alias("WellLabel"),
                F.col(f"{metric}{s}").alias(metric),
                F.col(f"Events{s}").alias("Weight"),
            )
            for s in "AB"
        ]
    )
    return summary.select(group_label(factors).alias("Group"), *by, "chamber", F.inline(wells))


def gather_foods(
    summary: DataFrame, metric: str, food: str, other: str, keep: Sequence[str] = ()
) -> DataFrame:
    """A and B values under each other; A is named by column `food`, B `other`."""
    cells = F.array(
        F.struct(F.col(food).alias("Food"), F.col(f"{metric}A").alias(metric)),
        F.struct(F.lit(other).alias("Food"), F.col(f"{metric}B").alias(metric)),
    )
    return summary.select(*keep, F.inline(cells))


def weighted_durations(summary: DataFrame, apart: Sequence[str] = APART) -> DataFrame:
    """Plain and event-weighted mean of the median durations per treatment.

    Weighted spread needs the weighted mean first: group sums are computed
    once, joined back, and squared distances summed.
    """
    keys = [*kept_apart(summary, apart), "Treatment"]
    cells = F.array(
        *[
            F.struct(
                F.lit(s).alias("side"),
                F.col(f"MedDuration{s}").alias("v"),
                F.col(f"Events{s}").alias("w"),
            )
            for s in "AB"
        ]
    )
    rows = stage(summary.select(*keys, F.inline(cells)), "durations")
    usable = F.col("v").isNotNull() & (F.col("w") > 0)
    first = rows.groupBy(*keys, "side").agg(
        F.avg("v").alias("mean"),
        standard_error("v").alias("sem"),
        F.sum(F.when(usable, F.col("w"))).alias("sw"),
        F.sum(F.when(usable, F.col("w") * F.col("v"))).alias("swv"),
        F.count(F.when(usable, F.lit(1))).alias("n"),
    )
    means = first.withColumn("wmean", F.col("swv") / F.col("sw"))
    spread = (
        rows.filter(usable)
        .join(means.select(*keys, "side", "wmean"), [*keys, "side"])
        .groupBy(*keys, "side")
        .agg(F.sum(F.col("w") * F.pow(F.col("v") - F.col("wmean"), 2)).alias("ss"))
    )
    per_side = means.join(spread, [*keys, "side"], "left").withColumn(
        "wsem", F.sqrt(F.col("ss") / F.col("sw")) / F.sqrt("n")
    )
    out = []
    for s in "AB":
        pick = lambda c, s=s: F.max(F.when(F.col("side") == s, F.col(c)))
        out += [
            pick("mean").alias(f"MeanDuration{s}"),
            pick("sem").alias(f"SemDuration{s}"),
            pick("wmean").alias(f"WeightedMeanDuration{s}"),
            pick("wsem").alias(f"WeightedSemDuration{s}"),
            pick("n").alias(f"SampleSize{s}"),
        ]
    return per_side.groupBy(*keys).agg(*out)

