"""Bouts and the gaps between them, one row each, with their measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.operators.detect import tasting_runs
from boutspark.operators.scan import CHUNK_ROWS, chunk_of, ordered_scan
from boutspark.params import REC, Settings, carried, value

MEASURES = (
    "Minutes",
    "Licks",
    "Duration",
    "TotalIntensity",
    "AvgIntensity",
    "MinIntensity",
    "MaxIntensity",
    "VarIntensity",
)


def _seat(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [*by, *[c for c in ("chamber", "side", "slot") if c in df.columns], "well"]


def feeding_bouts(labelled: DataFrame, settings: Settings, by: Sequence[str] = REC) -> DataFrame:
    """One row per linked bout; bridged gap samples count into every measure.

    Samples are summed before the shuffle, so a bout of any length is safe.
    """
    keys = [*_seat(labelled, by), *carried(settings, "samples_per_second")]
    bouts = (
        labelled.filter(F.col("bout").isNotNull())
        .groupBy(*keys, F.col("bout").alias("start"))
        .agg(
            F.min_by("minutes", "pos").alias("Minutes"),
            F.count(F.lit(1)).alias("Licks"),
            F.sum("base").alias("TotalIntensity"),
            F.avg("base").alias("AvgIntensity"),
            F.min("base").alias("MinIntensity"),
            F.max("base").alias("MaxIntensity"),
            F.var_samp("base").alias("VarIntensity"),
        )
    )
    return bouts.withColumn(
        "Duration", F.col("Licks") / value(settings, "samples_per_second")
    ).withColumn("chunk", chunk_of("start"))


def tasting_bouts(labelled: DataFrame, settings: Settings, by: Sequence[str] = REC) -> DataFrame:
    """One row per tasting event, shaped like a feeding bout."""
    runs = tasting_runs(labelled, settings, by)
    return runs.select(
        *_seat(runs, by),
        "start",
        F.col("minutes").alias("Minutes"),
        F.col("length").alias("Licks"),
        F.col("total").alias("TotalIntensity"),
        F.col("mean").alias("AvgIntensity"),
        F.col("low").alias("MinIntensity"),
        F.col("high").alias("MaxIntensity"),
        F.col("variance").alias("VarIntensity"),
        (F.col("length") / value(settings, "samples_per_second")).alias("Duration"),
    ).withColumn("chunk", chunk_of("start"))


def _false_runs(
    labelled: DataFrame,
    true_head: str,
    false_head: str,
    settings: Settings,
    by: Sequence[str],
    chunk_rows: int,
) -> DataFrame:
    """Runs of FALSE from the first samples of TRUE and FALSE runs only."""
    keys = [*_seat(labelled, by), *carried(settings, "samples_per_second")]
    heads = labelled.filter(F.col(true_head) | F.col(false_head)).select(
        *keys, "pos", "minutes", "sample", F.col(false_head).alias("_rest")
    )
    # a closing row after the last sample bounds the final run
    closing = labelled.groupBy(*keys).agg((F.max("pos") + 1).alias("pos"))
    ends = heads.unionByName(
        closing.withColumn("_rest", F.lit(False)), allowMissingColumns=True
    ).withColumn("chunk", chunk_of("pos", chunk_rows))
    scanned = ordered_scan(ends, keys, ["pos"], leads={"_stop": F.col("pos")})
    return scanned.filter("_rest").select(
        *keys,
        "pos",
        F.col("minutes").alias("Minutes"),
        F.col("sample").alias("Sample"),
        ((F.col("_stop") - F.col("pos")) / value(settings, "samples_per_second")).alias("IntervalSec"),
    )


def feeding_intervals(
    labelled: DataFrame, settings: Settings, by: Sequence[str] = REC, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Gaps between linked bouts, with those before the first and after the last."""
    return _false_runs(labelled, "bout_head", "gap_head", settings, by, chunk_rows)


def tasting_intervals(
    labelled: DataFrame, settings: Settings, by: Sequence[str] = REC, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rests between unlinked feeding licks, kept under the tasting name."""
    return _false_runs(labelled, "lick_head", "rest_head", settings, by, chunk_rows)


def tidy_bouts(
    bouts: DataFrame,
    design: DataFrame,
    factors: Sequence[str] = (),
    well_names: Mapping[str, str] | None = None,
    by: Sequence[str] = REC,
) -> DataFrame:
    """One line per bout with treatment, well label and factor columns."""
    label: Column = F.coalesce(F.col("side"), F.lit("")) if "side" in bouts.columns else F.lit("")
    friendly = label
    for side, name in (well_names or {}).items():
        friendly = F.when(label == side, F.lit(name)).otherwise(friendly)
    joined = bouts.join(design.select(*by, "chamber", "Treatment", *factors), [*by, "chamber"], "left")
    return joined.select(
        *by,
        "chamber",
        "well",
        label.alias("WellLabel"),
        friendly.alias("WellName"),
        F.coalesce("Treatment", F.lit("")).alias("Treatment"),
        F.col("Minutes").alias("StartMin"),
        "Licks",
        "Duration",
        "AvgIntensity",
        "MaxIntensity",
        *[F.coalesce(f, F.lit("")).alias(f) for f in factors],
    )


def bout_transitions(
    bouts: DataFrame, chambers: DataFrame, by: Sequence[str] = REC
) -> DataFrame:
    """Counts of A-A, A-B, B-A, B-B successions per chamber, zeros kept.

    Bouts of both wells are ordered by start; at equal starts A comes first.
    """
    keys = [*by, "chamber"]
    steps = ordered_scan(
        bouts.select(*keys, "start", "side", "chunk"),
        keys,
        ["start", "side"],
        lags={"FromWell": F.col("side")},
    )
    counts = (
        steps.filter(F.col("FromWell").isNotNull())
        .groupBy(*keys, "FromWell", F.col("side").alias("ToWell"))
        .agg(F.count(F.lit(1)).alias("Count"))
    )
    sides = F.array(F.lit("A"), F.lit("B"))
    grid = (
        chambers.select(*keys)
        .distinct()
        .withColumn("FromWell", F.explode(sides))
        .withColumn("ToWell", F.explode(sides))
    )
    return grid.join(counts, [*keys, "FromWell", "ToWell"], "left").withColumn(
        "Count", F.coalesce("Count", F.lit(0).cast("bigint"))
    )


def event_number_bins(
    bouts: DataFrame, size: int, by: Sequence[str] = REC
) -> DataFrame:
    """Summary of every `size` consecutive bouts of a chamber."""
    keys = [*by, "chamber"]
    numbered = ordered_scan(
        bouts, keys, ["start", "side"], sums={"_nr": F.lit(1).cast("bigint")}
    ).withColumn("EventBin", F.expr(f"(_nr - 1) div {int(size)}"))
    in_side = lambda s, c: F.when(F.col("side") == s, c)
    return numbered.groupBy(*keys, "EventBin").agg(
        F.min("Minutes").alias("FirstMin"),
        F.max("Minutes").alias("LastMin"),
        F.count(in_side("A", F.lit(1))).alias("EventsA"),
        F.count(in_side("B", F.lit(1))).alias("EventsB"),
        F.coalesce(F.sum(in_side("A", F.col("Licks"))), F.lit(0)).alias("LicksA"),
        F.coalesce(F.sum(in_side("B", F.col("Licks"))), F.lit(0)).alias("LicksB"),
        F.avg("Duration").alias("MeanDuration"),
    )
