"""Progressive-ratio recordings: training, transitions, breaking points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.functions.scalars import in_training
from boutspark.operators.scan import ordered_scan, spread_join
from boutspark.params import REC

# Per wiring, the wells whose training mark ends the training of
# wells 1-4, 5-8 and 9-12.
REFERENCE_WELLS = {
    1: (1, 5, 9),
    2: (3, 7, 11),
    3: (2, 6, 10),
    4: (4, 8, 12),
}


def training_end(samples: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Last minute and sample in training per well, null when never in it."""
    marked = in_training(F.col("raw_signal"))
    return samples.groupBy(*by, "well").agg(
        F.max(F.when(marked, F.col("minutes"))).alias("Minutes"),
        F.max(F.when(marked, F.col("sample"))).alias("Sample"),
    )


def _reference(well: Column, wiring: int) -> Column:
    if wiring not in REFERENCE_WELLS:
        raise ValueError("wiring must be 1, 2, 3 or 4")
    first, second, third = REFERENCE_WELLS[wiring]
    return F.when(well <= 4, first).when(well <= 8, second).otherwise(third).cast("bigint")


def light_transitions(
    rows: DataFrame, keys: Sequence[str], flag: str = "lit", after: Column | None = None
) -> DataFrame:
    """Rows whose flag differs from that of the row before; never the first.

    With `after`, only rows with minutes above it exist.
    """
    floor = F.lit(float("-inf")) if after is None else after
    scanned = ordered_scan(
        rows,
        keys,
        ["pos"],
        lags={"_was": F.struct(F.col(flag).alias("flag"), F.col("minutes").alias("minutes"))},
    )
    was = F.col("_was")
    return scanned.filter(
        was.isNotNull() & (was["minutes"] > floor) & (F.col(flag) != was["flag"])
    ).drop("_was")


def breaking_points(
    labelled: DataFrame,
    ends: DataFrame | None,
    wiring: int | None = None,
    by: Sequence[str] = REC,
) -> DataFrame:
    """Every switch to light after training, with the change since the last switch.

    The change runs from whichever transition came before, so at a switch to
    light it covers the dark stretch. Licks count from the start of loading.
    `ends` is the table of `training_end`; `wiring` chooses the reference wells,
    without it each well has its own end. A well never in training starts at 0.
    """
    keys = [*by, "well"]
    rows = labelled.select(*keys, "chunk", "pos", "minutes", "lit", "lick")
    if ends is None:
        rows = rows.withColumn("_end", F.lit(0.0))
    else:
        ref = F.col("well") if wiring is None else _reference(F.col("well"), wiring)
        table = ends.select(*by, F.col("well").alias("_ref"), F.col("Minutes").alias("_end"))
        rows = (
            rows.withColumn("_ref", ref)
            .transform(lambda df: spread_join(df, table, by, "left", within="_ref"))
            .withColumn("_end", F.coalesce("_end", F.lit(0.0)))
            .drop("_ref")
        )
    scanned = ordered_scan(
        rows,
        keys,
        ["pos"],
        sums={"CumLicks": F.col("lick").cast("bigint")},
        lags={"_was": F.struct("lit", "minutes")},
    )
    was = F.col("_was")
    switches = scanned.filter(
        was.isNotNull() & (was["minutes"] > F.col("_end")) & (F.col("lit") != was["lit"])
    ).drop("_was")
    deltas = ordered_scan(
        switches, keys, ["pos"], lags={"_before": F.struct("minutes", "CumLicks")}
    )
    before = F.col("_before")
    return deltas.filter("lit").select(
        *keys,
        "pos",
        F.col("minutes").alias("Minutes"),
        F.col("lit").alias("Lights"),
        "CumLicks",
        F.coalesce(F.col("minutes") - before["minutes"], F.lit(0.0)).alias("DeltaMinutes"),
        F.coalesce(F.col("CumLicks") - before["CumLicks"], F.lit(0)).alias("DeltaLicks"),
    )


def breaking_table(points: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Trials, last and largest lick change per well."""
    return points.groupBy(*by, "well").agg(
        F.count(F.lit(1)).alias("Trials"),
        F.max_by("DeltaLicks", "pos").alias("LastDeltaLicks"),
        F.max("DeltaLicks").alias("MaxDeltaLicks"),
    )
