"""Selecting devices, chambers and wells, and laying wells out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutspark.functions.scalars import within
from boutspark.params import WELLS_PER_DEVICE, Params


def signals(rows: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Samples with minutes in (start, end]."""
    return rows.filter(within(F.col("minutes"), start, end))


def well_of(rows: DataFrame, chamber: int, side: str | None = None) -> DataFrame:
    """Rows of one well, named by chamber and, with two wells, by side."""
    chosen = rows.filter(F.col("chamber") == chamber)
    if side is None:
        return chosen
    if side.upper() not in ("A", "B"):
        raise ValueError("side must be 'a' or 'b'")
    return chosen.filter(F.col("side") == side.upper())


def side_of(slot: Column, direction: Column) -> Column:
    """`left` makes the first well of a chamber A, `right` the second one."""
    first_is_a = direction == "left"
    return F.when((slot == 1) == first_is_a, F.lit("A")).otherwise(F.lit("B"))


def seats_from_params(spark: SparkSession, params: Params) -> DataFrame:
    """Chamber, slot, side of every well under shared parameters (at most 12 rows)."""
    rows = [
        (well, chamber, slot)
        for chamber, wells in enumerate(params.chamber_sets, 1)
        for slot, well in enumerate(wells, 1)
    ]
    seats = spark.createDataFrame(rows, "well bigint, chamber bigint, slot int")
    if params.chamber_size == 1:
        return seats.withColumn("side", F.lit(""))
    return seats.withColumn("side", side_of(F.col("slot"), F.lit(params.pi_direction)))


def seats_from_table(settings: DataFrame) -> DataFrame:
    """The same for a parameter table with `chamber_sets` array<array<int>>."""
    keys = [c for c in ("project", "dfm") if c in settings.columns]
    chambers = settings.select(
        *keys,
        "chamber_size",
        "pi_direction",
        F.posexplode("chamber_sets").alias("_c", "_wells"),
    )
    wells = chambers.select(
        *keys,
        "chamber_size",
        "pi_direction",
        (F.col("_c") + 1).cast("bigint").alias("chamber"),
        F.posexplode("_wells").alias("_s", "_well"),
    )
    slot = (F.col("_s") + 1).cast("int")
    return wells.select(
        *keys,
        F.col("_well").cast("bigint").alias("well"),
        "chamber",
        slot.alias("slot"),
        F.when(F.col("chamber_size") == 1, F.lit(""))
        .otherwise(side_of(slot, F.col("pi_direction")))
        .alias("side"),
    )


def seat_samples(rows: DataFrame, seats: DataFrame) -> DataFrame:
    """Give samples their chamber, slot and side; wells outside chambers drop out."""
    keys = [c for c in ("project", "dfm") if c in seats.columns]
    return rows.drop("chamber", "slot", "side").join(seats, [*keys, "well"])


def wells_long(wide: DataFrame, keep: list[str]) -> DataFrame:
    """One row per well and tick from the columns W1..W12."""
    present = [w for w in range(1, WELLS_PER_DEVICE + 1) if f"W{w}" in wide.columns]
    cells = F.array(
        *[
            F.struct(F.lit(w).cast("bigint").alias("well"), F.col(f"W{w}").alias("raw_signal"))
            for w in present
        ]
    )
    return wide.select(*keep, F.inline(cells))
