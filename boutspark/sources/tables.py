"""Recordings derived from the given tables (see FIXTURES.md).

A user of `events` is a well, twelve users a device; the time order of the
user's events is the sample order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutspark.functions.scalars import epoch_micros, well_is_lit
from boutspark.operators.scan import chunk_of, ordered_scan
from boutspark.params import Params

# The parameters that suit this recording (one sample per minute unit).
EVENT_PARAMS = Params(
    chamber_size=2,
    correct_for_dual_feeding=True,
    feeding_threshold=60.0,
    feeding_minimum=20.0,
    tasting_minimum=5.0,
    tasting_maximum=20.0,
    feeding_minevents=1,
    tasting_minevents=1,
    samples_per_second=1.0,
    feeding_event_link_gap=2,
)
EVENT_WINDOW = 11
EXPERIMENT = "events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample of every well, with chamber, side and light state."""
    raw = table(spark, sf_dir, "events")
    events = raw.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        F.floor(epoch_micros(raw, "ts") / 60_000_000).alias("minute"),
    )
    # samples are numbered minute by minute, so even a user with a third of all
    # events is many small pieces, and has at most one carry row per minute
    numbered = ordered_scan(
        events, ["user_id"], ["ts", "event_id"], "minute", sums={"sample": F.lit(1).cast("bigint")}
    )
    dfm = (F.floor(F.col("user_id") / 12) + 1).cast("bigint")
    well = (F.col("user_id") % 12 + 1).cast("bigint")
    rows = numbered.select(
        F.lit(EXPERIMENT).alias("project"),
        dfm.alias("dfm"),
        well.alias("well"),
        F.floor((well - 1) / 2).cast("bigint").alias("_pair"),
        "sample",
        (F.col("sample") - 1).alias("pos"),
        (F.col("sample") - 1).cast("double").alias("minutes"),
        F.col("value").alias("signal"),
        "k",
        "event_type",
        "event_id",
        "ts",
    ).withColumn("chunk", chunk_of("pos"))
    # whole devices are laid out by time chunk, so every later step on a device,
    # a chamber or a well finds its rows together
    rows = rows.repartition("project", "dfm", "chunk")
    # at most twelve wells share a tick
    tick = Window.partitionBy("project", "dfm", "chunk", "pos")
    rows = rows.withColumn("_sum_k", F.sum("k").over(tick))
    odd_well, odd_dfm = F.col("well") % 2 == 1, F.col("dfm") % 2 == 1
    opto = F.when(F.col("pos") % 20 < 10, F.col("_sum_k") * 37 % 4096).otherwise(F.lit(0))
    training = (F.col("well") % 4 == 1) & (F.col("sample") <= 10 + F.col("dfm") % 5)
    return rows.select(
        "project",
        "dfm",
        (F.col("_pair") + 1).alias("chamber"),
        "well",
        F.when(odd_well == odd_dfm, F.lit("A")).otherwise(F.lit("B")).alias("side"),
        F.when(odd_well, F.lit(1)).otherwise(F.lit(2)).alias("slot"),
        "chunk",
        "pos",
        "sample",
        "minutes",
        (F.col("signal") + F.when(training, F.lit(65536.0)).otherwise(F.lit(0.0))).alias("raw_signal"),
        "signal",
        opto.cast("bigint").alias("opto"),
        F.when(F.col("event_type") == "error", F.col("k")).otherwise(F.lit(0)).cast("bigint").alias("error_code"),
        "event_id",
        "ts",
    ).withColumn("lit", well_is_lit(F.col("opto"), F.col("well")))


def event_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chambers of the event recording with their factors and treatment."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    seats = users.select(
        F.lit(EXPERIMENT).alias("project"),
        (F.floor(F.col("user_id") / 12) + 1).cast("bigint").alias("dfm"),
        (F.floor((F.col("user_id") % 12) / 2) + 1).cast("bigint").alias("chamber"),
    ).distinct()
    first_user = (F.col("dfm") - 1) * 12 + (F.col("chamber") - 1) * 2
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        seats.withColumn("c_custkey", first_user)
        .join(customer, "c_custkey", "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            "project",
            "dfm",
            "chamber",
            F.when((F.col("dfm") + F.col("chamber")) % 2 == 0, "Ctrl").otherwise("Exp").alias("Treatment"),
            F.when(F.col("dfm") % 2 == 0, "Male").otherwise("Female").alias("Sex"),
            F.coalesce(F.col("c_mktsegment"), F.lit("")).alias("Segment"),
            F.coalesce(F.col("r_name"), F.lit("")).alias("Region"),
        )
    )


def price_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as a long recording: a supplier is a well, prices the signal.

    Only what the baseline works on; `price_seats` adds what a row tells by itself, so
    that does not travel with the samples.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    # order keys rise along the recording: blocks of them bound the numbering
    items = items.withColumn("block", F.expr("l_orderkey div 65536"))
    numbered = ordered_scan(
        items,
        ["l_suppkey"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        "block",
        sums={"sample": F.lit(1).cast("bigint")},
    )
    return numbered.select(
        F.lit("lineitem").alias("project"),
        (F.floor(F.col("l_suppkey") / 12) + 1).cast("bigint").alias("dfm"),
        (F.col("l_suppkey") % 12 + 1).alias("well"),
        (F.col("sample") - 1).alias("pos"),
        (F.col("l_extendedprice") / 1000.0).alias("signal"),
    ).withColumn("chunk", chunk_of("pos"))


def price_seats(rows: DataFrame) -> DataFrame:
    """Chamber, side, clock and light of rows of `price_signal`; columns that are there stay."""
    place = F.col("well") - 1
    told = {
        "chamber": (F.floor(place / 2) + 1).cast("bigint"),
        "side": F.when(place % 2 == 0, "A").otherwise("B"),
        "slot": (place % 2 + 1).cast("int"),
        "sample": F.col("pos") + 1,
        "minutes": F.col("pos").cast("double"),
        "opto": F.lit(0).cast("bigint"),
        "lit": F.lit(False),
    }
    return rows.withColumns({c: v for c, v in told.items() if c not in rows.columns})


def price_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long recording with all columns of a sample."""
    return price_seats(price_signal(spark, sf_dir))
