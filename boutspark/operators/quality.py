"""Quality checks of recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.functions.scalars import ERROR_BITS, epoch_micros, error_bit
from boutspark.operators.scan import ordered_scan
from boutspark.params import REC, WELLS_PER_DEVICE
from boutspark.staging import stage


def data_breaks(
    ticks: DataFrame,
    keys: Sequence[str],
    samples_per_second: float,
    multiplier: float = 4.0,
    seconds: str = "seconds",
) -> DataFrame:
    """Rows that follow the previous one by more than `multiplier` sample steps.

    `Index` counts rows from 1; the first row never is a break.
    """
    scanned = ordered_scan(ticks, keys, ["pos"], lags={"_before": F.col(seconds)})
    interval = F.col(seconds) - F.col("_before")
    return (
        scanned.withColumn("Interval", interval)
        .filter(F.col("Interval") > F.lit(float(multiplier) / float(samples_per_second)))
        .withColumn("Index", F.col("pos") + 1)
        .drop("_before")
    )


def first_breaks(breaks: DataFrame, keys: Sequence[str], count: int = 10) -> DataFrame:
    """The first `count` breaks of every recording."""
    numbered = ordered_scan(breaks, keys, ["pos"], sums={"BreakNr": F.lit(1).cast("bigint")})
    return numbered.filter(F.col("BreakNr") <= count)


def error_counts(rows: DataFrame, keys: Sequence[str], code: str = "error_code") -> DataFrame:
    """How often each named bit is set among rows with a code other than 0."""
    c = F.col(code)
    flagged = c.isNotNull() & (c != 0)
    bits = [
        F.sum(F.when(flagged & error_bit(c, i), 1).otherwise(0)).alias(f"b{i}")
        for i in range(len(ERROR_BITS))
    ]
    per_key = rows.groupBy(*keys).agg(
        F.sum(flagged.cast("bigint")).alias("Flagged"), F.count(c).alias("NonNull"), *bits
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("ErrorType"), F.col(f"b{i}").alias("Count"))
            for i, name in enumerate(ERROR_BITS)
        ]
    )
    return per_key.select(*keys, "NonNull", "Flagged", F.inline(pairs))


def _present(text: Column) -> Column:
    """An entry of an error column without outer blanks; null if nothing is left."""
    return F.when(F.trim(text) != "", F.trim(text))


def _is_flag(text: Column) -> Column:
    """A number is a flag unless it is 0, a word unless it is "na"."""
    number = text.try_cast("double")
    return F.when(number.isNotNull(), number != 0).otherwise(text.isNotNull() & (F.lower(text) != "na"))


def error_columns(rows: DataFrame, keys: Sequence[str], errors: str = "errors") -> DataFrame:
    """Present, missing and flagged entries of every error column (a map of names to text).

    A number is flagged unless it is 0, a word unless it is "0" or "na"; the bits of
    flagged whole numbers are counted by name.
    """
    entries = rows.select(*keys, F.explode(errors).alias("Column", "_text"))
    entries = entries.withColumn("_text", _present(F.col("_text")))
    code = F.expr("try_cast(_text as bigint)")
    flagged = _is_flag(F.col("_text"))
    entries = entries.withColumn("_flagged", flagged).withColumn("_code", F.when(F.col("_flagged"), code))
    return entries.groupBy(*keys, "Column").agg(
        F.count("_text").alias("NonMissing"),
        (F.count(F.lit(1)) - F.count("_text")).alias("Missing"),
        F.sum(F.col("_flagged").cast("bigint")).alias("Flagged"),
        *[
            F.sum(F.coalesce(error_bit(F.col("_code"), i), F.lit(False)).cast("bigint")).alias(name)
            for i, name in enumerate(ERROR_BITS)
        ],
    )


def device_ticks(samples: DataFrame, seconds: str = "seconds", by: Sequence[str] = REC) -> DataFrame:
    """One row per device and position from the rows of its wells, which share a clock."""
    return samples.groupBy(*by, "chunk", "pos").agg(F.min(seconds).alias(seconds))


def integrity(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    clock: str | None = "ts",
    index: str | None = "sample",
    code: str | None = "error_code",
    errors: str | None = None,
) -> DataFrame:
    """Rows, start, end, elapsed minutes, flagged rows, index steps of one each.

    With `errors`, a map of error columns, a row is flagged if any of them is.
    """
    if index:
        rows = ordered_scan(rows, keys, ["pos"], lags={"_index": F.col(index)})
    aggs = [
        F.count(F.lit(1)).alias("Rows"),
        F.when(F.count(F.lit(1)) > 1, F.max("minutes") - F.min("minutes")).alias("ElapsedFromMinutes"),
    ]
    if clock:
        aggs += [
            F.min_by(clock, "pos").alias("StartTime"),
            F.max_by(clock, "pos").alias("EndTime"),
        ]
    if errors:
        entries = F.coalesce(F.map_values(errors), F.array().cast("array<string>"))
        any_flag = F.exists(entries, lambda x: F.coalesce(_is_flag(_present(x)), F.lit(False)))
        aggs.append(F.sum(any_flag.cast("bigint")).alias("Flagged"))
    elif code:
        aggs.append(
            F.sum((F.coalesce(F.col(code), F.lit(0)) != 0).cast("bigint")).alias("Flagged")
        )
    if index:
        # an unreadable index breaks the chain; fewer than two cannot be judged
        step = F.coalesce(F.col(index) - F.col("_index") == 1, F.col("pos") == 0)
        aggs.append(
            F.when(F.count(index) >= 2, F.bool_and(step)).alias("IndexByOne")
        )
    out = rows.groupBy(*keys).agg(*aggs)
    if clock:
        span = epoch_micros(out, "EndTime") - epoch_micros(out, "StartTime")
        out = out.withColumn("Elapsed", span / 60e6)
    return out


def overview(rows: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Rows and minutes covered per device; without a device (null) of all."""
    per_device = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("Rows"),
        F.min("minutes").alias("FirstMin"),
        F.max("minutes").alias("LastMin"),
    )
    outer = [c for c in by if c != "dfm"]
    return per_device.groupingSets([list(by), outer], *by).agg(
        F.sum("Rows").alias("Rows"),
        F.min("FirstMin").alias("FirstMin"),
        F.max("LastMin").alias("LastMin"),
    )


def design_table(design: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Chambers per treatment and device."""
    return design.groupBy("Treatment", *by).agg(
        F.count(F.lit(1)).alias("Chambers"),
        F.array_join(F.array_sort(F.collect_set("chamber")), ",").alias("ChamberList"),
    )


def mask_histogram(samples: DataFrame, cutoff: float, by: Sequence[str] = REC) -> DataFrame:
    """Ticks of a device by the set of wells above the cut-off, with sums of every well.

    A tick's twelve wells become one mask of bits (well 1 is bit 0), so a device of any
    length leaves at most 4,096 rows: mask, Ticks, and S<well> and N<well>, the sum and
    number of the values of each well at those ticks. Wells side by side is the only
    shuffle of samples; the histogram is summed in the tasks before it moves.
    """
    wells = range(1, WELLS_PER_DEVICE + 1)
    ticks = samples.groupBy(*by, "chunk", "pos").agg(
        *[F.max(F.when(F.col("well") == w, F.col("base"))).alias(f"W{w}") for w in wells]
    )
    mask = F.lit(0)
    for w in wells:
        mask = mask + F.when(F.col(f"W{w}") > cutoff, F.lit(1 << (w - 1))).otherwise(F.lit(0))
    return ticks.withColumn("mask", mask).groupBy(*by, "mask").agg(
        F.count(F.lit(1)).alias("Ticks"),
        *[F.sum(f"W{w}").alias(f"S{w}") for w in wells],
        *[F.count(f"W{w}").alias(f"N{w}") for w in wells],
    )


def bleeding_matrix(
    samples: DataFrame, cutoff: float, by: Sequence[str] = REC
) -> tuple[DataFrame, DataFrame]:
    """Mean of every well while well i is above the cut-off; and overall means.

    Both come from one staged histogram of masks; no tick is copied per well. A well
    that never is above the cut-off responds with 0; a well without any value has no
    overall mean.
    """
    wells = range(1, WELLS_PER_DEVICE + 1)
    seen = stage(mask_histogram(samples, cutoff, by), "masks")
    signal = F.col("signal_well")
    each = seen.withColumn("signal_well", F.explode(F.array(*[F.lit(w) for w in wells])))
    above = F.col("mask").bitwiseAND(F.expr("shiftleft(1, signal_well - 1)")) != 0
    mean = lambda w, c: F.sum(F.when(c, F.col(f"S{w}"))) / F.sum(F.when(c, F.col(f"N{w}")))
    matrix = each.groupBy(*by, "signal_well").agg(
        *[F.coalesce(mean(w, above & (F.col(f"N{w}") > 0)), F.lit(0.0)).alias(f"W{w}Resp") for w in wells]
    )
    matrix = matrix.select(
        *by,
        F.concat(F.lit("W"), signal.cast("string"), F.lit("Sig")).alias("Signal"),
        *[f"W{w}Resp" for w in wells],
    )
    means = F.array(
        *[F.struct(F.lit(w).alias("well"), mean(w, F.col(f"N{w}") > 0).alias("MeanBase")) for w in wells]
    )
    overall = seen.groupBy(*by).agg(means.alias("_means")).select(*by, F.inline("_means"))
    return matrix, overall.where("MeanBase is not null")


def qc_table(
    integrity_rows: DataFrame,
    breaks: DataFrame,
    shared: DataFrame | None = None,
    bleeding: DataFrame | None = None,
    by: Sequence[str] = REC,
) -> DataFrame:
    """One row per device: integrity, breaks, shared licks, strongest bleeding."""
    counts = breaks.groupBy(*by).agg(F.count(F.lit(1)).alias("Breaks"))
    out = integrity_rows.join(counts, list(by), "left").withColumn(
        "Breaks", F.coalesce("Breaks", F.lit(0).cast("bigint"))
    )
    if shared is not None:
        out = out.join(
            shared.groupBy(*by).agg(
                F.sum("Both").alias("SharedLicks"),
                F.max("MaxMinSignalAtBoth").alias("MaxMinSignalAtBoth"),
            ),
            list(by),
            "left",
        )
    if bleeding is not None:
        others: list[Column] = []
        for w in range(1, WELLS_PER_DEVICE + 1):
            others.append(F.when(F.col("Signal") != f"W{w}Sig", F.col(f"W{w}Resp")))
        strongest = F.greatest(*others)
        out = out.join(
            bleeding.groupBy(*by).agg(F.max(strongest).alias("StrongestResponse")), list(by), "left"
        )
    return out
