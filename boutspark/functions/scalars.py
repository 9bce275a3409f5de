"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw signals above the limit carry the training mark.
TRAINING_LIMIT = 40000
TRAINING_OFFSET = 65536

# Meaning of the eight error bits, lowest first.
ERROR_BITS = (
    "I2C Error",
    "ID Error",
    "PacketType Error",
    "DMA_TX Error",
    "DMA_RX Error",
    "PacketSize Error",
    "AIInterrupt Error",
    "OInterrupt Error",
)


def well_is_lit(opto: Column, well: Column) -> Column:
    """Bit well - 1 of the light word; a missing word means dark."""
    return F.getbit(F.coalesce(opto.cast("bigint"), F.lit(0)), (well - 1).cast("int")) == 1


def error_bit(code: Column, bit: int) -> Column:
    return F.getbit(code.cast("bigint"), F.lit(bit)) == 1


def in_training(raw: Column) -> Column:
    return F.coalesce(raw > TRAINING_LIMIT, F.lit(False))


def without_training_mark(raw: Column) -> Column:
    return F.when(in_training(raw), raw - TRAINING_OFFSET).otherwise(raw)


def preference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null when both are zero."""
    return F.when(a + b > 0, (a - b) / (a + b))


def lick_transform(x: Column) -> Column:
    return F.pow(x, F.lit(0.25))


def within(minutes: Column, start: float | None, end: float | None) -> Column:
    """(start, end]; without a range everything, without an end up to the end."""
    if start is None and end is None:
        return F.lit(True)
    start = 0.0 if start is None else float(start)
    if end is None:
        return minutes > start
    if end <= start:
        raise ValueError("the end of a range must lie after its start")
    return (minutes > start) & (minutes <= float(end))


def standard_error(x: str | Column) -> Column:
    """Sample standard deviation over sqrt(n); null below two values."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def minute_label(edge: Column) -> Column:
    """Whole minutes for labels; infinity reads `end`."""
    return F.when(edge == float("inf"), F.lit("end")).otherwise(edge.cast("bigint").cast("string"))


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970, the same under every session time zone.

    A clock without zone is taken apart into its fields: turning it into an
    instant would shift or fold hours where the session zone changes its clock.
    """
    if not isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_micros(column)
    days = F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = F.hour(column) * 60 + F.minute(column)
    micros = (F.extract(F.lit("SECOND"), F.col(column)) * 1_000_000).cast("bigint")
    return (days * 1440 + minutes) * 60_000_000 + micros
