"""Exact medians of groups that may be very large.

The built-in `median` keeps one counter per distinct value of a group. That is
bounded for run lengths (n samples hold at most about sqrt(2n) different ones)
but not for signals, which go through `group_median`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutspark.staging import stage

# Steps of the value axis per doubling: fine near zero, and at most about a
# million steps for all finite numbers, so step totals of a group stay small.
STEPS_PER_DOUBLING = 512
# Digits of a later round, and values of a group that may be put in order.
DIGITS = 1024
ORDERED = 10_000
# Groups up to which the ranges still open are sent to all tasks (some 60 MB).
SENT_GROUPS = 500_000


def _step(v: Column) -> Column:
    """A step number that never falls as v rises."""
    size = F.floor(F.log2(F.abs(v) + 1.0) * STEPS_PER_DOUBLING)
    return F.when(v < 0, -size).otherwise(size)


def _digit() -> Column:
    """Place of a value between the least and the greatest one still open; the two always differ."""
    share = (F.col("_v") - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))
    return F.least(F.floor(share * DIGITS), F.lit(DIGITS - 1).cast("bigint"))


def _narrowed(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The median of every group, or the one digit that holds both middle ranks.

    Only counts and extremes of digits leave a task. Two middle ranks in
    different digits are the greatest value of one and the least of the other.
    """
    ranks = [c for c in ("_lo", "_hi") if c in binned.columns]
    digits = binned.groupBy(*keys, *ranks, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx")
    )
    if not ranks:
        total = F.sum("_n").over(Window.partitionBy(*keys))
        digits = digits.withColumn("_total", total).withColumns(
            {"_lo": F.expr("(_total + 1) div 2"), "_hi": F.expr("_total div 2 + 1")}
        )
    along = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    middle = digits.withColumn("_upto", F.sum("_n").over(along)).where("_upto >= _lo and _upto - _n < _hi")
    ends = F.struct("_bin", "_mn", "_mx", "_n", (F.col("_upto") - F.col("_n")).alias("before"), "_lo", "_hi")
    folded = middle.groupBy(*keys).agg(F.min(ends).alias("a"), F.max(ends).alias("b"))
    known = (F.col("a._bin") != F.col("b._bin")) | (F.col("a._mn") == F.col("a._mx"))
    return folded.select(
        *keys,
        F.when(known, (F.col("a._mx") + F.col("b._mn")) / 2).alias("_value"),
        F.col("a._mn").alias("_mn"),
        F.col("a._mx").alias("_mx"),
        (F.col("a._lo") - F.col("a.before")).alias("_lo"),
        (F.col("a._hi") - F.col("a.before")).alias("_hi"),
        F.col("a._n").alias("_n"),
    )


def _inside(values: DataFrame, ranges: DataFrame, groups: int, keys: Sequence[str]) -> DataFrame:
    side = ranges.select(*keys, "_mn", "_mx", "_lo", "_hi")
    side = F.broadcast(side) if groups <= SENT_GROUPS else side
    return values.join(side, list(keys)).where("_v between _mn and _mx")


def _ordered(inside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians of what is left of groups, at most `ORDERED` values each."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))
    middle = inside.withColumn("_rank", rank).where("_rank = _lo or _rank = _hi")
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias("_value"))


def group_median(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Exact median of `column` per group; keys, `out`.

    Radix selection, all groups side by side: a round counts the values of
    every digit (steps of the value axis first, then equal parts of what is
    open), and only the digit of the middle ranks goes on. Values are put in
    order only where few are left, so a group of any size, however close its
    values, never meets in one task.
    """
    v = F.col(column)
    values = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.cast("double").alias("_v"))
    values = values.filter(" and ".join(f"`{k}` is not null" for k in keys))
    state = stage(_narrowed(values.withColumn("_bin", _step(F.col("_v"))), keys), "digits")
    found = None
    while True:
        few = (F.col("_n") <= ORDERED) & F.col("_value").isNull()
        many = (F.col("_n") > ORDERED) & F.col("_value").isNull()
        n_few, n_many = state.agg(F.count(F.when(few, 1)), F.count(F.when(many, 1))).first()
        done = state.where("_value is not null").select(*keys, "_value")
        if n_few:
            done = done.unionByName(_ordered(_inside(values, state.where(few), n_few, keys), keys))
        found = done if found is None else found.unionByName(done)
        if not n_many:
            break
        inside = stage(_inside(values, state.where(many), n_many, keys), "open")
        state = stage(_narrowed(inside.withColumn("_bin", _digit()), keys), "digits")
        values = inside.select(*keys, "_v")
    return found.withColumnRenamed("_value", out)
