"""Ordered computations over recordings of any length.

A window over a whole recording would put the recording into one task. Here
the time axis of every recording is cut into chunks of bounded size. Windows
run inside (keys, chunk); what a chunk needs from earlier or later ones is a
single carry row per chunk, found by a window over chunk totals only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Samples of one well in one chunk. A recording of n samples has n / CHUNK_ROWS
# carry rows, so both levels stay small up to about 10^11 samples per well.
CHUNK_ROWS = 65_536

_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


def chunk_of(pos: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a non-negative position."""
    return F.expr(f"{pos} div {int(chunk_rows)}")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: str = "chunk",
    *,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running columns over `order` within `keys`, in bounded pieces.

    sums   running total up to and including the row
    lags   value of the previous row;  leads  value of the following row
    lasts  latest non-null value up to and including the row
    nexts  first non-null value from the row onwards

    `chunk` must not decrease along `order`, and keys are never null (a
    recording and its wells are always named; one-well chambers have side "").
    """
    sums, lags, leads = sums or {}, lags or {}, leads or {}
    lasts, nexts = lasts or {}, nexts or {}
    here = Window.partitionBy(*keys, chunk).orderBy(*order)
    upto = here.rowsBetween(_FIRST, Window.currentRow)
    onward = here.rowsBetween(Window.currentRow, _LAST)
    rank = F.struct(*order)

    totals, carries, local, final = [], [], {}, {}
    chunks = Window.partitionBy(*keys).orderBy(chunk)
    before = chunks.rowsBetween(_FIRST, -1)
    after = chunks.rowsBetween(1, _LAST)

    for name, col in sums.items():
        t, c = f"_t_{name}", f"_c_{name}"
        totals.append(F.sum(col).alias(t))
        carries.append(F.sum(t).over(before).alias(c))
        local[name] = F.sum(col).over(upto)
        # no earlier chunk (or only nulls there): the local total stands alone
        final[name] = F.when(F.col(c).isNull(), F.col(name)).otherwise(
            F.col(c) + F.coalesce(F.col(name), F.lit(0))
        )
    for name, col in lags.items():
        t, c = f"_t_{name}", f"_c_{name}"
        totals.append(F.max_by(F.struct(col.alias("v")), rank).alias(t))
        carries.append(F.lag(t).over(chunks).alias(c))
        local[name] = F.lag(F.struct(col.alias("v"))).over(here)
        final[name] = F.coalesce(F.col(name), F.col(c))["v"]
    for name, col in leads.items():
        t, c = f"_t_{name}", f"_c_{name}"
        totals.append(F.min_by(F.struct(col.alias("v")), rank).alias(t))
        carries.append(F.lead(t).over(chunks).alias(c))
        local[name] = F.lead(F.struct(col.alias("v"))).over(here)
        final[name] = F.coalesce(F.col(name), F.col(c))["v"]
    for name, col in lasts.items():
        t, c = f"_t_{name}", f"_c_{name}"
        totals.append(F.max_by(col, F.when(col.isNotNull(), rank)).alias(t))
        carries.append(F.last(t, ignorenulls=True).over(before).alias(c))
        local[name] = F.last(col, ignorenulls=True).over(upto)
        final[name] = F.coalesce(F.col(name), F.col(c))
    for name, col in nexts.items():
        t, c = f"_t_{name}", f"_c_{name}"
        totals.append(F.min_by(col, F.when(col.isNotNull(), rank)).alias(t))
        carries.append(F.first(t, ignorenulls=True).over(after).alias(c))
        local[name] = F.first(col, ignorenulls=True).over(onward)
        final[name] = F.coalesce(F.col(name), F.col(c))

    carry = df.groupBy(*keys, chunk).agg(*totals).select(*keys, chunk, *carries)
    kept = [c for c in df.columns if c not in local]
    # spread by chunk even if `df` arrives laid out by its keys alone
    spread = df.repartition(*keys, chunk)
    joined = spread.select(*kept, *[c.alias(n) for n, c in local.items()]).join(
        carry, [*keys, chunk]
    )
    return joined.select(*kept, *[c.alias(n) for n, c in final.items()])


def spread_join(
    df: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    within: str | None = None,
    chunk: Sequence[str] = ("chunk",),
) -> DataFrame:
    """Bring the one row per key of `small` onto `df`, chunk by chunk.

    A plain join sends every row of a key to one task. Here the small side is dealt
    to the chunks its key has in `df`, one row each, and both meet on (keys, chunk):
    no task needs more than one chunk of a key, and rows already laid out that way
    stay where they are. `within` names a further key of few values, such as the
    well of a device: its rows travel as one map per chunk, so the layout stays
    without it. Reads the keys and chunks of `df` a second time. Keys are never
    null, and no (keys, within) repeats in `small`.
    """
    keys, chunk = list(keys), list(chunk)
    values = [c for c in small.columns if c not in keys and c != within]
    dealt = F.struct(*values) if values else F.struct(F.lit(True).alias("_here"))
    if within is None:
        table = small.select(*keys, dealt.alias("_dealt"))
        found = F.col("_dealt")
    else:
        entries = F.collect_list(F.struct(F.col(within).alias("k"), dealt.alias("v")))
        table = small.groupBy(*keys).agg(F.map_from_entries(entries).alias("_dealt"))
        found = F.col("_dealt")[F.col(within)]
    chunks = df.select(*keys, *chunk).distinct()
    joined = df.join(chunks.join(table, keys), [*keys, *chunk], "left" if how == "left" else "inner")
    met = joined.withColumn("_dealt", found)
    if how != "left":
        met = met.filter(F.col("_dealt").isNotNull())
    return met.select(*df.columns, *[F.col("_dealt")[c].alias(c) for c in values])
