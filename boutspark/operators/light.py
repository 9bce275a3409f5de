"""Light phases and cumulative series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.functions.scalars import lick_transform, preference, within
from boutspark.operators.scan import CHUNK_ROWS, chunk_of, ordered_scan, spread_join
from boutspark.operators.summary import with_design
from boutspark.params import REC, Settings, value


def light_phases(
    labelled: DataFrame,
    settings: Settings,
    by: Sequence[str] = REC,
    *,
    two_wells: bool = True,
    transform_licks: bool = True,
    design: DataFrame | None = None,
    factors: Sequence[str] = (),
) -> DataFrame:
    """Licks and events of every chamber in light and in dark.

    The phase belongs to the device at that sample (any light bit set), and
    both phases appear for every chamber. Summary ranges do not apply. A
    design adds the treatment and factors of the chambers.
    """
    phase = F.when(F.coalesce(F.col("opto"), F.lit(0)) != 0, "light").otherwise("dark")
    rows = labelled.withColumn("Phase", phase)
    # ticks are bits: wells of a device set the same one, and only bitmaps travel
    ticks = rows.groupBy(*by, "Phase", F.bitmap_bucket_number("pos").alias("_bucket")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("pos"))).alias("_ticks"),
        F.max(value(settings, "samples_per_second")).alias("_sps"),
    )
    seconds = ticks.groupBy(*by, "Phase").agg((F.sum("_ticks") / F.max("_sps")).alias("PhaseSeconds"))
    sides = [("A", "A"), ("B", "B")] if two_wells else [(None, "")]
    counts = []
    for side, suffix in sides:
        here = F.lit(True) if side is None else F.col("side") == side
        counts += [
            F.sum((here & F.col("lick")).cast("bigint")).alias(f"Licks{suffix}"),
            F.sum((here & F.col("bout_head")).cast("bigint")).alias(f"Events{suffix}"),
        ]
    per_phase = rows.groupBy(*by, "chamber", "Phase").agg(*counts)
    grid = (
        labelled.select(*by, "chamber")
        .distinct()
        .withColumn("Phase", F.explode(F.array(F.lit("light"), F.lit("dark"))))
    )
    out = grid.join(seconds, [*by, "Phase"], "left").join(per_phase, [*by, "chamber", "Phase"], "left")
    names = [f"{m}{s}" for _, s in sides for m in ("Licks", "Events")]
    out = out.select(
        *by,
        "chamber",
        "Phase",
        F.coalesce("PhaseSeconds", F.lit(0.0)).alias("PhaseSeconds"),
        *[F.coalesce(F.col(n), F.lit(0).cast("bigint")).alias(n) for n in names],
    )
    for n in names:
        if n.startswith("Licks"):
            x = F.col(n).cast("double")
            out = out.withColumn(n, lick_transform(x) if transform_licks else x)
    return out if design is None else with_design(out, design, factors, by)


def _both_wells(rows: DataFrame, mark: str, by: Sequence[str]) -> DataFrame:
    """Samples of a chamber at which either well has the mark."""
    at = lambda s: F.max(F.when(F.col("side") == s, 1).otherwise(0))
    return (
        rows.filter(mark)
        .groupBy(*by, "chamber", "chunk", "pos")
        .agg(F.min("minutes").alias("Minutes"), at("A").alias("a"), at("B").alias("b"))
    )


def cumulative_pi(
    labelled: DataFrame,
    by: Sequence[str] = REC,
    start: float | None = None,
    end: float | None = None,
) -> DataFrame:
    """Preference and lick total so far, at every lick of either well."""
    rows = _both_wells(labelled.filter(within(F.col("minutes"), start, end)), "lick", by)
    keys = [*by, "chamber"]
    so_far = ordered_scan(rows, keys, ["pos"], sums={"_a": F.col("a"), "_b": F.col("b")})
    return so_far.select(
        *keys,
        "pos",
        "Minutes",
        preference(F.col("_a"), F.col("_b")).alias("PI"),
        (F.col("_a") + F.col("_b")).alias("Licks"),
    )


def cumulative_event_pi(
    labelled: DataFrame,
    by: Sequence[str] = REC,
    events_limit: int | None = None,
    start: float | None = None,
    end: float | None = None,
) -> DataFrame:
    """The same by bouts; `EventNum` counts them, optionally only the first n."""
    rows = _both_wells(labelled.filter(within(F.col("minutes"), start, end)), "bout_head", by)
    keys = [*by, "chamber"]
    so_far = ordered_scan(
        rows,
        keys,
        ["pos"],
        sums={"_a": F.col("a"), "_b": F.col("b"), "EventNum": F.lit(1).cast("bigint")},
    )
    out = so_far.select(
        *keys, "pos", "Minutes", preference(F.col("_a"), F.col("_b")).alias("PI"), "EventNum"
    )
    return out if events_limit is None else out.filter(F.col("EventNum") <= events_limit)


def cumulative_licks(
    labelled: DataFrame,
    bouts: DataFrame,
    by: Sequence[str] = REC,
    *,
    start: float | None = None,
    end: float | None = None,
    transform_licks: bool = True,
) -> DataFrame:
    """Licks so far at every bout start of a well.

    A well without bouts gets two zero points, at its first and last minute.
    """
    keys = [*by, "chamber", "well"]
    chosen = bouts.filter(within(F.col("Minutes"), start, end)).select(
        *keys, "chunk", F.col("start").alias("pos"), "Minutes", "Licks"
    )
    so_far = ordered_scan(chosen, keys, ["pos"], sums={"CumLicks": F.col("Licks")})
    y = F.col("CumLicks").cast("double")
    points = so_far.select(
        *keys, "pos", "Minutes", (lick_transform(y) if transform_licks else y).alias("CumLicks")
    )
    span = (
        labelled.filter(within(F.col("minutes"), start, end))
        .groupBy(*keys)
        .agg(
            F.min(F.struct("pos", F.col("minutes").alias("Minutes"))).alias("first"),
            F.max(F.struct("pos", F.col("minutes").alias("Minutes"))).alias("last"),
        )
    )
    empty = span.join(chosen.select(*keys).distinct(), keys, "left_anti")
    zeros = empty.select(
        *keys, F.inline(F.array("first", "last")), F.lit(0.0).alias("CumLicks")
    )
    return points.unionByName(zeros)


def light_marks(
    labelled: DataFrame,
    curve: DataFrame,
    by: Sequence[str] = REC,
    *,
    start: float | None = None,
    end: float | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Height of the cumulative curve at every lit sample of a well.

    Linear between the neighbouring points, level beyond both ends. Points and
    lit samples are ordered together; each sample sees the point before and the
    point after it.
    """
    keys = [*by, "chamber", "well"]
    point = F.struct(F.col("Minutes").alias("x"), F.col("CumLicks").alias("y"))
    many = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(*keys)
    points = curve.select(*keys, "pos", point.alias("_p"))
    lit = labelled.filter(within(F.col("minutes"), start, end) & F.col("lit")).select(
        *keys, "pos", F.col("minutes").alias("Minutes")
    )
    marked = (
        points.withColumn("_mark", F.lit(0))
        .unionByName(lit.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
        .withColumn("chunk", chunk_of("pos", chunk_rows))
    )
    rows = spread_join(marked, many, keys)
    near = ordered_scan(
        rows,
        keys,
        ["pos", "_mark"],
        lasts={"_left": F.col("_p")},
        nexts={"_right": F.col("_p")},
    )
    left, right = F.col("_left"), F.col("_right")
    share = (F.col("Minutes") - left["x"]) / (right["x"] - left["x"])
    height = (
        F.when(left.isNull(), right["y"])
        .when(right.isNull() | (right["x"] == left["x"]), left["y"])
        .otherwise(left["y"] + (right["y"] - left["y"]) * share)
    )
    return near.filter("_mark = 1").select(*keys, "pos", "Minutes", height.alias("CumLicks"))
