"""Feeding and tasting contacts: from baselined samples to labelled samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutspark.operators.baseline import fixed_levels, with_thresholds
from boutspark.operators.runs import flag_runs, link_runs, spread_over_chunks, surviving_runs
from boutspark.operators.scan import CHUNK_ROWS, chunk_of
from boutspark.params import REC, Settings, attach, carried, corrects_dual_feeding, value
from boutspark.staging import stage


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def feeding_runs(
    samples: DataFrame,
    settings: Settings,
    by: Sequence[str] = REC,
    level: str = "base",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Runs above the lower level that reach the upper one, long enough."""
    keys = [*by, "well", *carried(settings, "feeding_minevents", "feeding_event_link_gap")]
    runs = flag_runs(
        samples,
        _holds(F.col(level) > F.col("feeding_min")),
        keys,
        confirm=F.col(level) > F.col("feeding_max"),
        chunk_rows=chunk_rows,
    )
    return surviving_runs(runs, value(settings, "feeding_minevents"))


def _span_marks(runs: DataFrame, keys: Sequence[str], kind: str, chunk_rows: int) -> DataFrame:
    """A marker row in every chunk that a run, or the sample after it, touches."""
    spread = spread_over_chunks(runs.select(*keys, "start", "end"), chunk_rows, beyond=1)
    return spread.select(*keys, "chunk", "pos", F.struct("start", "end").alias(kind))


def _with_marks(
    samples: DataFrame, marks: dict[str, DataFrame], by: Sequence[str]
) -> DataFrame:
    """Samples with the latest marker of every kind at or before them.

    Markers join the stream as rows and are carried forward inside chunks, so
    no range join is needed and the work stays linear in the samples.
    """
    rows = samples.withColumn("_row", F.lit(1))
    for mark in marks.values():
        rows = rows.unionByName(mark.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    # one layout for the whole device, so wells of a chamber stay together
    rows = rows.repartition(*by, "chunk")
    here = Window.partitionBy(*by, "well", "chunk").orderBy("pos", "_row")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({k: F.last(k, ignorenulls=True).over(upto) for k in marks})
    return rows.filter(F.col("_row") == 1).drop("_row")


def label_contacts(
    samples: DataFrame,
    runs: DataFrame,
    settings: Settings,
    by: Sequence[str] = REC,
    chunk_rows: int = CHUNK_ROWS,
    before: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Label every sample from the surviving runs.

    lick        in a surviving run (gaps between linked runs do not count)
    bout        position where its linked bout starts, null outside
    *_head      first sample of a lick run / rest / bout / gap between bouts
    taste       between the tasting levels and not a feeding lick

    `before` holds markers of the detection before correction, see `detect`.
    """
    keys = [*by, "well"]
    carry = carried(settings, "feeding_event_link_gap")
    linked = link_runs(runs, [*keys, *carry], value(settings, "feeding_event_link_gap"))
    marks = {
        "_run": _span_marks(runs, keys, "_run", chunk_rows),
        "_bout": _span_marks(linked, keys, "_bout", chunk_rows),
        **(before or {}),
    }
    # levels that the settings tell need not travel
    levels = fixed_levels(settings) or {}
    rows = _with_marks(samples.drop(*levels), marks, by).withColumns(levels)
    pos, run, bout, base = F.col("pos"), F.col("_run"), F.col("_bout"), F.col("base")
    rows = rows.withColumns(
        {
            "lick": _holds(pos <= run["end"]),
            "lick_head": _holds(pos == run["start"]),
            "bout": F.when(pos <= bout["end"], bout["start"]),
            "bout_head": _holds(pos == bout["start"]),
        }
    )
    between = (base > F.col("tasting_min")) & (base < F.col("tasting_max"))
    rows = rows.withColumns(
        {
            "rest_head": _holds(pos == run["end"] + 1) | ((pos == 0) & ~F.col("lick")),
            "gap_head": _holds(pos == bout["end"] + 1) | ((pos == 0) & F.col("bout").isNull()),
            "taste": _holds(between) & ~F.col("lick"),
        }
    )
    if before:
        rows = rows.withColumns(
            {
                "lick_before": _holds(pos <= F.col("_first")["end"]),
                "dual": _holds(pos == F.col("_dual")),
            }
        )
    return rows.drop(*marks)


def zero_weaker_contact(licked: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Where both wells of a chamber are licked at once, the weaker reads 0.

    Adds `corrected` (the level to detect on again) and `dual` (both licked);
    equal signals are both set to 0. `base` itself stays as it is.
    """
    pair = Window.partitionBy(*by, "chunk", "chamber", "pos")
    contact = F.when(F.col("lick"), F.col("base"))
    return (
        licked.withColumns(
            {
                "dual": F.count(contact).over(pair) == 2,
                "_top": F.max(contact).over(pair),
                "_low": F.min(contact).over(pair),
            }
        )
        .withColumn("dual", F.col("dual") & F.col("lick"))
        .withColumn(
            "corrected",
            F.when(
                F.col("dual") & ((F.col("base") < F.col("_top")) | (F.col("_top") == F.col("_low"))),
                F.lit(0.0),
            ).otherwise(F.col("base")),
        )
        .drop("_top", "_low")
    )


def detect(
    samples: DataFrame,
    settings: Settings,
    by: Sequence[str] = REC,
    *,
    chunk_rows: int = CHUNK_ROWS,
    staged: bool = True,
) -> DataFrame:
    """Baselined samples -> labelled samples, staged once for all consumers.

    With dual-feeding correction contacts are found twice. Correction can only
    touch samples above the lower level, so the first detection and the pairing
    of wells run on those alone; all samples are labelled once, at the end.
    `lick_before` and `dual` keep the first result.
    """
    keep = stage if staged else (lambda df, _name: df)
    samples = samples.withColumn("chunk", chunk_of("pos", chunk_rows))
    samples = attach(samples, settings, by)
    samples = with_thresholds(samples, settings, by)
    correct = corrects_dual_feeding(settings)
    if correct is False:
        runs = feeding_runs(samples, settings, by, chunk_rows=chunk_rows)
        return keep(label_contacts(samples, runs, settings, by, chunk_rows), "labelled")

    keys = [*by, "well"]
    needed = {*keys, "chamber", "chunk", "pos", "minutes", "base", "feeding_min", "feeding_max"}
    hits = samples.filter(_holds(F.col("base") > F.col("feeding_min"))).select(
        *[c for c in samples.columns if c in needed or c.startswith("p_")]
    )
    first = feeding_runs(hits, settings, by, chunk_rows=chunk_rows)
    marked = _with_marks(hits, {"_first": _span_marks(first, keys, "_first", chunk_rows)}, by)
    licked = marked.withColumn("lick", _holds(F.col("pos") <= F.col("_first")["end"])).drop("_first")
    paired = zero_weaker_contact(licked, by)
    if correct is None:
        wanted = value(settings, "correct_for_dual_feeding") & (value(settings, "chamber_size") == 2)
        paired = paired.withColumn(
            "corrected", F.when(wanted, F.col("corrected")).otherwise(F.col("base"))
        )
    paired = keep(paired, "paired")
    again = feeding_runs(paired, settings, by, level="corrected", chunk_rows=chunk_rows)
    # the licks found first, as spans once more
    spans = flag_runs(paired, F.col("lick"), keys, chunk_rows=chunk_rows)
    before = {
        "_first": _span_marks(spans, keys, "_first", chunk_rows),
        "_dual": paired.filter("dual").select(*keys, "chunk", "pos", F.col("pos").alias("_dual")),
    }
    return keep(label_contacts(samples, again, settings, by, chunk_rows, before), "labelled")


def tasting_runs(
    labelled: DataFrame,
    settings: Settings,
    by: Sequence[str] = REC,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Tasting events with their measures; short runs are dropped."""
    where = [c for c in ("chamber", "side") if c in labelled.columns]
    keys = [*by, *where, "well", *carried(settings, "tasting_minevents", "samples_per_second")]
    runs = flag_runs(labelled, F.col("taste"), keys, measure="base", chunk_rows=chunk_rows)
    return runs.filter(F.col("length") >= value(settings, "tasting_minevents"))


def simultaneous_matrices(labelled: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Licks of both wells of a chamber, shared licks and how strong they were.

    `stage` tells the licks before and after dual-feeding correction. Both come from one
    pass: a tick's licks are four bits, and a chamber leaves one row per mask. Wells are
    physical ones in order, not A and B.
    """
    at = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("base")))
    bit = lambda lick, slot, n: F.when(F.col(lick) & (F.col("slot") == slot), n).otherwise(0)
    bits = bit("lick_before", 1, 1) + bit("lick_before", 2, 2) + bit("lick", 1, 4) + bit("lick", 2, 8)
    # only licked samples travel; chambers without any come back at the end
    ticks = (
        labelled.filter(_holds(F.col("lick_before")) | _holds(F.col("lick")))
        .groupBy(*by, "chamber", "chunk", "pos")
        .agg(F.bit_or(bits).alias("mask"), at(1).alias("b1"), at(2).alias("b2"))
    )
    masks = ticks.groupBy(*by, "chamber", "mask").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.max(F.least("b1", "b2")).alias("strength"),
        F.sum((F.col("b1") > F.col("b2")).cast("int")).cast("double").alias("higher"),
    )
    counted = masks.withColumn(
        "_stage",
        F.explode(
            F.array(
                *[F.struct(F.lit(name).alias("stage"), F.lit(low).alias("low")) for name, low in (("before", 1), ("after", 4))]
            )
        ),
    )
    has = lambda n: F.col("mask").bitwiseAND(F.col("_stage.low") * n) != 0
    both = has(1) & has(2)
    found = counted.groupBy(*by, "chamber", F.col("_stage.stage").alias("stage")).agg(
        F.sum(F.when(has(1), F.col("n"))).alias("Licks1"),
        F.sum(F.when(has(2), F.col("n"))).alias("Licks2"),
        F.sum(F.when(both, F.col("n"))).alias("Both"),
        F.max(F.when(both, F.col("strength"))).alias("MaxMinSignalAtBoth"),
        F.sum(F.when(both, F.col("higher"))).alias("HigherInCol1AtBoth"),
    )
    chambers = labelled.select(*by, "chamber").distinct()
    every = chambers.withColumn("stage", F.explode(F.array(F.lit("before"), F.lit("after"))))
    return every.join(found, [*by, "chamber", "stage"], "left").fillna(
        0.0, ["Licks1", "Licks2", "Both", "MaxMinSignalAtBoth", "HigherInCol1AtBoth"]
    )


def simultaneous_matrix(
    labelled: DataFrame, by: Sequence[str] = REC, stage_name: str = "after"
) -> DataFrame:
    """`simultaneous_matrices` before or after dual-feeding correction."""
    return simultaneous_matrices(labelled, by).where(F.col("stage") == stage_name).drop("stage")


def dual_rows(labelled: DataFrame) -> DataFrame:
    """Samples at which both wells of a chamber were licked."""
    return labelled.filter("dual")
