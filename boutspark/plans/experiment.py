"""Whole analyses: from samples to every table, with shared work staged once."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.operators import compare, detect, groups, quality, summary, sweep
from boutspark.operators.baseline import subtract_baseline
from boutspark.operators.bouts import feeding_bouts, feeding_intervals
from boutspark.operators.scan import chunk_of, ordered_scan
from boutspark.params import REC, Params, Settings, Swept
from boutspark.staging import stage


class BasicAnalysis(NamedTuple):
    overview: DataFrame
    integrity: DataFrame
    breaks: DataFrame
    simultaneous: DataFrame | None
    bleeding: DataFrame
    summary: DataFrame
    bouts: DataFrame
    intervals: DataFrame
    well_rows: DataFrame | None
    weighted: DataFrame | None
    #: Entries of every error column, where the samples carry `errors`.
    errors: DataFrame | None = None


class QualityResults(NamedTuple):
    """Everything the quality checks found, apart per device."""

    #: One row per device: integrity, number of breaks, shared licks, strongest bleeding.
    devices: DataFrame
    #: Every break of the device clock, and the first ones of each device (`BreakNr`).
    breaks: DataFrame
    first_breaks: DataFrame
    #: Shared licks per chamber before and after correction; none for one-well chambers.
    simultaneous: DataFrame | None
    bleeding: DataFrame
    mean_base: DataFrame


def detect_contacts(
    rows: DataFrame,
    settings: Settings,
    by: Sequence[str] = REC,
    window: int | None = None,
    start: float | None = None,
    end: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Samples -> (baselined, labelled), both staged.

    The load window is open on both sides and is cut before the baseline, on
    which it has an influence; positions then count from its first sample.
    """
    if start is not None or end is not None:
        rows = load_window(rows, by, start, end)
    base = stage(subtract_baseline(rows, settings, by, window), "baselined")
    return base, detect.detect(base, settings, by)


def load_window(
    rows: DataFrame, by: Sequence[str], start: float | None, end: float | None
) -> DataFrame:
    """Samples with start < minutes < end, numbered again without a global sort.

    A clock may step back, so the samples kept can be several stretches of a
    recording; they are counted chunk by chunk.
    """
    kept = rows
    if start is not None:
        kept = kept.filter(F.col("minutes") > float(start))
    if end is not None:
        kept = kept.filter(F.col("minutes") < float(end))
    counted = ordered_scan(kept, [*by, "well"], ["pos"], sums={"_nr": F.lit(1).cast("bigint")})
    moved = counted.withColumn("pos", F.col("_nr") - 1).drop("_nr")
    return moved.withColumn("chunk", chunk_of("pos"))


def basic_analysis(
    base: DataFrame,
    labelled: DataFrame,
    design: DataFrame,
    settings: Params,
    by: Sequence[str] = REC,
    *,
    factors: Sequence[str] = (),
    multiplier: float = 4.0,
    bleeding_cutoff: float = 50.0,
    seconds: str = "seconds",
    hedonic: bool = False,
) -> BasicAnalysis:
    """Quality checks, overview and summaries over one staged detection."""
    two = settings.chamber_size == 2
    keys = [*by, "well"]
    table = summary.with_design(
        summary.feeding_summary(labelled, settings, by, two_wells=two), design, factors, by
    )
    matrix, _ = quality.bleeding_matrix(base, bleeding_cutoff, by)
    return BasicAnalysis(
        overview=quality.overview(base, by),
        integrity=quality.integrity(
            base,
            keys,
            clock="ts" if "ts" in base.columns else None,
            index="sample" if "sample" in base.columns else None,
            code="error_code" if "error_code" in base.columns else None,
            errors="errors" if "errors" in base.columns else None,
        ),
        breaks=quality.data_breaks(
            quality.device_ticks(base, seconds, by), by, settings.samples_per_second, multiplier, seconds
        ),
        simultaneous=detect.simultaneous_matrix(labelled, by) if two else None,
        bleeding=matrix,
        summary=table,
        bouts=feeding_bouts(labelled, settings, by),
        intervals=feeding_intervals(labelled, settings, by),
        well_rows=groups.well_rows(table, factors, "MedDuration", by) if hedonic and two else None,
        weighted=groups.weighted_durations(table) if hedonic and two else None,
        errors=quality.error_columns(base, keys) if "errors" in base.columns else None,
    )


def quality_results(
    base: DataFrame,
    labelled: DataFrame,
    settings: Params,
    by: Sequence[str] = REC,
    *,
    rate: float | None = None,
    multiplier: float = 4.0,
    bleeding_cutoff: float = 50.0,
    seconds: str = "seconds",
    first: int = 10,
) -> QualityResults:
    """All quality checks of every device; `first` is the length of the report of breaks.

    `rate` is the sampling rate that breaks are judged by, that of the settings by default.
    Breaks and the mask histogram are staged, so samples are read once for each. A table
    without samples gives empty results; a missing clock gives no breaks.
    """
    found = quality.data_breaks(
        quality.device_ticks(base, seconds, by), by, rate or settings.samples_per_second, multiplier, seconds
    )
    found = stage(found, "breaks")
    shared = stage(detect.simultaneous_matrices(labelled, by), "shared") if settings.chamber_size == 2 else None
    matrix, overall = quality.bleeding_matrix(base, bleeding_cutoff, by)
    checked = quality.integrity(
        base,
        by,
        clock=None,
        index=None,
        code="error_code" if "error_code" in base.columns else None,
        errors="errors" if "errors" in base.columns else None,
    )
    before = None if shared is None else shared.where("stage = 'before'")
    return QualityResults(
        devices=quality.qc_table(checked, found, before, matrix, by),
        breaks=found,
        first_breaks=quality.first_breaks(found, by, first),
        simultaneous=shared,
        bleeding=matrix,
        mean_base=overall,
    )


def parameter_sweep(
    rows: DataFrame,
    design: DataFrame,
    settings: Params,
    field: str,
    values: Sequence[float],
    by: Sequence[str] = REC,
    *,
    factors: Sequence[str] = (),
    window: int | None = None,
    transform_licks: bool = True,
) -> DataFrame:
    """Contacts under every value of one parameter, from one pass over the samples."""
    swept = Swept(settings, field, tuple(float(v) for v in values))
    table = sweep.swept_summary(rows, settings, swept, by, window=window, transform_licks=transform_licks)
    designed = table.join(design.select(*by, "chamber", "Treatment", *factors), [*by, "chamber"])
    return compare.sweep_table(designed, swept.column, factors)
