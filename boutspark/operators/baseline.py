"""Running-median baseline and detection thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutspark.params import REC, Params, Settings, Swept, attach, carried, value
from boutspark.operators.scan import CHUNK_ROWS, spread_join


def window_samples(settings: Settings) -> Column:
    """Window length in samples: half-even rounding, then made odd."""
    n = F.rint(
        value(settings, "baseline_window_minutes") * 60.0 * value(settings, "samples_per_second")
    ).cast("bigint")
    return n + F.when(n % 2 == 0, 1).otherwise(0)


def running_median(
    df: DataFrame,
    by: Sequence[str],
    window: Column | int,
    column: str = "signal",
    out: str = "median",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Centred running median of every well over `pos`, shorter at both ends.

    Nulls are ignored. Every chunk of a device is computed on its own: samples
    within half a window of a chunk also travel to it, so a task sees at most
    chunk_rows + window samples of each well, however long the recording is.
    """
    window = window if isinstance(window, Column) else F.lit(window)
    half = ((window - 1) / 2).cast("bigint")
    reach = df.withColumn("_w", window.cast("bigint")).withColumn(
        "_at",
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("pos") - half, F.lit(0)) / chunk_rows),
                F.floor((F.col("pos") + half) / chunk_rows),
            )
        ),
    )

    def medians(rows: pa.Table) -> pa.Table:
        wells, pos = rows["well"].to_numpy(), rows["pos"].to_numpy()
        order = np.lexsort((pos, wells))
        wells = wells[order]
        signal = pd.Series(rows[column].to_numpy(zero_copy_only=False).astype(float)[order])
        width = int(rows["_w"][0].as_py())
        edges = np.flatnonzero(np.r_[True, wells[1:] != wells[:-1], True])
        found = np.empty(len(order))
        found[order] = np.concatenate(
            [
                signal[a:b].rolling(width, center=True, min_periods=1).median()
                for a, b in zip(edges[:-1], edges[1:])
            ]
        )
        out_rows = rows.drop_columns(["_w", "_at"]).append_column(
            out, pa.array(found, type=pa.float64(), from_pandas=True)
        )
        # well by well in order, so that neighbours are alike where they are written or sent
        own = pos // chunk_rows == rows["_at"].to_numpy()
        return out_rows.take(pa.array(order[own[order]]))

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    spread = reach.repartition(*by, "_at")
    return spread.groupBy(*by, "_at").applyInArrow(medians, schema)


def subtract_baseline(
    df: DataFrame,
    settings: Settings,
    by: Sequence[str] = REC,
    window: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add `base`: the signal minus its running median."""
    df = attach(df, settings, by)
    width = F.lit(window) if window is not None else window_samples(settings)
    med = running_median(df, by, width, chunk_rows=chunk_rows)
    return med.withColumn("base", F.col("signal") - F.col("median")).drop("median")


_LEVELS = {
    "feeding_max": "feeding_threshold",
    "feeding_min": "feeding_minimum",
    "tasting_max": "tasting_maximum",
    "tasting_min": "tasting_minimum",
}


def thresholds(df: DataFrame, settings: Settings, by: Sequence[str] = REC) -> DataFrame:
    """One row per well with the four levels in force.

    A negative feeding threshold makes every level a share of the largest
    baselined value of the well, rounded half-even.
    """
    relative = value(settings, "feeding_threshold") < 0
    peak = df.groupBy(*by, "well", *carried(settings, *_LEVELS.values())).agg(
        F.max("base").alias("peak")
    )
    return peak.select(
        *by,
        "well",
        *[
            F.when(relative, F.rint(F.col("peak") * F.abs(value(settings, name))))
            .otherwise(value(settings, name))
            .cast("double")
            .alias(level)
            for level, name in _LEVELS.items()
        ],
    )


def fixed_levels(settings: Settings) -> dict[str, Column] | None:
    """The four levels where the settings alone tell them; None where samples or devices do."""
    fixed = (isinstance(settings, Params) and settings.feeding_threshold >= 0) or (
        isinstance(settings, Swept) and not settings.ever_relative
    )
    return {lv: value(settings, name).cast("double") for lv, name in _LEVELS.items()} if fixed else None


def with_thresholds(df: DataFrame, settings: Settings, by: Sequence[str] = REC) -> DataFrame:
    """Bring the four levels onto the samples; a join only for relative levels.

    The levels of a device's wells are dealt to its chunks: a join on the well would
    keep a long recording in one task.
    """
    fixed = fixed_levels(settings)
    if fixed:
        return df.withColumns(fixed)
    levels = thresholds(df, settings, by)
    return spread_join(df.repartition(*by, "chunk"), levels, by, within="well")
