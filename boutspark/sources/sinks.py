"""Writing results. Every table is written by its own tasks; nothing is gathered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.operators.summary import Bins, binned_summary, with_design
from boutspark.params import REC, Settings


def write_table(
    df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()
) -> None:
    """One result table as CSV (with header) or Parquet."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_tables(tables: Mapping[str, DataFrame | None], root: str, fmt: str = "csv") -> list[str]:
    """Several results below one folder, named by their key; missing ones are skipped."""
    written = []
    for name, df in tables.items():
        if df is None:
            continue
        write_table(df, f"{root.rstrip('/')}/{name}", fmt)
        written.append(name)
    return written


def write_quality(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Quality tables, one folder per check and device."""
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", fmt, ["dfm"])


def write_segments(
    labelled: DataFrame,
    settings: Settings,
    design: DataFrame,
    breakpoints: Sequence[float],
    path: str,
    *,
    factors: Sequence[str] = (),
    by: Sequence[str] = REC,
    two_wells: bool = True,
    transform_licks: bool = True,
    fmt: str = "csv",
) -> None:
    """Summaries of n + 1 segments cut by n breakpoints, from one job.

    Each segment is a folder such as segment=100_400; the last one ends at
    `end`.
    """
    bins = Bins.from_breakpoints(breakpoints)
    table = binned_summary(
        labelled, settings, bins, by, two_wells=two_wells, transform_licks=transform_licks
    )
    named = with_design(table, design, factors, by).withColumn(
        "segment", F.translate(F.translate("Interval", "(]", ""), ",", "_")
    )
    write_table(named.drop("Interval", "Minutes", "bin"), path, fmt, ["segment"])


def write_included(summary: DataFrame, excluded: DataFrame, path: str, by: Sequence[str] = REC) -> None:
    """Summary rows of the chambers that are not excluded."""
    keys = [c for c in (*by, "chamber") if c in excluded.columns]
    write_table(summary.join(excluded.select(*keys), keys, "left_anti"), path)
