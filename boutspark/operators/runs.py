"""Runs of TRUE samples (gaps and islands) on recordings cut into chunks.

Pieces of runs are found inside chunks. A piece that touches the edge of its
chunk may go on in the next one; only such pieces, at most two per chunk, meet
in one lane per well to be joined. All others are final where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutspark.operators.scan import CHUNK_ROWS, chunk_of

EDGE_LANE = -1
_BEFORE = (Window.unboundedPreceding, -1)


def _number_groups(df: DataFrame, lane: Sequence[str], gap: Column) -> DataFrame:
    """Number groups of intervals whose distance is at most `gap` samples."""
    w = Window.partitionBy(*lane).orderBy("start")
    reach = F.max("end").over(w.rowsBetween(*_BEFORE))
    return df.withColumn("_new", F.when(F.col("start") - reach - 1 <= gap, 0).otherwise(1)).withColumn(
        "_grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def join_pieces(
    pieces: DataFrame, keys: Sequence[str], merged: Sequence[Column], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Runs from their pieces inside chunks: pieces that touch a chunk's edge are joined in one lane per well."""
    first = F.col("chunk") * chunk_rows
    edge = (F.col("start") == first) | (F.col("end") == first + (chunk_rows - 1))
    laned = pieces.withColumn("lane", F.when(edge, F.lit(EDGE_LANE).cast("bigint")).otherwise(F.col("chunk")))
    return (
        _number_groups(laned, [*keys, "lane"], F.lit(0))
        .groupBy(*keys, "lane", "_grp")
        .agg(F.min("start").alias("_start"), F.max("end").alias("end"), *merged)
        .withColumnRenamed("_start", "start")
        .withColumn("length", F.col("end") - F.col("start") + 1)
        .drop("_grp")
    )


def flag_runs(
    df: DataFrame,
    flag: Column,
    keys: Sequence[str],
    *,
    confirm: Column | None = None,
    measure: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per run of consecutive positions where `flag` holds.

    Needs columns pos, chunk, minutes. Returns keys, lane, start, end, length,
    minutes (at the start) and, when asked for, `confirmed` (does any sample
    satisfy `confirm`) and total / mean / low / high / variance of `measure`.
    """
    piece = [
        F.min("pos").alias("start"),
        F.max("pos").alias("end"),
        F.min_by("minutes", "pos").alias("minutes"),
    ]
    merged = [F.min_by("minutes", "start").alias("minutes")]
    if confirm is not None:
        piece.append(F.bool_or(F.coalesce(confirm, F.lit(False))).alias("confirmed"))
        merged.append(F.bool_or("confirmed").alias("confirmed"))
    if measure is not None:
        piece += [
            F.count(measure).alias("n"),
            F.sum(measure).alias("total"),
            F.min(measure).alias("low"),
            F.max(measure).alias("high"),
            (F.var_pop(measure) * F.count(measure)).alias("m2"),
        ]
        # squared deviations of joined pieces: within pieces plus between them
        between = F.sum(F.col("total") * F.col("total") / F.col("n")) - F.sum("total") * F.sum(
            "total"
        ) / F.sum("n")
        merged += [
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.when(F.count(F.lit(1)) == 1, F.sum("m2"))
            .otherwise(F.sum("m2") + F.greatest(between, F.lit(0.0)))
            .alias("m2"),
        ]
    here = Window.partitionBy(*keys, "chunk").orderBy("pos")
    hits = df.filter(flag).withColumn("_island", F.col("pos") - F.row_number().over(here))
    runs = join_pieces(hits.groupBy(*keys, "chunk", "_island").agg(*piece), keys, merged, chunk_rows)
    if measure is not None:
        runs = (
            runs.withColumn("mean", F.col("total") / F.col("n"))
            .withColumn("variance", F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)))
            .drop("m2", "n")
        )
    return runs


def surviving_runs(runs: DataFrame, min_length: Column | int = 1) -> DataFrame:
    """Runs with a confirming sample and at least `min_length` samples."""
    min_length = min_length if isinstance(min_length, Column) else F.lit(min_length)
    return runs.filter(F.col("confirmed") & (F.col("length") >= min_length))


def link_runs(runs: DataFrame, keys: Sequence[str], gap: Column | int) -> DataFrame:
    """Join runs separated by at most `gap` samples; returns keys, start, end.

    Groups are formed inside lanes first. The first and last group of every
    chunk, and everything that came from chunk edges, is then compared in one
    lane per well; groups in between cannot change any more.
    """
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    lane = [*keys, "lane"]
    groups = (
        _number_groups(runs.select(*lane, "start", "end"), lane, gap)
        .groupBy(*lane, "_grp")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    w = Window.partitionBy(*lane).orderBy("start")
    outer = F.lag("start").over(w).isNull() | F.lead("start").over(w).isNull()
    moved = groups.withColumn("_outer", outer).withColumn(
        "lane", F.when(F.col("_outer"), F.lit(EDGE_LANE).cast("bigint")).otherwise(F.col("lane"))
    )
    return (
        _number_groups(moved.drop("_grp", "_outer"), lane, gap)
        .groupBy(*lane, "_grp")
        .agg(F.min("start").alias("_start"), F.max("end").alias("end"))
        .select(*keys, F.col("_start").alias("start"), "end")
    )


def expand_runs(runs: DataFrame) -> DataFrame:
    """One row per sample of every run (`pos`), the other columns repeated."""
    return runs.withColumn("pos", F.explode(F.sequence("start", "end")))


def spread_over_chunks(runs: DataFrame, chunk_rows: int = CHUNK_ROWS, beyond: int = 0) -> DataFrame:
    """One row per chunk that a run (or the `beyond` samples after it) touches."""
    return runs.withColumn(
        "chunk",
        F.explode(
            F.sequence(
                chunk_of("start", chunk_rows), F.expr(f"(end + {beyond}) div {int(chunk_rows)}")
            )
        ),
    ).withColumn("pos", F.greatest(F.col("start"), F.col("chunk") * chunk_rows))
