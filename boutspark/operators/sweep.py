"""Contacts under many parameter values from one pass over the samples.

Samples are read once: every chunk of a device answers the medians of all wanted windows
from one wavelet matrix per well, and only what lies above the lowest level goes on. Runs
above all swept levels are read from nested level sets: positions above a level are looked
for among those above the level below. From there on only runs are multiplied by values,
never samples.

Dual-feeding correction compares the wells of a chamber where runs of both overlap, value by
value, inside chunks; pieces of runs that touch a chunk's edge are joined afterwards, as
everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutspark.functions.scalars import lick_transform
from boutspark.operators.runs import EDGE_LANE, join_pieces, link_runs, spread_over_chunks
from boutspark.operators.scan import CHUNK_ROWS
from boutspark.operators.wavelet import WindowMedians
from boutspark.params import REC, Params, Swept
from boutspark.shipping import ship
from boutspark.staging import stage

_SEAT = ("chamber", "side", "well")
_CASE = ("sweep_value", "low", "up", "least", "gap", "rate")
_PIECE = ("start", "end", "high")


def _value(settings: Params, swept: Swept, name: str, v: float) -> float:
    return v if name == swept.field else float(getattr(settings, name))


def window_of(minutes: float, rate: float) -> int:
    """Samples of a baseline window: half-even rounding, then made odd."""
    n = round(minutes * 60.0 * rate)
    return n + (n % 2 == 0)


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _doubles(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _longs(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _picked(table: pa.Table, names: Sequence[str], rows: np.ndarray) -> dict[str, pa.Array]:
    taken = table.select(list(names)).take(pa.array(rows, pa.int64()))
    return {n: taken.column(n).combine_chunks() for n in names}


def _wells(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    """The table by well and position, and the range of rows of every well."""
    well = table.column("well").to_numpy()
    order = np.lexsort((table.column("pos").to_numpy(), well))
    well = well[order]
    edges = np.flatnonzero(np.r_[True, well[1:] != well[:-1]]).tolist() + [len(well)]
    ordered = table.take(pa.array(order, pa.int64()))
    return ordered, [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def swept_hits(
    rows: DataFrame,
    windows: dict[float, int],
    floor: float,
    by: Sequence[str] = REC,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Baselined samples above `floor` for every window, from one read of the samples.

    `windows` gives the width for each value of the column `_of`. One row without `base`
    marks every well of every chunk, so that wells without contacts are not lost.
    """
    ship(rows.sparkSession)
    half = (max(windows.values()) - 1) // 2
    reach = rows.select(*by, *_SEAT, "pos", F.col("signal").cast("double").alias("signal")).withColumn(
        "chunk",
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("pos") - half, F.lit(0)) / chunk_rows),
                F.floor((F.col("pos") + half) / chunk_rows),
            )
        ),
    )

    def found(table):
        table, wells = _wells(table)
        chunk = table.column("chunk")[0].as_py()
        pos = table.column("pos").to_numpy()
        signal = table.column("signal").to_numpy(zero_copy_only=False).astype(float)
        taken, of, base = [], [], []
        for a, b in wells:
            own = np.flatnonzero(pos[a:b] // chunk_rows == chunk)
            if not len(own):
                continue
            medians = WindowMedians(signal[a:b])
            known: dict[int, np.ndarray] = {}
            for value, width in windows.items():
                if width not in known:
                    known[width] = signal[a + own] - medians.at(own, width)
                above = np.flatnonzero(known[width] > floor)
                taken.append(a + np.r_[own[0], own[above]])
                base.append(np.r_[np.nan, known[width][above]])
                of.append(np.full(len(above) + 1, value))
        if not taken:
            return schema_arrow(table).slice(0, 0)
        taken, of, base = map(np.concatenate, (taken, of, base))
        out = _picked(table, [*by, *_SEAT, "chunk", "pos"], taken)
        out["_of"] = pa.array(of, pa.float64())
        out["base"] = pa.array(base, pa.float64(), from_pandas=True)
        return pa.table(out)

    def schema_arrow(table):
        out = {n: table.column(n) for n in [*by, *_SEAT, "chunk", "pos"]}
        none = pa.nulls(table.num_rows, pa.float64())
        return pa.table(out | {"_of": none, "base": none})

    schema = T.StructType([*_fields(reach, [*by, *_SEAT, "chunk", "pos"]), *_doubles(["_of", "base"])])
    return reach.repartition(*by, "chunk").groupBy(*by, "chunk").applyInArrow(found, schema)


def _runs_in(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the stretches without a gap, and their sizes."""
    first = np.flatnonzero(np.r_[True, np.diff(pos) != 1])
    return first, np.diff(np.r_[first, len(pos)])


def level_sets(pos: np.ndarray, base: np.ndarray, levels: Sequence[float]):
    """(level, start, end, high) of the runs above every level, from the lowest up.

    The level sets are nested, so each looks only at what the one below has left.
    """
    for level in sorted(set(levels)):
        left = base > level
        pos, base = pos[left], base[left]
        if not len(pos):
            return
        first, size = _runs_in(pos)
        yield level, pos[first], pos[first] + size - 1, np.maximum.reduceat(base, first)


def _cases(wells: DataFrame, settings: Params, swept: Swept, early: bool, keys: list[str]) -> DataFrame:
    """Levels and limits in force, one row per well and value."""
    cells = []
    for v in swept.values:
        at = {n: _value(settings, swept, n, v) for n in ("feeding_threshold", "feeding_minimum")}
        relative = at["feeding_threshold"] < 0
        low, up = (
            F.rint(F.col("peak") * abs(at[n])) if relative else F.lit(at[n])
            for n in ("feeding_minimum", "feeding_threshold")
        )
        limits = [
            F.lit(_value(settings, swept, field, v)).alias(name)
            for name, field in (
                ("least", "feeding_minevents"),
                ("gap", "feeding_event_link_gap"),
                ("rate", "samples_per_second"),
            )
        ]
        cells.append(F.struct(F.lit(v).alias("sweep_value"), low.alias("low"), up.alias("up"), *limits))
    cases = wells.select(*keys, *_SEAT, "last", F.inline(F.array(*cells)))
    return cases.where("_of = sweep_value") if early else cases


def _piece_schema(hits: DataFrame, keys: list[str], more: Sequence[str]) -> T.StructType:
    return T.StructType(
        [*_fields(hits, [*keys, "chunk", *_SEAT]), *_doubles(more), *_longs(["start", "end"]), *_doubles(["high"])]
    )


def _first_pieces(hits: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Runs above every level of a well, chunk by chunk."""

    def found(key, hits, levels):
        hits, wells = _wells(hits)
        pos, base = hits.column("pos").to_numpy(), hits.column("base").to_numpy()
        wanted = dict(zip(levels.column("well").to_pylist(), levels.column("lows").to_pylist(), strict=True))
        at = {w: i for i, w in enumerate(levels.column("well").to_pylist())}
        taken, low, parts = [], [], []
        for a, b in wells:
            well = hits.column("well")[a].as_py()
            for level, *piece in level_sets(pos[a:b], base[a:b], wanted.get(well, ())):
                taken.append(np.full(len(piece[0]), at[well]))
                low.append(np.full(len(piece[0]), level))
                parts.append(piece)
        return _pieces(levels, [*keys, "chunk", *_SEAT], taken, {"low": low}, parts)

    schema = _piece_schema(hits, keys, ["low"])
    return hits.groupBy(*keys, "chunk").cogroup(levels.groupBy(*keys, "chunk")).applyInArrow(found, schema)


def _pieces(table, names, taken, more, parts):
    """Rows of `table` with what was found for them."""

    def joined(lists, kind):
        return np.concatenate(lists).astype(kind) if lists else np.zeros(0, kind)

    out = _picked(table, names, joined(taken, np.int64))
    out |= {n: pa.array(joined(x, np.float64)) for n, x in more.items()}
    for i, n in enumerate(_PIECE):
        kind = np.float64 if n == "high" else np.int64
        out[n] = pa.array(joined([p[i] for p in parts], kind))
    return pa.table(out)


def _corrected_pieces(hits: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of the runs after the weaker of two simultaneous contacts has been set to 0."""
    right = runs.select(*[F.col(k).alias(f"r{k}") for k in (*keys, "chunk")], *_SEAT, *_CASE, "start", "end")

    def found(key, hits, runs):
        taken, parts = [], []
        if hits.num_rows and runs.num_rows:
            hits, wells = _wells(hits)
            pos, base = hits.column("pos").to_numpy(), hits.column("base").to_numpy()
            rows_of = {hits.column("well")[a].as_py(): (a, b) for a, b in wells}
            value, chamber, well, low, start, end = (
                runs.column(n).to_numpy(zero_copy_only=False)
                for n in ("sweep_value", "chamber", "well", "low", "start", "end")
            )
            order = np.lexsort((start, well, chamber, value))
            new = [np.r_[True, x[order][1:] != x[order][:-1]] for x in (value, chamber, well)]
            edges = np.flatnonzero(new[0] | new[1] | new[2]).tolist() + [len(order)]
            pairs: dict[tuple, list] = {}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                i = order[a:b]
                s, e = rows_of[well[i[0]]]
                # runs of one well do not meet, so a count of starts less ends marks what they cover
                mark = np.zeros(e - s + 1, np.int64)
                np.add.at(mark, np.searchsorted(pos[s:e], start[i]), 1)
                np.add.at(mark, np.searchsorted(pos[s:e], end[i], side="right"), -1)
                licked = s + np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                pairs.setdefault((value[i[0]], chamber[i[0]]), []).append((i[0], licked, base[licked].copy()))
            for seats in pairs.values():
                if len(seats) == 2:
                    (_, x, a), (_, y, b) = seats
                    _, i, j = np.intersect1d(pos[x], pos[y], assume_unique=True, return_indices=True)
                    weaker, other = a[i] <= b[j], b[j] <= a[i]
                    a[i[weaker]] = 0.0
                    b[j[other]] = 0.0
                for row, x, level in seats:
                    for _low, *piece in level_sets(pos[x], level, [low[row]]):
                        taken.append(np.full(len(piece[0]), row))
                        parts.append(piece)
        out = _pieces(runs, [f"r{k}" for k in (*keys, "chunk")] + [*_SEAT, *_CASE], taken, {}, parts)
        return out.rename_columns([*keys, "chunk", *_SEAT, *_CASE, *_PIECE])

    schema = T.StructType(
        [*_fields(hits, [*keys, "chunk", *_SEAT]), *_doubles(_CASE), *_longs(["start", "end"]), *_doubles(["high"])]
    )
    grouped = right.groupBy(*[f"r{k}" for k in (*keys, "chunk")])
    return hits.groupBy(*keys, "chunk").cogroup(grouped).applyInArrow(found, schema)


def swept_summary(
    rows: DataFrame,
    settings: Params,
    swept: Swept,
    by: Sequence[str] = REC,
    *,
    window: int | None = None,
    transform_licks: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Licks, events and median durations of every chamber for every swept value.

    Relative levels are never negative, because no recording lies below its running median
    everywhere; so what is above 0 is enough for them.
    """
    early = window is None and swept.field in ("baseline_window_minutes", "samples_per_second")
    minutes, rate = ([_value(settings, swept, n, v) for v in swept.values] for n in ("baseline_window_minutes", "samples_per_second"))
    widths = [window or window_of(m, r) for m, r in zip(minutes, rate, strict=True)]
    windows = dict(zip(swept.values, widths, strict=True)) if early else {0.0: widths[0]}
    lows = [_value(settings, swept, "feeding_minimum", v) for v in swept.values]
    floor = min([0.0, *lows]) if swept.ever_relative else min(lows)
    keys = [*by, "_of"]
    marked = stage(swept_hits(rows, windows, floor, by, chunk_rows), "hits")
    wells = marked.groupBy(*keys, *_SEAT).agg(
        F.coalesce(F.max("base"), F.lit(0.0)).alias("peak"), F.max("chunk").alias("last")
    )
    cases = stage(_cases(wells, settings, swept, early, keys), "cases")
    hits = marked.where("base is not null")
    lanes = F.explode(F.concat(F.array(F.lit(EDGE_LANE).cast("bigint")), F.sequence(F.lit(0).cast("bigint"), "last")))
    levels = (
        cases.groupBy(*keys, *_SEAT, "last")
        .agg(F.collect_set("low").alias("lows"))
        .select(*[F.col(c).alias(c) for c in (*keys, *_SEAT)], "lows", lanes.alias("chunk"))
        .where(F.col("chunk") >= 0)
    )
    pieces = _first_pieces(hits, levels, keys)
    merged = [F.max("high").alias("high")]
    runs = join_pieces(pieces, [*keys, *_SEAT, "low"], merged, chunk_rows)
    # a well's cases meet its runs lane by lane, so no well is one group
    spread = cases.select(*keys, *_SEAT, *_CASE, lanes.alias("lane"))
    survive = (F.col("high") > F.col("up")) & (F.col("length") >= F.col("least"))
    runs = runs.join(spread, [*keys, *_SEAT, "low", "lane"]).where(survive)
    full = [*keys, *_SEAT, *_CASE]
    if settings.correct_for_dual_feeding and settings.chamber_size == 2:
        cut = _corrected_pieces(hits, spread_over_chunks(runs.select(*full, "start", "end"), chunk_rows), keys)
        runs = join_pieces(cut, full, merged, chunk_rows).where(survive)
    runs = stage(runs.select(*full, "lane", "start", "end", "length"), "surviving")
    seat = [*by, "sweep_value", "chamber", "side"]
    facts = runs.groupBy(*seat).agg(F.sum("length").alias("licks"))
    bouts = link_runs(runs, full, F.col("gap")).select(*seat, ((F.col("end") - F.col("start") + 1) / F.col("rate")).alias("duration"))
    facts = facts.unionByName(bouts, allowMissingColumns=True).unionByName(
        cases.select(*seat).distinct(), allowMissingColumns=True
    )
    cols = []
    for s in ("A", "B") if settings.chamber_size == 2 else (None,):
        pick = lambda c, s=s: F.col(c) if s is None else F.when(F.col("side") == s, F.col(c))
        licks = F.coalesce(F.sum(pick("licks")).cast("double"), F.lit(0.0))
        cols += [
            (lick_transform(licks) if transform_licks else licks).alias(f"Licks{s or ''}"),
            F.count(pick("duration")).cast("double").alias(f"Events{s or ''}"),
            F.median(pick("duration")).alias(f"MedDuration{s or ''}"),
        ]
    return facts.groupBy(*by, "sweep_value", "chamber").agg(*cols)
