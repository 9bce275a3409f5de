"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target over its size says how often its documents are wanted: whole times are
taken at once, the rest is the probability of one time more. These probabilities are
settled by the cube method: a point moves through the cube of probabilities along
directions that change neither the expected number of words nor the expected number of
documents, until nearly every coordinate is 0 or 1. Three open documents always leave such
a direction, (z3 - z2, z1 - z3, z2 - z1) for sizes z, so a block is walked in one pass with
three documents in hand, large ones first.

Blocks of a source walk side by side; the at most two documents that each leaves open meet
in blocks of the next round. In a source's last block the last `LANDING` open documents are
landed together: of all their 0/1 choices the one nearest to the wanted words, then to the
wanted number of documents. What is still missing then (a very long document among short
ones) is made up by turning settled documents of that block, the largest that fit first.

Equal rows (id, source, text) are counted before anything else and share one coordinate, so
a document that makes up a third of the table is one unit. Blocks come from hashes of rows
and walks from hashes of blocks: reruns and other partitionings give the same mix.

Defined results: a null or empty text has size 0 and is taken 0 times over 0 words; a null
source is a source of its own, after all others; null ids are documents like others; every
row, also a repeated one, gives one output row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutspark.llm.sides import few
from boutspark.shipping import ship
from boutspark.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096  # documents of a walk, on average
LANDING = 10  # open documents of a source that are settled by trying all choices
COPIES = 50_000  # rows that are written from one count of equal rows at a time

_UNIT = (
    "key string, doc_id {id}, h bigint, size bigint, copies bigint, source_size bigint, target double,"
    " whole bigint, p double, block bigint, blocks bigint"
)


def walk(p: list[float], z: list[float], draw, keep: int = 2) -> tuple[list[float], list[int]]:
    """Move probabilities to 0 or 1, keeping sum(p) and sum(p * z); (p, places still open).

    Stops when no more than `keep` (at least 2) places are open.
    """
    p = list(p)
    hand: list[int] = []
    left = len(p)
    for k in range(len(p)):
        if left + len(hand) <= keep:
            return p, hand + list(range(k, len(p)))
        left -= 1
        if 0.0 < p[k] < 1.0:
            hand.append(k)
        if len(hand) < 3:
            continue
        a, b, c = hand
        step = (z[c] - z[b], z[a] - z[c], z[b] - z[a])
        if not any(step):
            step = (1.0, -1.0, 0.0)
        moves = [(i, d) for i, d in zip(hand, step, strict=True) if d]
        ahead = min(((1.0 - p[i]) if d > 0 else p[i]) / abs(d) for i, d in moves)
        back = min((p[i] if d > 0 else (1.0 - p[i])) / abs(d) for i, d in moves)
        t = ahead if draw() * (ahead + back) < back else -back
        for i, d in moves:
            x = p[i] + t * d
            p[i] = 0.0 if x < 1e-9 else 1.0 if x > 1.0 - 1e-9 else x
        hand = [i for i in hand if 0.0 < p[i] < 1.0]
    return p, hand


def land(p: list[float], z: list[float]) -> list[float]:
    """The 0/1 choice nearest to sum(p * z), then to sum(p); all choices are tried."""
    if not p:
        return []
    choice = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    words = np.abs(choice @ np.asarray(z) - np.dot(p, z))
    docs = np.abs(choice.sum(1) - sum(p))
    return choice[np.lexsort((docs, words))[0]].astype(float).tolist()


def turn(p: list[float], z: list[float], missing: float, free: list[bool]) -> list[float]:
    """Turn settled places, of falling sizes z, while they bring the words nearer to what is wanted."""
    p = list(p)
    for i, size in enumerate(z):
        if free[i] and 0 < size <= abs(missing) and p[i] == (0.0 if missing > 0 else 1.0):
            p[i] = 1.0 - p[i]
            missing -= size if p[i] else -size
    return p


def _settle(seed: int, round_no: int):
    def run(key, table):
        source, block = (k.as_py() for k in key)
        table = table.sort_by([("size", "descending"), ("h", "ascending"), ("doc_id", "ascending")])
        p, z = table.column("p").to_pylist(), [float(x) for x in table.column("size").to_pylist()]
        last = table.column("blocks")[0].as_py() == 1
        draw = random.Random(f"{seed} {round_no} {block} {source}").random
        start = p
        p, still = walk(p, z, draw, LANDING if last else 2)
        if last:
            for i, x in zip(still, land([p[i] for i in still], [z[i] for i in still]), strict=True):
                p[i] = x
            missing = sum(a * b for a, b in zip(start, z, strict=True)) - sum(a * b for a, b in zip(p, z, strict=True))
            p = turn(p, z, missing, [0.0 < x < 1.0 for x in start])
        return table.set_column(table.column_names.index("p"), "p", pa.array(p, pa.float64()))

    return run


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with `rank` from 0 by key: places in sorted partitions plus the sizes of those before."""
    placed = stage(
        sources.orderBy("key").select(
            "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
        ),
        "sources",
    )
    starts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", "first", before.alias("before"))
    return placed.join(starts, "part").withColumn("rank", F.expr("before + place - first")).drop(
        "part", "place", "first", "before"
    )


def source_targets(
    sources: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3
) -> DataFrame:
    """(key, source_size, target) from (key, source_size).

    Sources weigh the numbers of `cycle` in turn, in the order of their keys, and share
    `share` of all sizes; no target is above `most` times its source's size, what is
    above goes to the others by weight. The level of words per weight rises until it fits;
    each step is one sum over the sources.
    """
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    ranked = stage(_ranked(sources).withColumn("weight", weights), "weights")
    cap = F.col("source_size") * float(most)
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = cap < F.col("weight") * level
        row = ranked.agg(
            F.sum(F.when(above, cap).otherwise(0.0)).alias("capped"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if not row["free"] or row["full"] == full:
            break
        level, full = (total - row["capped"]) / row["free"], row["full"]
    return ranked.select("key", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def mix(
    docs: DataFrame,
    *,
    cycle: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    most: float = 3,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, times, taken) of every row of `docs`."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.col(source_col).cast("string")
    units = stage(
        docs.select(
            # code point order, null last
            F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("key"),
            F.col(id_col).alias("doc_id"),
            F.xxhash64(F.col(id_col), text).alias("h"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        )
        .groupBy("key", "doc_id", "h", "size")
        .agg(F.count("*").alias("copies")),
        "units",
    )
    sources = stage(
        units.groupBy("key").agg(F.sum(F.expr("size * copies")).alias("source_size"), F.count("*").alias("n")), "sizes"
    )
    targets = source_targets(sources.select("key", "source_size"), cycle, share, most)
    targets = stage(targets.join(sources.select("key", "n"), "key"), "targets")
    wanted = F.expr("if(source_size = 0, 0D, copies * (target / source_size))")
    near = F.when(F.abs(wanted - F.round(wanted)) < 1e-9, F.round(wanted)).otherwise(wanted)
    kind = units.schema["doc_id"].dataType.simpleString()
    names = [part.split()[0] for part in _UNIT.split(", ")]
    open_units = (
        units.join(few(targets), "key")
        .withColumn("near", near)
        .withColumn("whole", F.floor("near"))
        .withColumn("p", F.col("near") - F.col("whole"))
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        .withColumn("block", F.expr("pmod(h, blocks)"))
        .select(*names)
    )
    done = []
    round_no = 0
    while True:
        moved = open_units.groupBy("key", "block").applyInArrow(_settle(seed, round_no), _UNIT.format(id=kind))
        moved = stage(moved, "walked")
        done.append(moved.where("p = 0 or p = 1"))
        open_units = (
            moved.where("p > 0 and p < 1")
            .withColumn("blocks", F.expr(f"cast(ceil(blocks / {BLOCK // 2}) as bigint)"))
            .withColumn("block", F.expr("pmod(block, blocks)"))
        )
        if open_units.isEmpty():
            break
        round_no += 1
    settled = done[0]
    for more in done[1:]:
        settled = settled.union(more)
    settled = settled.withColumn("all_times", F.expr("whole + cast(p as bigint)"))
    single = settled.where("copies = 1").withColumn("i", F.lit(0).cast("bigint"))
    # rows of large counts are written by many tasks
    many = (
        settled.where("copies > 1")
        .withColumn("part", F.expr(f"explode(sequence(0L, (copies - 1) div {COPIES}))"))
        .repartition("h", "part")
        .withColumn("i", F.expr(f"explode(sequence(part * {COPIES}, least((part + 1) * {COPIES}, copies) - 1))"))
        .drop("part")
    )
    times = F.expr("all_times div copies + if(i < all_times % copies, 1, 0)")
    return single.unionByName(many).select(
        F.col("doc_id").alias(id_col),
        F.expr("if(key = '1', null, substr(key, 2))").alias(source_col),
        "size",
        "source_size",
        "target",
        times.alias("times"),
        (times * F.col("size")).alias("taken"),
    )
