"""Hard negatives: for each anchor and each of its positives, the best rows of other labels in a score window.

Scores are integer inner products of all anchors with all rows. Rows are packed into blocks,
anchors into groups of near ones, each with a spanning tree (Prim's, over Euclidean
distances). In a (group, block) pair the root's scores are computed; from there on, an edge
of length d bounds a child's score of a row of norm n by its parent's score plus or minus
d * n (the parent's own bounds where it was not scored). Only rows whose bounds overlap what a child can
still use are scored for it: for positives, what may be among its best of its own label; for
negatives, its windows above the worst row kept. Edges of length 0 (copies) give scores without any product.

How much the bounds save depends on the data: much for copies and tight clusters, nothing
where the nearest anchors are as far apart as norms are long. Results do not depend on it.

Groups meet blocks by a broadcast join in rounds of at most `TILE` full groups, so what is sent to
all tasks is bounded, and rows never shuffle. A task keeps the best rows of each anchor of a
round over all its blocks; what tasks keep is merged by anchor.

Defined results: rows without id, label or vector, with a null component, or with an integer
norm of 2^31 or more (whose scores may leave the range of bigint) take no part; shorter
vectors count as filled up with zeros; rows of one id are rows of their own, and a copy of an
anchor counts as another row; ties of score go to the smaller id; an anchor without positives
or a positive without negatives gives no rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutspark.llm.lean import lean
from boutspark.shipping import ship
from boutspark.staging import stage

BLOCK = 2_048  # rows of a block
GROUP = 1_024  # anchors of a tree
TILE = 16  # full groups' worth of anchors that is sent to all tasks at once
LIMIT = float(1 << 62)  # squared norm
EXACT = float(1 << 53)
PLANES = 20  # signs that put near anchors next to each other
LOW = -np.iinfo(np.int64).max  # no score: its negation is a bigint as well

_TREE = "a_parent array<bigint>, a_edge array<double>, a_depth array<bigint>"
_PACK = "dim int, ids array<bigint>, labels array<bigint>, rows array<bigint>, data binary"


def _pack(ids, labels, rows, q: np.ndarray) -> list:
    """Columns of one packed row: int32 components row by row."""
    return [
        pa.array([q.shape[1]], pa.int32()),
        *(pa.array([np.asarray(x, np.int64)], pa.list_(pa.int64())) for x in (ids, labels, rows)),
        pa.array([q.astype("<i4").tobytes()], pa.binary()),
    ]


class Rows:
    """Packed rows as arrays."""

    def __init__(self, cells: dict):
        self.ids, self.labels, self.rows = (np.asarray(cells[n], np.int64) for n in ("ids", "labels", "rows"))
        self.q = np.frombuffer(cells["data"], "<i4").reshape(len(self.ids), cells["dim"]).astype(np.float64)
        self.norm = np.sqrt((self.q**2).sum(1))

    def wide(self, dim: int) -> np.ndarray:
        return self.q if self.q.shape[1] == dim else np.pad(self.q, ((0, 0), (0, dim - self.q.shape[1])))


def _cells(batch: pa.RecordBatch, prefix: str, i: int) -> dict:
    # arrays of numbers without a detour over Python objects
    cells = {n: batch.column(prefix + n)[i].values.to_numpy() for n in ("ids", "labels", "rows")}
    return cells | {"dim": batch.column(prefix + "dim")[i].as_py(), "data": batch.column(prefix + "data")[i].as_py()}


def product(a: np.ndarray, x: np.ndarray, a_norm: np.ndarray, x_norm: np.ndarray) -> np.ndarray:
    """Exact inner products (a rows by x rows) as bigint."""
    if not len(a) or not len(x) or a_norm.max() * x_norm.max() < EXACT:
        return (a @ x.T).astype(np.int64)
    return a.astype(np.int64) @ x.T.astype(np.int64)


def spanning_tree(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, edge length, depth) of a minimum spanning tree; the parent of the root is -1."""
    n = len(q)
    norms = (q**2).sum(1)
    parent = np.full(n, -1)
    near = np.full(n, np.inf)
    depth = np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    at = int(np.argmin(((q - q.mean(0)) ** 2).sum(1)))
    for _ in range(n):
        out[at] = True
        d = np.where(out, -1.0, norms + norms[at] - 2.0 * (q @ q[at]))
        closer = d < near
        closer &= ~out
        near[closer] = d[closer]
        parent[closer] = at
        depth[closer] = depth[at] + 1
        at = int(np.argmin(np.where(out, np.inf, near)))
    edge = np.zeros(n)
    child = parent >= 0
    edge[child] = np.sqrt(((q[child] - q[parent[child]]) ** 2).sum(1))
    return parent, edge, depth


class Best:
    """The k best (score, id) of each of n slots: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), LOW)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """Scores (slots by rows) of rows with rising `ids`; only those marked in `fit` count."""
        k = self.score.shape[1]
        worst, worst_id = self.score[slots, -1][:, None], self.id[slots, -1][:, None]
        fit = fit & ((score > worst) | ((score == worst) & (ids < worst_id)))
        some = np.flatnonzero(fit.any(1))
        if not len(some):
            return
        fit, score, slots = fit[some], score[some], slots[some]
        many = np.flatnonzero(fit.sum(1) > 8 * k)
        if len(many):
            # leave the k best of a slot before anything is sorted
            part = np.where(fit[many], score[many], LOW)
            least = np.partition(part, part.shape[1] - k, axis=1)[:, -k][:, None]
            above, tie = part > least, (part == least) & fit[many]
            fit[many] = above | (tie & (np.cumsum(tie, 1) <= k - above.sum(1)[:, None]))
        i, j = np.nonzero(fit)
        m = len(slots)
        slot = np.r_[i, np.repeat(np.arange(m), k)]
        value = np.r_[score[i, j], self.score[slots].ravel()]
        name = np.r_[ids[j], self.id[slots].ravel()]
        order = np.lexsort((name, -value, slot))
        place = np.arange(len(order)) - np.repeat(np.r_[0, np.cumsum(np.bincount(slot, minlength=m))[:-1]], np.bincount(slot, minlength=m))
        top = place < k
        self.score[slots[slot[order][top]], place[top]] = value[order][top]
        self.id[slots[slot[order][top]], place[top]] = name[order][top]


class Descent:
    """Scores of a group's anchors along its tree; counts what was scored."""

    def __init__(self, group: Rows, parent: np.ndarray, edge: np.ndarray, depth: np.ndarray):
        self.group, self.parent, self.edge = group, parent, edge
        self.levels = [np.flatnonzero(depth == k) for k in range(int(depth.max()) + 1)]
        self.scored = self.met = 0

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Descent:
        tree = (batch.column(n)[i].values.to_numpy() for n in ("a_parent", "a_edge", "a_depth"))
        return cls(Rows(_cells(batch, "a_", i)), *tree)

    def walk(self, block: Rows, floor, ceiling):
        """(anchors, scores, known) level by level; `floor` and `ceiling` give the scores that anchors can use."""
        g = self.group
        dim = max(g.q.shape[1], block.q.shape[1])
        a, x = g.wide(dim), block.wide(dim)
        big = g.norm.max() * block.norm.max() >= EXACT
        low = np.empty((len(g.ids), len(block.ids)))
        high = np.empty_like(low)
        for depth, level in enumerate(self.levels):
            if depth:
                up = self.parent[level]
                # rounding may not narrow the bounds; scores beyond exact doubles are all computed
                edge = self.edge[level][:, None]
                reach = np.where(edge > 0, edge * block.norm * (1 + 1e-9) + 1, 0.0)
                if big:
                    reach = np.full(reach.shape, np.inf)
                lo, hi = low[up] - reach, high[up] + reach
                need = (hi >= floor(level)[:, None]) & (lo <= ceiling(level)[:, None])
                known = lo == hi
                columns = np.flatnonzero((need & ~known).any(0))
            else:
                lo = hi = np.zeros((len(level), len(block.ids)))
                need = np.ones(lo.shape, bool)
                known = np.zeros(lo.shape, bool)
                columns = np.arange(len(block.ids))
            score = np.where(known, lo, 0).astype(np.int64)
            if len(columns):
                fresh = product(a[level], x[columns], g.norm[level], block.norm[columns])
                # single scores of rows that others of the level need come along and count as known
                score[:, columns] = np.where(known[:, columns], score[:, columns], fresh)
                known[:, columns] = True
                lo[:, columns] = hi[:, columns] = score[:, columns]
            self.scored += len(columns) * len(level)
            self.met += need.size
            low[level], high[level] = lo, hi
            yield level, score, need & known


def _blocks():
    """Packs rows (id, label, q) into blocks, by rising ids."""

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        n = done = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield from packed(held, first + done)
                done, held, n = done + n, [], 0
        if n:
            yield from packed(held, first + done)

    def packed(held, first):
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column(2).combine_chunks()
        size = np.asarray(lists.value_lengths(), np.int64)
        q = np.zeros((len(size), max(int(size.max()), 1)))
        q[np.arange(q.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
        fit = np.flatnonzero((q**2).sum(1) < LIMIT)
        ids = table.column(0).to_numpy()
        fit = fit[np.argsort(ids[fit], kind="stable")]
        for s in range(0, len(fit), BLOCK):
            i = fit[s : s + BLOCK]
            yield pa.RecordBatch.from_arrays(
                _pack(ids[i], table.column(1).to_numpy()[i], first + i, q[i]), ["dim", "ids", "labels", "rows", "data"]
            )

    return lean(run)


def _signs(dim: int) -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (PLANES, dim))


def _singles(every: int):
    """Single anchors, and the signs of some projections as one number."""

    @lean
    def run(batches):
        weights = 1 << np.arange(PLANES)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = Rows(_cells(batch, "", i))
                at = np.flatnonzero(rows.ids % every == 0)
                near = (rows.q[at] @ _signs(rows.q.shape[1]).T > 0) @ weights
                for j, sign in zip(at.tolist(), near.tolist(), strict=True):
                    one = _pack(rows.ids[[j]], rows.labels[[j]], rows.rows[[j]], rows.q[[j]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([sign], pa.int64()), *one], ["near", "dim", "ids", "labels", "rows", "data"]
                    )

    return run


def _grouped(batches):
    """Sorted single anchors packed into groups."""
    part = TaskContext.get().partitionId()
    held: list[Rows] = []
    n = 0
    for batch in batches:
        for i in range(batch.num_rows):
            held.append(Rows(_cells(batch, "", i)))
            if len(held) == GROUP:
                yield _group(held, part, n)
                held, n = [], n + 1
    if held:
        yield _group(held, part, n)


def _group(held: list[Rows], part: int, n: int) -> pa.RecordBatch:
    dim = max(r.q.shape[1] for r in held)
    q = np.concatenate([r.wide(dim) for r in held])
    ids, labels, rows = (np.concatenate([getattr(r, c) for r in held]) for c in ("ids", "labels", "rows"))
    numbers = [pa.array([(part << 32) + n], pa.int64())]
    tree = [pa.array([x]) for x in spanning_tree(q)]
    return pa.RecordBatch.from_arrays(
        [*numbers, *_pack(ids, labels, rows, q), *tree],
        ["gid", "a_dim", "a_ids", "a_labels", "a_rows", "a_data", "a_parent", "a_edge", "a_depth"],
    )


_PAIR = [p + n for p in ("", "a_") for n in ("dim", "ids", "labels", "rows", "data")] + ["a_parent", "a_edge", "a_depth"]


def _tiles(groups: DataFrame) -> list[list[int]]:
    """Numbers of the groups of each round: about `TILE * GROUP` anchors, in however small groups they come."""
    tiles: list[list[int]] = []
    size = TILE * GROUP
    for gid, n in sorted(map(tuple, groups.select("gid", F.size("a_ids")).collect())):
        if size + n > TILE * GROUP:
            tiles.append([])
            size = 0
        tiles[-1].append(gid)
        size += n
    return tiles


def _meet(blocks: DataFrame, groups: DataFrame, run, schema: str) -> DataFrame:
    """`run` over all (block, group) pairs, tile by tile; groups of a tile are broadcast."""
    out = None
    for gids in _tiles(groups):
        names = F.explode(F.array(*[F.lit(g).cast("bigint") for g in gids]))
        pairs = blocks.withColumn("gid", names).join(F.broadcast(groups.where(F.col("gid").isin(gids))), "gid")
        met = stage(pairs.select("gid", *_PAIR, *[c for c in groups.columns if c == "aims"]).mapInArrow(run, schema), "met")
        out = met if out is None else out.union(met)
    return out


def _positives(k: int):
    @lean
    def run(batches):
        seen: dict[int, tuple[Descent, Best, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                gid = batch.column("gid")[i].as_py()
                if gid not in seen:
                    down = Descent.of(batch, i)
                    seen[gid] = (down, Best(len(down.group.ids), k), _first_floor(down.group, k))
                down, best, first = seen[gid]
                group, block = down.group, Rows(_cells(batch, "", i))

                def floor(level, best=best, first=first):
                    return np.maximum(first[level], best.floor()[level]).astype(np.float64)

                for level, score, known in down.walk(block, floor, lambda level: np.full(len(level), np.inf)):
                    fit = known & (group.labels[level][:, None] == block.labels)
                    fit &= group.rows[level][:, None] != block.rows
                    best.offer(level, score, block.ids, fit)
        for gid, (_down, best, _first) in seen.items():
            slot, place = np.nonzero(best.score > LOW)
            if len(slot):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(slot), gid), pa.int64()),
                        pa.array(slot, pa.int32()),
                        pa.array(best.id[slot, place], pa.int64()),
                        pa.array(best.score[slot, place], pa.int64()),
                    ],
                    ["gid", "slot", "id", "score"],
                )

    return run


def _first_floor(group: Rows, k: int) -> np.ndarray:
    """A score that the k-th best row of an anchor's label reaches: the k-th best among the group's anchors."""
    if len(group.ids) <= k:
        return np.full(len(group.ids), LOW)
    score = product(group.q, group.q, group.norm, group.norm)
    np.fill_diagonal(score, LOW)
    score[group.labels[:, None] != group.labels] = LOW
    return np.partition(score, score.shape[1] - k, axis=1)[:, -k]


def _negatives(k_pos: int, k: int, low: int, high: int):
    """Best rows of other labels with low * p <= 100 * score <= high * p, for each positive score p."""

    @lean
    def run(batches):
        seen: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                gid = batch.column("gid")[i].as_py()
                if gid not in seen:
                    down = Descent.of(batch, i)
                    n = len(down.group.ids)
                    # windows in whole scores; an empty one for missing positives
                    bottom, top = np.full((n, k_pos), 1), np.zeros((n, k_pos), np.int64)
                    for slot, place, p in _aims(batch, i):
                        bottom[slot, place], top[slot, place] = -(-low * p // 100), high * p // 100
                    seen[gid] = (down, [Best(n, k) for _ in range(k_pos)], bottom, top)
                down, bests, bottom, top = seen[gid]
                group, block = down.group, Rows(_cells(batch, "", i))
                live = bottom <= top

                def floor(level, bests=bests, bottom=bottom, live=live):
                    least = [np.where(live[level, c], np.maximum(bottom[level, c], b.floor()[level]), np.inf) for c, b in enumerate(bests)]
                    return np.min(least, axis=0)

                def ceiling(level, top=top, live=live):
                    return np.where(live[level], top[level], -np.inf).max(1)

                for level, score, known in down.walk(block, floor, ceiling):
                    other = known & (group.labels[level][:, None] != block.labels)
                    for c, best in enumerate(bests):
                        fit = other & (score >= bottom[level, c][:, None]) & (score <= top[level, c][:, None])
                        best.offer(level, score, block.ids, fit)
        for gid, (_down, bests, _bottom, _top) in seen.items():
            for c, best in enumerate(bests):
                slot, place = np.nonzero(best.score > LOW)
                if len(slot):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(slot), gid), pa.int64()),
                            pa.array(slot, pa.int32()),
                            pa.array(np.full(len(slot), c), pa.int32()),
                            pa.array(best.id[slot, place], pa.int64()),
                            pa.array(best.score[slot, place], pa.int64()),
                        ],
                        ["gid", "slot", "place", "id", "score"],
                    )

    return run


def _aims(batch: pa.RecordBatch, i: int):
    aims = batch.column("aims")[i].as_py()
    return [(a["slot"], a["place"], a["score"]) for a in aims or []]


def mine(
    rows: DataFrame,
    *,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "vector",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` has bigint ids and labels and integer vectors (array<bigint>); anchors are the rows
    whose id is divisible by `every`. `low` and `high` are per cent of the positive's score.
    """
    ship(rows.sparkSession)
    vector = F.col(vector_col)
    usable = rows.where(
        F.col(id_col).isNotNull()
        & F.col(label_col).isNotNull()
        & vector.isNotNull()
        & ~F.coalesce(F.exists(vector, lambda x: x.isNull()), F.lit(False))
    )
    plain = usable.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        vector.cast("array<double>").alias("q"),
    )
    blocks = stage(plain.mapInArrow(_blocks(), _PACK), "blocks")
    singles = blocks.where(F.exists("ids", lambda i: i % every == 0)).mapInArrow(_singles(every), f"near bigint, {_PACK}")
    pack = ", ".join("a_" + part for part in _PACK.split(", "))
    groups = stage(
        stage(singles, "anchors")
        .orderBy("near", F.col("rows")[0])
        .select("dim", "ids", "labels", "rows", "data")
        .mapInArrow(_grouped, f"gid bigint, {pack}, {_TREE}"),
        "groups",
    )
    schema = "gid bigint, slot int, {}id bigint, score bigint"
    met = _meet(blocks, groups, _positives(positives), schema.format(""))
    if met is None:
        return rows.sparkSession.createDataFrame(
            [],
            "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
        )
    order = [F.desc("score"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("gid", "slot").orderBy(*order)) - 1
    found = stage(met.withColumn("place", place).where(F.col("place") < positives), "positives")
    aims = found.groupBy("gid").agg(F.collect_list(F.struct("slot", "place", "score")).alias("aims"))
    aimed = stage(groups.join(aims, "gid"), "aimed")
    met = _meet(blocks, aimed, _negatives(positives, negatives, low, high), schema.format("place int, "))
    if met is None:
        met = rows.sparkSession.createDataFrame([], schema.format("place int, "))
    rank = F.row_number().over(Window.partitionBy("gid", "slot", "place").orderBy(*order))
    kept = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    names = groups.select("gid", F.posexplode("a_ids").alias("slot", "anchor_id"))
    return (
        kept.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        .join(found.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), ["gid", "slot", "place"])
        .join(names, ["gid", "slot"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
