"""Near-duplicates by fast similarity sketching, banding and exact verification.

1. A text's set of word shingles is hashed. Round after round, every element is thrown
   into one of `BINS` bins by a hash of that round, and a bin keeps the least value of
   the first round that reaches it; from round `BINS` on, round i fills bin i - BINS. So
   every coordinate fills, after few rounds for larger sets.
2. Texts with equal sets are one class; only class representatives go on. Their sketches
   are cut into bands of `rows_of(percent)` coordinates; equal bands make a bucket. Two sets
   of the similarity asked for miss each other in all bands with probability below `MISS`.
3. In every bucket the least representative is compared with all others on full sets: at
   most one comparison per row of a bucket. Links are joined to components.
4. Pairs of a bucket that are still in different components, and whose sketches do not
   rule a link out (by six standard deviations), are compared on full sets too, block by
   block, so no task holds a whole large bucket; a block gives only the links that join
   something. Pairs inside one component cannot change the result.

Copies need no comparison, and a bucket of near copies usually becomes one component in
step 3, whatever its size.

Defined results: null, empty and white texts have an empty set, are linked with nothing and
are their own component; a row without an id has no component and is kept; rows that
share an id are one document: its sets all link to it, and of repeated rows every one is
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.llm.components import components
from boutspark.llm.groups import sorted_groups
from boutspark.llm.lean import lean
from boutspark.llm.sides import few
from boutspark.shipping import ship
from boutspark.staging import stage

SHINGLE = 5
PERCENT = 85
BINS = 128
#: Bound of the probability that two sets just similar enough share no bucket.
MISS = 1e-6
#: Rows of a piece of a bucket; two pieces meet in one block of the last step.
BLOCK = 500
#: Elements of the block's sets that are counted at a time.
COLUMNS = 4096

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _times_gold(i: int) -> np.uint64:
    return np.uint64(i * int(_GOLD) & (1 << 64) - 1)


def mix(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    v = v ^ (v >> np.uint64(33))
    v = v * np.uint64(0xFF51AFD7ED558CCD)
    v = v ^ (v >> np.uint64(33))
    v = v * np.uint64(0xC4CEB9FE1A85EC53)
    return v ^ (v >> np.uint64(33))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, size)
    total = np.full(n - k + 1, _times_gold(k))
    for i in range(k):
        total += h[i : n - k + 1 + i] * _ODD[i]
    return np.unique(mix(total))


def sketch(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One 64-bit coordinate per bin of a non-empty set of sorted mixed hashes."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    out = np.zeros(bins, np.uint64)
    empty = np.ones(bins, bool)
    for i in range(2 * bins):
        v = values if i == 0 else mix(values + _times_gold(i))
        if i < bins:
            where = (v >> shift).astype(np.int64)
            if i:
                order = np.argsort(v)
                v, where = v[order], where[order]
            first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            where, v = where[first], v[first]
            new = empty[where]
            where, v = where[new], v[new]
        else:
            if not empty[i - bins]:
                continue
            where, v = np.array([i - bins]), v.min(keepdims=True)
        out[where] = mix(v + np.uint64(i))
        empty[where] = False
        if not empty.any():
            break
    return out


def rows_of(percent: int) -> int:
    """Coordinates of a band: as many as keep the bound on misses (85: 25 bands of 5, 80: 32 of 4)."""
    share = percent / 100
    return max([1, *(r for r in range(1, 17) if (1 - share**r) ** (BINS // r) < MISS)])


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    n = len(coordinates) // rows
    total = (coordinates[: n * rows].reshape(n, rows) * _ODD[8 : 8 + rows]).sum(axis=1, dtype=np.uint64)
    return mix(total + np.arange(n, dtype=np.uint64) * _GOLD)


def _signatures(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        texts = batch.column(1).to_pylist()
        for s in range(0, len(texts), 2000):
            sizes, digests, keys, low = [], [], [], []
            for text in texts[s : s + 2000]:
                values = shingle_set(text)
                sizes.append(len(values))
                if len(values):
                    coordinates = sketch(values)
                    digests.append(xxh3_128_digest(values.tobytes()))
                    keys.append(bands(coordinates, rows).view(np.int64))
                    low.append((coordinates & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    digests.append(None)
                    keys.append(None)
                    low.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(s, len(sizes)),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(low, pa.binary()),
                ],
                ["id", "n", "digest", "bands", "low"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for s in range(0, len(texts), 500):
            sets = [shingle_set(t).view(np.int64) for t in texts[s : s + 500]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s, len(sets)), pa.array(sets, pa.list_(pa.int64()))], ["id", "values"]
            )


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, values) of the documents named."""
    texts = docs.join(few(ids), "id", "left_semi")
    return stage(texts.mapInArrow(lean(_full_sets), "id bigint, values array<bigint>"), "sets")


def _verified(docs: DataFrame, pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose full sets are similar enough."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # an id may stand on several rows; its class is the one that it represents
    sets = sets.join(known, (sets.id == known.rep) & (F.size("values") == known.n), "left_semi")
    left = sets.select(F.col("id").alias("a"), F.col("values").alias("va"))
    right = sets.select(F.col("id").alias("b"), F.col("values").alias("vb"))
    small, large = F.least(F.size("va"), F.size("vb")), F.greatest(F.size("va"), F.size("vb"))
    both = (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * small >= percent * large)
        .select("a", "b", (F.size("va") + F.size("vb")).alias("sum"), F.size(F.array_intersect("va", "vb")).alias("both"))
    )
    return both.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b").distinct()


def _open_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of each block that have a partner in another component which sketches and sizes do not rule out."""
    share = percent / 100
    least = int(BINS * share - 6 * np.sqrt(BINS * share * (1 - share)))
    for (key, one, two), cols in sorted_groups(batches, 3):
        rep, comp, n, chunk = (cols[c].to_numpy() for c in ("rep", "comp", "n", "chunk"))
        low = np.frombuffer(b"".join(cols["low"].to_pylist()), np.uint8).reshape(len(rep), BINS)
        second = np.flatnonzero(chunk == two)
        open_ = np.zeros(len(rep), bool)
        for i in np.flatnonzero(chunk == one):
            other = second[comp[second] != comp[i]]
            fits = 100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])
            other = other[fits]
            if len(other):
                other = other[np.count_nonzero(low[other] == low[i], axis=1) >= least]
                if len(other):
                    open_[other] = open_[i] = True
        if open_.any():
            m = int(open_.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m, key, np.int64)),
                    pa.array(np.full(m, one, np.int32)),
                    pa.array(np.full(m, two, np.int32)),
                    pa.array(rep[open_]),
                    pa.array(comp[open_]),
                    pa.array(chunk[open_].astype(np.int32)),
                    pa.array(n[open_]),
                ],
                ["key", "one", "two", "rep", "comp", "chunk", "n"],
            )


def common_sizes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of some sets, given one after the other."""
    m = len(sizes)
    row = np.repeat(np.arange(m), sizes)
    kinds, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    # elements of one set only are in no intersection
    shared = count[code] > 1
    row, code = row[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    total = np.zeros((m, m), np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        s, e = np.searchsorted(code, [start, start + COLUMNS])
        part = np.zeros((m, COLUMNS), np.float32)
        part[row[s:e], code[s:e] - start] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each block on full sets, as many as join what is linked."""
    for (_, one, two), cols in sorted_groups(batches, 3):
        rep, comp, chunk = (cols[c].to_numpy() for c in ("rep", "comp", "chunk"))
        sizes = np.diff(cols["values"].offsets.to_numpy())
        both = common_sizes(cols["values"].flatten().to_numpy(), sizes)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        linked &= comp[:, None] != comp[None, :]
        first, second = chunk == one, chunk == two
        linked &= (first[:, None] & second[None, :]) | (second[:, None] & first[None, :])
        new = linked.any(axis=1)
        found = []
        while new.any():
            ahead = [int(np.flatnonzero(new)[0])]
            new[ahead[0]] = False
            while ahead:
                i = ahead.pop()
                more = np.flatnonzero(linked[i] & new)
                new[more] = False
                ahead += more.tolist()
                found += [(rep[i], rep[j]) for j in more]
        if found:
            out = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    band = rows_of(percent)
    signed = stage(
        docs.mapInArrow(
            lean(lambda batches: _signatures(batches, band)), "id bigint, n bigint, digest binary, bands array<bigint>, low binary"
        ),
        "signatures",
    )
    named = signed.where("id is not null and n > 0")
    classes = stage(
        named.groupBy("digest").agg(
            F.min("id").alias("rep"),
            F.any_value("n").alias("n"),
            F.any_value("bands").alias("bands"),
            F.any_value("low").alias("low"),
        ),
        "classes",
    )
    member = named.select("id", "digest").distinct().join(classes.select("digest", "rep"), "digest").select("id", "rep")
    # rows of one id with different texts, and representatives that stand for several sets
    shared = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    shared = shared.join(member, "id").select("a", F.col("rep").alias("b"))
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    centres = stage(
        buckets.groupBy("key")
        .agg(F.min("rep").alias("centre"), F.max("rep").alias("far"), F.count("*").alias("size"))
        .where("centre <> far")
        .drop("far"),
        "buckets",
    )
    full = stage(buckets.join(centres, "key"), "bucketed")
    known = classes.select("rep", "n")
    stars = full.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = stage(_verified(docs, stage(stars, "stars"), known, percent).unionAll(shared), "links")
    labels = components(links)

    # what shares a bucket and is not joined yet
    larger = full.where("size > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    larger = stage(larger.withColumn("comp", F.coalesce("comp", "rep")), "open")
    mixed = larger.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("key")
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = (
        larger.join(mixed, "key")
        .where("rep <> centre")
        .join(classes.select("rep", F.col("n").alias("size_n"), "low"), "rep")
        .where("n = size_n")
        .withColumn("chunk", F.pmod(F.xxhash64("rep", "key"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "key",
            F.least("chunk", "other").cast("int").alias("one"),
            F.greatest("chunk", "other").cast("int").alias("two"),
            "rep",
            "comp",
            "n",
            "chunk",
            "low",
        )
    )
    left = (
        rows.repartition("key", "one", "two")
        .sortWithinPartitions("key", "one", "two")
        .mapInArrow(
            lean(lambda batches: _open_rows(batches, percent)),
            "key bigint, one int, two int, rep bigint, comp bigint, chunk int, n bigint",
        )
    )
    left = stage(left, "left")
    if not left.isEmpty():
        ids = stage(left.select(F.col("rep").alias("id")).distinct(), "ids")
        sets = _sets(docs, ids).select(F.col("id").alias("rep"), "values").dropDuplicates(["rep", "values"])
        more = (
            left.join(sets, "rep")
            .where(F.size("values") == F.col("n"))
            .select("key", "one", "two", "rep", "comp", "chunk", "values")
            .repartition("key", "one", "two")
            .sortWithinPartitions("key", "one", "two")
            .mapInArrow(lean(lambda batches: _block_links(batches, percent)), "a bigint, b bigint")
        )
        more = stage(more, "links")
        if not more.isEmpty():
            labels = components(links.unionAll(more))
    of_rep = labels.select(F.col("node").alias("rep"), "comp")
    of_class = (
        classes.select("digest", "rep").join(of_rep, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    )
    out = signed.join(of_class, "digest", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Rows without an id stay; of several rows of one kept id one with the least text stays.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent)
    gone = stage(found.where("not kept").select(id_col).distinct(), "gone")
    left = docs.join(few(gone), id_col, "left_anti").select(*docs.columns)
    named, bare = left.where(F.col(id_col).isNotNull()), left.where(F.col(id_col).isNull())
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if repeated.isEmpty():
        return left
    # only rows that share an id are compared by text
    once = named.join(repeated, id_col, "left_anti").select(*docs.columns)
    again = named.join(repeated, id_col, "left_semi").select(*docs.columns)
    first = again.groupBy(id_col).agg(F.min(F.struct(text_col, *[c for c in docs.columns if c not in (id_col, text_col)])).alias("row"))
    first = first.select(*[F.col(id_col) if c == id_col else F.col(f"row.{c}").alias(c) for c in docs.columns])
    return once.unionAll(first).unionAll(bare)
