"""Removal of repeated byte strings: suffixes ordered only through a threshold length.

Ordering all suffixes by their first `LENGTH` bytes puts equal strings together; a
most-significant-digit radix sort finds these groups in passes and drops a suffix as soon
as it is alone. The digits are cut so that most suffixes leave in the first pass and
suffixes that travel together do so as one row:

* Pass 1, digit = an anchor. The least hash among the `GRAM`-byte grams of a suffix's
  first `LENGTH` bytes is its anchor (leftmost on ties). Equal strings have the same
  anchor at the same place. Neighbouring suffixes with one anchor form a run, one row.
  Where no other run of the corpus has this anchor, none of its suffixes is repeated.
* Pass 2, digit = the whole run. If another run has the same bytes around the anchor,
  all its suffixes are repeated. One run of each kind goes on, and only where an anchor
  has several kinds.
* Pass 3, all `LENGTH` bytes of the single suffixes that are left, within their anchor.
  Anchors with up to `TOGETHER` kinds of runs are ordered inside a task, many at a time; for
  the others the suffixes are dealt out singly and counted by Spark.

Equal groups of two or more are exactly the repeated strings. Strings are compared by
two independent 64-bit hashes (of the anchor and of the string). Counts are summed in the
tasks before rows move and rows are joined to counts, so a string that every document
holds is no single group anywhere.

Defined results: a null text counts as empty; texts under `LENGTH` bytes are never cut;
repeats within one text count, overlapping or not; strings are judged on the input, so
all places are cut; a repeated row is a repeated text; every row comes back, with null
and repeated ids too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.llm.lean import lean
from boutspark.llm.sides import few
from boutspark.shipping import ship
from boutspark.staging import stage

LENGTH = 200
GRAM = 56
#: Kinds of runs of one anchor up to which one task orders them (some 300 bytes each).
TOGETHER = 2_000
#: Bytes hashed at a time.
PIECE = 1 << 18

_RANDOM = np.random.default_rng(77)
_BYTE_A = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_B = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT_A, _MULT_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _mix(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint64(32))
    v = v * np.uint64(0xD6E8FEB86659FD93)
    return v ^ (v >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of the strings data[s:e], from sums of powers modulo 2**64."""

    def __init__(self, data: np.ndarray, table: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers[:n], out=self.sums[1:])
        self.inverse = inverse

    def __call__(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class Hashers:
    """Power tables by base, grown as needed."""

    def __init__(self):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _over(self, data: np.ndarray, table: np.ndarray, base: int) -> Rolling:
        n = len(data) + 1
        if base not in self.tables or len(self.tables[base][0]) < n:
            n = -(-n >> 16) << 16
            self.tables[base] = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        return Rolling(data, table, *self.tables[base])

    def anchor(self, data: np.ndarray) -> Rolling:
        return self._over(data, _BYTE_A, _MULT_A)

    def string(self, data: np.ndarray) -> Rolling:
        return self._over(data, _BYTE_B, _MULT_B)


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values, the place of its leftmost least one."""
    n = len(values) - width + 1
    # blocks of the window's length: a window is the end of one block and the start of the next
    full = -(-len(values) // width) * width
    padded = np.full(full, np.uint64(2**64 - 1))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    # the place changes only where a new minimum enters or the old one leaves
    place = np.empty(n, np.int64)
    is_least = np.flatnonzero(values[: len(values)] == _spread(least, width, len(values)))
    # candidates in order; for window s the first candidate at or after s with its least value
    at = np.searchsorted(is_least, np.arange(n))
    place[:] = is_least[np.minimum(at, len(is_least) - 1)]
    wrong = np.flatnonzero(values[place] != least)
    while len(wrong):
        at[wrong] += 1
        place[wrong] = is_least[at[wrong]]
        wrong = wrong[values[place[wrong]] != least[wrong]]
    return place


def _spread(least: np.ndarray, width: int, n: int) -> np.ndarray:
    """For every place the greatest least value of the windows over it: equal where the place is someone's least."""
    padded = np.zeros(n + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    full = -(-len(padded) // width) * width
    more = np.zeros(full, np.uint64)
    more[: len(padded)] = padded
    blocks = more.reshape(-1, width)
    before = np.maximum.accumulate(blocks, axis=1).ravel()
    after = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(after[:n], before[width - 1 : width - 1 + n])


def runs(data: np.ndarray, hashers: Hashers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first suffix, last suffix, hash of the run's bytes), in text order."""
    parts = []
    n = len(data) - length + 1
    width = length - gram + 1
    for s in range(0, max(n, 0), PIECE):
        e = min(n, s + PIECE)
        piece = data[s : e + length - 1]
        grams = hashers.anchor(piece)
        starts = np.arange(len(piece) - gram + 1)
        values = grams(starts, starts + gram)
        place = _least_places(values, width)
        change = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[change[1:], len(place)] - 1
        whole = hashers.string(piece)
        anchor = place[change]
        # the bytes alone could match around another place of the anchor
        full = whole(change, last + length) + _mix((anchor - change).astype(np.uint64) + np.uint64(length))
        parts.append((values[anchor], anchor + s, change + s, last + s, full))
    if not parts:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e, e, e.astype(np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _all_runs(length: int, gram: int):
    """Rows (row, anchor, pos, full) of texts; pos packs first suffix, anchor's distance and further suffixes."""
    wide = length - gram + 1

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        row, anchor, place, first, last, full = (np.concatenate(c) for c in zip(*held, strict=True))
        pos = (first * wide + place - first) * wide + last - first
        return pa.RecordBatch.from_arrays(
            [pa.array(row), pa.array(anchor.view(np.int64)), pa.array(pos), pa.array(full.view(np.int64))],
            ["row", "anchor", "pos", "full"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hashers()
        for batch in batches:
            held, size = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = runs(_as_bytes(text), hashers, length, gram)
                if len(found[0]):
                    held.append((np.full(len(found[0]), key, np.int64), *found))
                    size += len(found[0])
                if size > 100_000:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    return run


def _unpack(pos: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First suffix, anchor's distance from it, number of further suffixes."""
    return pos // (wide * wide), pos // wide % wide, pos % wide


def _cut_runs(length: int, wide: int):
    """(row, anchor, kinds, first, bytes) of the chosen runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "anchor", "kinds", "first", "data"]
        for batch in batches:
            out: list[tuple] = []
            for key, text, chosen in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = (text or "").encode()
                for r in chosen:
                    first, more = r["pos"] // (wide * wide), r["pos"] % wide
                    out.append((key, r["anchor"], r["kinds"], first, data[first : first + more + length]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return run


def _singles(row, anchor, first, data: list[bytes], length: int, hashers: Hashers) -> tuple[np.ndarray, ...]:
    """(run's number, suffix, hash) of every suffix of many runs."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    whole = hashers.string(np.frombuffer(b"".join(data), np.uint8))
    count = sizes - length + 1
    run = np.repeat(np.arange(len(data)), count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(sizes) - sizes)[run] + offset
    return run, first[run] + offset, whole(start, start + length)


def _order_together(length: int):
    """Repeated suffixes of runs that come sorted by anchor, every anchor's runs in one task."""

    def solve(table: pa.Table, hashers: Hashers) -> Iterator[pa.RecordBatch]:
        row, anchor, first = (table.column(c).to_numpy() for c in ("row", "anchor", "first"))
        run, suffix, value = _singles(row, anchor, first, table.column("data").to_pylist(), length, hashers)
        # equal strings have equal anchors; the anchor makes the pair of hashes
        both = _mix(value + _mix(anchor.view(np.uint64))[run])
        order = np.lexsort([value, both])
        b, v = both[order], value[order]
        same = (b[1:] == b[:-1]) & (v[1:] == v[:-1])
        again = np.zeros(len(b), bool)
        again[order] = np.r_[False, same] | np.r_[same, False]
        at = np.flatnonzero(again)
        if len(at):
            start = np.flatnonzero(np.r_[True, (run[at][1:] != run[at][:-1]) | (at[1:] != at[:-1] + 1)])
            end = np.r_[start[1:], len(at)] - 1
            one = at[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[run[one]]), pa.array(suffix[one]), pa.array(suffix[at[end]] - suffix[one])],
                ["row", "first", "more"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hashers()
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                held.append(batch.slice(s, 2000))
                rows += held[-1].num_rows
                if rows < 5_000:
                    continue
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                # the last anchor may go on in the next batch
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield from solve(table.slice(0, cut), hashers)
                    held = table.slice(cut).to_batches()
                    rows -= cut
        if rows:
            yield from solve(pa.Table.from_batches(held), hashers)

    return run


def _deal_singly(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hashers()
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                table = pa.Table.from_batches([batch.slice(s, 2000)])
                row, anchor, first = (table.column(c).to_numpy() for c in ("row", "anchor", "first"))
                n, suffix, value = _singles(row, anchor, first, table.column("data").to_pylist(), length, hashers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[n]), pa.array(anchor[n]), pa.array(suffix), pa.array(value.view(np.int64))],
                    ["row", "anchor", "first", "value"],
                )

    return run


def repeated_spans(
    texts: DataFrame, *, length: int = LENGTH, gram: int | None = None, together: int = TOGETHER
) -> DataFrame:
    """(row, first, more): the suffixes first ... first + more of a text are repeated.

    `texts` has (row, text); several rows may have one name only if their texts are equal.
    """
    gram = gram or min(GRAM, max(1, length // 3))
    wide = length - gram + 1
    found = stage(
        texts.mapInArrow(lean(_all_runs(length, gram)), "row bigint, anchor bigint, pos bigint, full bigint"), "runs"
    )
    # counts are written before they are joined: a join right above an aggregation cannot split a hot anchor
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    again = stage(again, "again")
    live = stage(found.join(few(again), "anchor", "left_semi"), "live")
    kinds = stage(
        live.groupBy("anchor", "full").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("one")),
        "kinds",
    )
    whole = (
        live.join(few(kinds.where("n > 1").select("anchor", "full")), ["anchor", "full"], "left_semi")
        .select("row", F.col("pos"))
        .select("row", F.expr(f"pos div {wide * wide}").alias("first"), (F.col("pos") % wide).alias("more"))
    )
    several = stage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    chosen = kinds.join(few(several), "anchor").select("one.row", "one.pos", "anchor", "kinds")
    by_row = stage(
        chosen.groupBy("row").agg(F.collect_list(F.struct("anchor", "kinds", "pos")).alias("chosen")), "chosen"
    )
    near = texts.join(few(by_row.select("row")), "row", "left_semi")
    cut = stage(
        near.join(by_row, "row")
        .select("row", "text", "chosen")
        .mapInArrow(lean(_cut_runs(length, wide)), "row bigint, anchor bigint, kinds bigint, first bigint, data binary"),
        "cut",
    )
    rows = "row bigint, first bigint, more bigint"
    small = (
        cut.where(F.col("kinds") <= together)
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(lean(_order_together(length)), rows)
    )
    single = stage(
        cut.where(F.col("kinds") > together).mapInArrow(
            lean(_deal_singly(length)), "row bigint, anchor bigint, first bigint, value bigint"
        ),
        "singles",
    )
    equal = single.groupBy("anchor", "value").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "value")
    equal = stage(equal, "equal")
    large = single.join(equal, ["anchor", "value"], "left_semi").select(
        "row", "first", F.lit(0).cast("bigint").alias("more")
    )
    return whole.unionAll(small).unionAll(large)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): rows named by their id where ids are unique, else by id and text."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    unclear = docs.groupBy("id").count().where("id is null or count > 1")
    row = F.col("id") if unclear.isEmpty() else F.xxhash64("id", "text")
    return docs.select(row.alias("row"), "id", "text")


def removed_ranges(spans: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by spans packed as first * 2**31 + more."""
    out: list[list[int]] = []
    for s in sorted(spans):
        first, more = divmod(s, 1 << 31)
        end = first + more + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in ranges:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _spans_by_row(texts: DataFrame, length: int, how: dict) -> DataFrame:
    spans = repeated_spans(texts.select("row", "text"), length=length, **how)
    packed = F.col("first") * F.lit(1 << 31) + F.col("more")
    return stage(spans.groupBy("row").agg(F.collect_set(packed).alias("spans")), "spans")


def repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **how
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts = _named(docs, id_col, text_col)
    spans = _spans_by_row(texts, length, how)

    @lean
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = (text or "").encode()
                ranges = removed_ranges(packed or [], length)
                kept = without(data, ranges)
                out.append((doc, len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(kinds.names, o, strict=True)) for o in out], schema=kinds
            )

    kinds = pa.schema(
        [
            (id_col, pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()),
        ]
    )
    touched = few(spans.select("row"))
    cut = (
        texts.join(touched, "row", "left_semi")
        .join(spans, "row")
        .select("id", "text", "spans")
        .mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = texts.join(touched, "row", "left_anti").select(
        F.col("id").alias(id_col),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
    return cut.unionAll(rest)


def cut_text(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the ranges; characters that a range only touches stay whole."""
    data = text.encode()
    inside = []
    for a, b in ranges:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        inside.append((a, b))
    return without(data, inside).decode()


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **how
) -> DataFrame:
    """The documents with their repeated strings cut out; all other columns as they are."""
    texts = _named(docs, id_col, text_col)
    unique = texts.schema["row"].dataType
    spans = _spans_by_row(texts, length, how)
    plain = docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty()
    row = F.col(id_col).cast("bigint") if plain else F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))
    named = docs.withColumn("__row", row.cast(unique))
    touched = few(spans.select(F.col("row").alias("__row")))
    mine = named.join(touched, "__row", "left_semi").join(spans.select(F.col("row").alias("__row"), F.col("spans").alias("__spans")), "__row")

    @F.pandas_udf("string")
    def cut(text: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series(
            [cut_text(t or "", removed_ranges(list(p), length)) for t, p in zip(text, packed, strict=True)], dtype=object
        )

    new = mine.withColumn(text_col, cut(text_col, "__spans")).select(*docs.columns)
    rest = named.join(touched, "__row", "left_anti").select(*docs.columns)
    return new.unionAll(rest)
