"""Alignment of two tokenizers' tokens over the same bytes.

A byte-level BPE (A) reads a space and the text, a SentencePiece model with byte fallback (B)
the text, before which it puts that space. Where tokens of both end at one byte, the text can
be cut; what lies between two cuts is a group, and all its A and B tokens are linked.

Ids come from the libraries, once for each distinct piece between single spaces that a task
meets; the alignment works on whole documents. Cuts are found by divide and conquer: for an interval with the same bytes on both sides the
common end nearest to its middle token is located, A's ends being looked up among B's by
bisect, in rings that double their width; both halves go on by themselves, and an interval
without a common end inside is a leaf group. All intervals of a block of documents take such
a step together, so a step is a few array operations and there are about as many steps as the
logarithm of the longest document.

How many documents of the corpus hold an id pair linked takes three passes. Blocks of
documents (`BLOCK_BYTES` of text) are aligned and written with a numbered list of their
distinct pairs; the lists are summed by pair; and the sums come back to the blocks, where
they are added up over each document's links. Pairs move once per block that holds them, not
once per document, and a pair that every document holds is one row per block. The greatest
count per A id is a table of at most as many rows as A's vocabulary has ids, and is broadcast
for that reason.

Defined results: a null or empty text, and one whose joined token bytes differ from the space
and the text on either side, has no tokens and no links (zeros, digest ''); repeated rows and
repeated or null ids are documents of their own and count as such; every row gives one output
row; an empty table gives an empty result; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.llm.lean import lean
from boutspark.shipping import ship
from boutspark.staging import stage

BLOCK_BYTES = 8_000_000  # text of a block
BLOCK_ROWS = 20_000
CHUNK_CHARS = 250_000  # text that is aligned at once
KEPT_PIECES, KEPT_IDS = 300_000, 4_000_000  # pieces with their ids that a task keeps, only to save time
SMALL_GROUP = 4_096  # links up to which a group's links are listed one by one


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes are themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str) -> list[str]:
    """The text cut at single spaces between two other characters, without those spaces.

    Both tokenizers start anew at such a space: A's pattern takes it to what follows, and
    no piece of B has its space mark after another character.
    """
    parts = text.split(" ")
    if parts == text.split():
        return parts
    out, held, last = [], [parts[0]], parts[0][-1:]
    for part in parts[1:]:
        if part and last and not part[0].isspace() and not last.isspace():
            out.append(" ".join(held))
            held = []
        held.append(part)
        last = part[-1:]
    out.append(" ".join(held))
    return out


class Numbers(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Tokens:
    """Both tokenizers of a task; ids and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocab = self._a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(map(alphabet.__getitem__, entry))
        b = self._b
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(b.id_to_piece, range(b.get_piece_size())))
        ]
        if any("▁" in b.id_to_piece(i).lstrip("▁") for i in range(b.get_piece_size())):
            raise ValueError("a piece of this model crosses the start of a run of spaces")
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64) for x in (self.a_bytes, self.b_bytes))

        self._forget()

    def _forget(self) -> None:
        self._number = Numbers()
        self._right = np.zeros(0, bool)
        self._ids = [(np.zeros(0, np.int64), np.zeros(1, np.int64)) for _ in "ab"]

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces not met before, each as a text of its own."""
        sides = (
            [x.ids for x in self._a.encode_batch_fast([" " + t for t in new], add_special_tokens=False)],
            self._b.encode(new, num_threads=1),
        )
        raw = [b" " + t.encode() for t in new]
        right = np.ones(len(new), bool)
        for k, (ids, said) in enumerate(zip(sides, (self.a_bytes, self.b_bytes), strict=True)):
            right &= [b"".join(map(said.__getitem__, x)) == r for x, r in zip(ids, raw, strict=True)]
            flat, bounds = self._ids[k]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.r_[flat, np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum())]
            self._ids[k] = (flat, np.r_[bounds, bounds[-1] + np.cumsum(sizes)])
        self._right = np.r_[self._right, right]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, bounds of each) of A and of B; none where a side does not give the text back."""
        if len(self._number) > KEPT_PIECES or max(len(x) for x, _ in self._ids) > KEPT_IDS:
            self._forget()
        number = self._number
        before = len(number)
        found = []
        for text in texts:
            cut = pieces(text) if text else []
            found.append(np.fromiter(map(number.__getitem__, cut), np.int64, len(cut)))
        if len(number) > before:
            self._learn(list(islice(number, before, None)))
        found = [x if self._right[x].all() else x[:0] for x in found]
        pieces_of = np.cumsum([0, *map(len, found)])
        taken = np.concatenate(found) if found else np.zeros(0, np.int64)
        out = []
        for flat, bounds in self._ids:
            sizes = np.diff(bounds)[taken]
            ends = np.r_[0, np.cumsum(sizes)]
            at = np.arange(ends[-1]) + np.repeat(bounds[taken] - ends[:-1], sizes)
            out.append((flat[at], ends[pieces_of]))
        return out


def leaf_groups(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray):
    """Starts of the groups among A's and among B's tokens, in order.

    Ends rise strictly over all documents; document d has A tokens a_bounds[d] to
    a_bounds[d + 1] and B tokens likewise, over the same bytes.
    """
    held = a_bounds[1:] > a_bounds[:-1]
    lo, hi = a_bounds[:-1][held], a_bounds[1:][held]
    b_lo, b_hi = b_bounds[:-1][held], b_bounds[1:][held]
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lo):
        single = (hi - lo < 2) | (b_hi - b_lo < 2)
        leaves.append((lo[single], b_lo[single]))
        lo, hi, b_lo, b_hi = lo[~single], hi[~single], b_lo[~single], b_hi[~single]
        middle = (lo + hi) // 2 - 1
        cut = np.full(len(lo), -1)
        b_cut = np.full(len(lo), -1)
        todo = np.arange(len(lo))
        near, far = 0, 1
        while len(todo):
            # ends inside the interval, near to far from the middle
            away = np.arange(near, far)
            ring = np.stack([-away, away], 1).ravel() if near else away
            at = middle[todo, None] + ring
            inside = (at >= lo[todo, None]) & (at < hi[todo, None] - 1)
            rows, columns = np.nonzero(inside)
            end = a_ends[at[rows, columns]]
            found = np.searchsorted(b_ends, end)
            common = b_ends[found] == end
            rows, columns, found = rows[common], columns[common], found[common]
            first = np.ones(len(rows), bool)
            first[1:] = rows[1:] != rows[:-1]
            rows, columns, found = rows[first], columns[first], found[first]
            cut[todo[rows]] = at[rows, columns]
            b_cut[todo[rows]] = found
            open_ = cut[todo] < 0
            # rings that lie outside on both sides end the search
            open_ &= (middle[todo] - far >= lo[todo]) | (middle[todo] + far < hi[todo] - 1)
            todo = todo[open_]
            near, far = far, 2 * far + 1
        leaf = cut < 0
        leaves.append((lo[leaf], b_lo[leaf]))
        go = ~leaf
        lo, hi = np.r_[lo[go], cut[go] + 1], np.r_[cut[go] + 1, hi[go]]
        b_lo, b_hi = np.r_[b_lo[go], b_cut[go] + 1], np.r_[b_cut[go] + 1, b_hi[go]]
    a_start = np.concatenate([x for x, _ in leaves]) if leaves else np.zeros(0, np.int64)
    b_start = np.concatenate([x for _, x in leaves]) if leaves else np.zeros(0, np.int64)
    order = np.argsort(a_start)
    return a_start[order], b_start[order]


class Aligned:
    """Tokens and groups of some texts, laid end to end."""

    def __init__(self, tokens: Tokens, texts: list[str | None]):
        (self.a, self.a_bounds), (self.b, self.b_bounds) = tokens.encode(texts)
        a_ends, b_ends = np.cumsum(tokens.a_sizes[self.a]), np.cumsum(tokens.b_sizes[self.b])
        self.a_start, self.b_start = leaf_groups(a_ends, b_ends, self.a_bounds, self.b_bounds)
        #: First group of each document.
        self.g_bounds = np.searchsorted(self.a_start, self.a_bounds)
        self.n_a = np.diff(np.r_[self.a_start, len(self.a)])
        self.n_b = np.diff(np.r_[self.b_start, len(self.b)])

    def __len__(self) -> int:
        return len(self.a_bounds) - 1

    def links(self) -> np.ndarray:
        """Links of every document."""
        before = np.r_[0, np.cumsum(self.n_a * self.n_b)]
        return np.diff(before[self.g_bounds])

    def said(self, heads: tuple[list[str], ...]) -> list[str]:
        """Groups of every document as text; `heads` are the ids of both sides with what stands before them."""
        a_next, a_first, b_next, b_first = heads
        group_a = np.repeat(np.arange(len(self.a_start)), self.n_a)
        group_b = np.repeat(np.arange(len(self.b_start)), self.n_b)
        # A's tokens of a group come before B's
        a_at = np.arange(len(self.a)) + self.b_start[group_a]
        b_at = np.arange(len(self.b)) + (self.a_start + self.n_a)[group_b]
        a_is_first = np.zeros(len(self.a), bool)
        a_is_first[self.a_start] = True
        b_is_first = np.zeros(len(self.b), bool)
        b_is_first[self.b_start] = True
        size = len(a_next)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[a_at] = self.a + a_is_first * size
        code[b_at] = 2 * size + self.b + b_is_first * len(b_next)
        parts = list(map((a_next + a_first + b_next + b_first).__getitem__, code.tolist()))
        bounds = (self.a_bounds + self.b_bounds).tolist()
        return ["".join(parts[s:e])[1:] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of the distinct linked pairs a * width + b of every document, sorted."""
        doc = np.searchsorted(self.g_bounds, np.arange(len(self.a_start)), side="right") - 1
        product = self.n_a * self.n_b
        small = np.flatnonzero(product <= SMALL_GROUP)
        n = product[small]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = np.repeat(small, n)
        i, j = np.divmod(place, self.n_b[group])
        docs = [doc[group]]
        pairs = [self.a[self.a_start[group] + i] * width + self.b[self.b_start[group] + j]]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(product > SMALL_GROUP).tolist():
            x, nx = np.unique(self.a[self.a_start[g] : self.a_start[g] + self.n_a[g]], return_counts=True)
            y, ny = np.unique(self.b[self.b_start[g] : self.b_start[g] + self.n_b[g]], return_counts=True)
            pairs.append((x[:, None] * width + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            docs.append(np.full(len(pairs[-1]), doc[g]))
        docs, pairs, times = map(np.concatenate, (docs, pairs, times))
        order = np.lexsort((pairs, docs))
        docs, pairs, times = docs[order], pairs[order], times[order]
        first = np.ones(len(docs), bool)
        first[1:] = (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])
        at = np.flatnonzero(first)
        return docs[at], pairs[at], np.add.reduceat(times, at) if len(at) else times


def _chunks(texts: list[str | None]):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def groups(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, a_starts, b_starts) of every row: tokens, and the first token of each group on both sides."""
    ship(docs.sparkSession)

    @lean
    def run(batches):
        tokens = Tokens(a, b)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1).to_pylist()):
                x = Aligned(tokens, texts)
                lists = (
                    (x.a, x.a_bounds, np.zeros(len(x), np.int64)),
                    (x.b, x.b_bounds, np.zeros(len(x), np.int64)),
                    (x.a_start, x.g_bounds, x.a_bounds[:-1]),
                    (x.b_start, x.g_bounds, x.b_bounds[:-1]),
                )
                columns = [batch.column(0).slice(at, len(x))]
                for values, bounds, base in lists:
                    values = values - np.repeat(base, np.diff(bounds))
                    columns.append(pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(values, pa.int32())))
                at += len(x)
                yield pa.RecordBatch.from_arrays(columns, [id_col, "a_ids", "b_ids", "a_starts", "b_starts"])

    kind = docs.schema[id_col].dataType.simpleString()
    lists = ", ".join(f"{n} array<int>" for n in ("a_ids", "b_ids", "a_starts", "b_starts"))
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {lists}")


def _block_rows(tokens: Tokens, width: int, heads, block: int, ids: pa.Array, texts: list[str | None], names):
    """One row per document, and one with the block's distinct pairs and the documents that hold each."""
    columns: dict[str, list] = {n: [] for n in ("n_a", "n_b", "n_groups", "n_links")}
    digests: list[str] = []
    docs, pairs, times = [], [], []
    for chunk in _chunks(texts):
        x = Aligned(tokens, chunk)
        columns["n_a"].append(np.diff(x.a_bounds))
        columns["n_b"].append(np.diff(x.b_bounds))
        columns["n_groups"].append(np.diff(x.g_bounds))
        columns["n_links"].append(x.links())
        d, p, t = x.pairs(width)
        docs.append(d + len(digests))
        pairs.append(p)
        times.append(t)
        digests += [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.said(heads)]
    docs, pairs, times = map(np.concatenate, (docs, pairs, times))
    distinct, place, held = np.unique(pairs, return_inverse=True, return_counts=True)
    n = len(texts)
    bounds = np.searchsorted(docs, np.arange(n + 1)).astype(np.int32)

    def padded(values: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([values, pa.nulls(1, kind)])

    lists = pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([block] * (n + 1), pa.int64()),
            padded(ids, ids.type),
            *[padded(pa.array(np.concatenate(columns[c]), pa.int64()), pa.int64()) for c in columns],
            padded(pa.array(digests, pa.string()), pa.string()),
            padded(pa.ListArray.from_arrays(bounds, pa.array(place, pa.int32())), lists),
            padded(pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())), lists),
            pa.array([None] * n + [distinct], pa.list_(pa.int64())),
            pa.array([None] * n + [held.astype(np.int32)], lists),
        ],
        names,
    )


def _summed(key, left, right):
    """Counts of the block's pairs, added up over the links of its documents."""
    order = np.argsort(right.column("pos").to_numpy())
    count = right.column("count").to_numpy()[order]
    best = right.column("best").to_numpy(zero_copy_only=False)[order]
    left = left.combine_chunks()
    lists = [left.column(n).combine_chunks() for n in ("places", "times")]
    sizes = np.asarray(lists[0].value_lengths().fill_null(0), np.int64)
    place, times = (x.flatten().to_numpy().astype(np.int64) for x in lists)
    if len(place):
        worth = np.r_[0, np.cumsum(times * count[place])]
        top = np.r_[0, np.cumsum(times * best[place])]
    else:
        worth = top = np.zeros(1, np.int64)
    bounds = np.r_[0, np.cumsum(sizes)]
    kept = left.drop_columns(["block", "places", "times"])
    kept = kept.append_column("n_best", pa.array(np.diff(top[bounds]), pa.int64()))
    return kept.append_column("count_sum", pa.array(np.diff(worth[bounds]), pa.int64()))


def align(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    `a` and `b` are files that every executor has.
    """
    ship(docs.sparkSession)
    with open(a, encoding="utf-8") as file:
        a_size = max(json.load(file)["model"]["vocab"].values()) + 1
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
        " places array<int>, times array<int>, pairs array<bigint>, held array<int>"
    )
    names = [n for part in schema.split(",") for n in part.split()[:1]]

    @lean
    def run(batches):
        tokens = Tokens(a, b)
        heads = tuple(
            [mark + str(i) for i in range(n)] for n, marks in ((a_size, ",;"), (width, ",|")) for mark in marks
        )
        part = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        size = rows = n = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            rows += batch.num_rows
            if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                yield from block(part + n, held, tokens, heads)
                held, size, rows, n = [], 0, 0, n + 1
        if rows:
            yield from block(part + n, held, tokens, heads)

    def block(number, held, tokens, heads):
        ids = pa.concat_arrays([x.column(0) for x in held])
        texts = [t for x in held for t in x.column(1).to_pylist()]
        return _block_rows(tokens, width, heads, number, ids, texts, names)

    aligned = stage(docs.select(id_col, text_col).mapInArrow(run, schema), "aligned")
    lists = aligned.where("pairs is not null").select(
        "block", F.posexplode(F.arrays_zip("pairs", "held")).alias("pos", "at")
    )
    lists = lists.select("block", "pos", F.col("at.pairs").alias("pair"), F.col("at.held").alias("held"))
    counts = stage(lists.groupBy("pair").agg(F.sum("held").alias("count")), "pair_counts")
    # at most one row per id of A's vocabulary
    top = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("count").alias("top"))
    marked = (
        counts.withColumn("a", F.expr(f"pair div {width}"))
        .join(F.broadcast(top), "a")
        .select("pair", "count", F.expr("count = top").alias("best"))
    )
    back = lists.select("block", "pos", "pair").join(marked, "pair").select(
        F.col("block").alias("of"), "pos", "count", "best"
    )
    rows = aligned.where("pairs is null").drop("pairs", "held")
    out = schema.split(", places")[0].removeprefix("block bigint, ")
    summed = (
        rows.groupBy("block")
        .cogroup(back.groupBy("of"))
        .applyInArrow(_summed, f"{out}, n_best bigint, count_sum bigint")
    )
    return summed.select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
