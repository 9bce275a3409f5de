"""Byte-level BPE encoding and decoding by a segment tree of pair ranks.

Every match of the split pattern is encoded by itself. A tree over its byte positions
holds, in each leaf, the rank of the pair that starts there (none: a large number)
and, in each node, the least rank below it with the leftmost place. The root names the
next merge; a merge changes the pairs of the merged token and of its left neighbour
and drops one leaf: three point updates of logarithmic cost.

Short matches are encoded together, one tree per row of a matrix; longer ones alone.
A task keeps the codes of what it met last (two lots of about `CACHE`, only to save
time), a Python worker reads the tables once; documents need no shuffle.

Defined results: a null text counts as empty; an empty text has no ids and decodes to
no bytes; row order, repeated rows and ids are kept as they are; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.llm.lean import lean
from boutspark.shipping import ship

CACHE = 150_000
TOGETHER = 32
ROWS = 8_000
NARROW = 1 << 20
NONE = 1 << 40


class Vocabulary:
    """Token bytes by id, and the rank of every pair of ids that merges."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.said = {r: f" {r}" for r in self.bytes_of}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {
            (ranks[t[:i]], ranks[t[i:]]): r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        most = max(ranks.values(), default=0)
        if most >= NARROW:
            raise ValueError("ids beyond the tree's width")
        self.byte_pairs = np.full(65536, NARROW, np.int32)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a * 256 + b] = ranks.get(bytes([a, b]), NARROW)
        # open addressing over a power of two; few keys are not at their first place
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NARROW, np.int32)
        self._most = 0
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        for key, home, rank in zip(
            keys.tolist(), self._home(keys).tolist(), self.pairs.values(), strict=True
        ):
            steps = 0
            while self._keys[home] != -1:
                home, steps = (home + 1) & self._mask, steps + 1
            self._keys[home], self._ranks[home] = key, rank
            self._most = max(self._most, steps)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self._shift).astype(np.int64)

    def narrow_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NARROW where they do not merge or a side is -1."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._home(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._ranks[at], np.int32(NARROW))
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self._most):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self._mask
            found = self._keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def encode_one(data: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one match; a tree of Python numbers, rank * size + place in every node."""
    n = len(data)
    ids = [int(vocab.byte_ids[b]) for b in data]
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    none = NONE * size
    pairs = vocab.pairs
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = pairs.get((ids[i], ids[i + 1]))
        if r is not None:
            tree[size + i] = r * size + i
    for v in range(size - 1, 0, -1):
        tree[v] = min(tree[2 * v], tree[2 * v + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        v = size + i
        tree[v] = value
        v >>= 1
        while v:
            value = min(tree[2 * v], tree[2 * v + 1])
            if tree[v] == value:
                break
            tree[v] = value
            v >>= 1

    def rank_at(i: int) -> int:
        r = pairs.get((ids[i], ids[after[i]])) if after[i] < n else None
        return none if r is None else r * size + i

    while tree[1] < none:
        rank, i = divmod(tree[1], size)
        j = after[i]
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, rank_at(i))
        if before[i] >= 0:
            put(before[i], rank_at(before[i]))
    return [x for x in ids if x >= 0]


def encode_together(datas: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Ids of many short matches, one segment tree per row of a matrix.

    A node holds rank * width + place, so that its minimum is the leftmost least rank.
    """
    rows = len(datas)
    lengths = np.fromiter(map(len, datas), np.int64, rows)
    size = 1 << max(1, int(lengths.max() - 1).bit_length())
    width = 2 * size
    raw = np.frombuffer(b"".join(d.ljust(size, b"\0") for d in datas), np.uint8).reshape(rows, size)
    place = np.arange(size, dtype=np.int32)
    none = np.int32(NARROW * size)
    ranks = vocab.byte_pairs[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]
    grid = np.full((rows, width), none, np.int32)
    grid[:, size:-1] = np.where(
        (ranks < NARROW) & (place[:-1] < lengths[:, None] - 1), ranks * size + place[:-1], none
    )
    level = size
    while level > 1:
        np.minimum(
            grid[:, level : 2 * level : 2], grid[:, level + 1 : 2 * level : 2], out=grid[:, level // 2 : level]
        )
        level //= 2
    tree = grid.ravel()
    # columns before and behind the tokens take what points outside
    wide = size + 2
    ids = np.full((rows, wide), -1, np.int32)
    ids[:, 1:-1] = vocab.byte_ids[raw]
    ids[:, 1:-1][place >= lengths[:, None]] = -1
    ids = ids.ravel()
    after = np.tile(np.arange(1, wide + 1, dtype=np.int32), rows)
    before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), rows)
    top = np.arange(rows) * width
    flat = np.arange(rows) * wide
    live = tree[top + 1] < none
    while live.any():
        top, flat = top[live], flat[live]
        root = tree[top + 1]
        rank, i = root // size, root % size
        at = flat + 1 + i
        gone = flat + after[at]
        behind = after[gone]
        ids[at] = rank
        ids[gone] = -1
        after[at] = behind
        before[flat + np.minimum(behind, wide - 1)] = i + 1
        head = before[at]
        lead = flat + head
        r1 = vocab.narrow_ranks(rank, ids[flat + np.minimum(behind, wide - 1)])
        r0 = vocab.narrow_ranks(ids[lead], rank)
        j = gone - flat - 1
        has = head > 0
        leaf = np.concatenate([top + size + j, top + size + i, (top + size + head - 1)[has]])
        tree[leaf] = np.concatenate(
            [
                np.full(len(j), none, np.int32),
                np.where(r1 < NARROW, r1 * size + i, none),
                np.where(r0 < NARROW, r0 * size + head - 1, none)[has],
            ]
        )
        base = np.concatenate([top, top, top[has]])
        v = (leaf - base) >> 1
        while v[0]:
            twin = base + 2 * v
            tree[base + v] = np.minimum(tree[twin], tree[twin + 1])
            v >>= 1
        live = tree[top + 1] < none
    kept = ids.reshape(rows, wide)[:, 1:-1]
    keep = kept >= 0
    codes = kept[keep].tolist()
    out, s = [], 0
    for e in np.cumsum(keep.sum(axis=1)).tolist():
        out.append(codes[s:e])
        s = e
    return out


class Encoder:
    """Splits texts and encodes their matches, keeping the codes of chunks met before.

    A single space always starts a match, so a text without double spaces falls into
    chunks at its spaces; the codes of a chunk do not depend on what is around it.
    """

    def __init__(self, vocab: Vocabulary, pattern: str):
        import regex

        # the rank files' libraries take white space by its Unicode property
        self._find = regex.compile(
            pattern.replace(r"\s\p", r"\p{White_Space}\p").replace(r"\s", r"\p{White_Space}").replace(
                r"\S", r"\P{White_Space}"
            )
        ).findall
        self.vocab = vocab
        self._new: dict[str, tuple] = {}
        self._old: dict[str, tuple] = {}

    def _matches(self, chunk: str) -> list[str]:
        # letters behind a space or a letter; behind other signs, such as an apostrophe, the pattern decides
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        return self._find(chunk)

    def _codes(self, words: set[str]) -> dict[str, list[int]]:
        codes: dict[str, list[int]] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if len(data) > TOGETHER:
                codes[word] = encode_one(data, self.vocab)
            else:
                by_size.setdefault((len(data) - 1).bit_length(), []).append((word, data))
        for group in by_size.values():
            for s in range(0, len(group), ROWS):
                part = group[s : s + ROWS]
                found = encode_together([d for _, d in part], self.vocab)
                codes.update(zip((w for w, _ in part), found, strict=True))
        return codes

    def encode(self, texts: list[str | None]) -> list[list[tuple[str, bytes]]]:
        """For each text its chunks, each as (" id id ...", the bytes that the ids stand for)."""
        parts: list[list[str]] = []
        for t in texts:
            if not t:
                parts.append([])
            elif "  " in t or t[0] == " " or t[-1] == " ":
                parts.append([m[1:] if m[0] == " " and m[1:2] != " " else " " + m for m in self._find(t)])
            else:
                words = t.split(" ")
                words[0] = " " + words[0]
                parts.append(words)
        if len(self._new) > CACHE:
            self._old, self._new = self._new, {}
        met, old = self._new, self._old
        # the chunks of this call, in a dict that the processor's cache can hold
        here: dict[str, tuple[str, bytes]] = {}
        missing = []
        for chunk in set().union(*parts):
            code = met.get(chunk)
            if code is None:
                code = old.get(chunk)
                if code is None:
                    missing.append(chunk)
                    continue
                met[chunk] = code
            here[chunk] = code
        # nothing made here is cyclic, and the collector would walk all of it again and again
        gc.disable()
        # a key stands for the chunk of a space and itself, or without its own first space
        split = [self._matches(c[1:] if c[:1] == " " else " " + c) for c in missing]
        codes = self._codes({w for m in split for w in m})
        bytes_of, said = self.vocab.bytes_of, self.vocab.said
        for chunk, words in zip(missing, split, strict=True):
            ids = codes[words[0]] if len(words) == 1 else [i for w in words for i in codes[w]]
            met[chunk] = here[chunk] = (
                "".join([said[i] for i in ids]),
                b"".join([bytes_of[i] for i in ids]),
            )
        gc.enable()
        return [[here[c] for c in p] for p in parts]


_KEPT: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The tables of this Python worker."""
    if path not in _KEPT:
        _KEPT[path] = Vocabulary(path)
    return _KEPT[path]


def encoder(path: str, pattern: str) -> Encoder:
    """An encoder for one task; what it has met goes with it."""
    return Encoder(vocabulary(path), pattern)


def _by_chars(texts: list[str | None], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids array<int>) of every row."""

    ship(docs.sparkSession)

    @lean
    def run(batches):
        enc = encoder(ranks, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in _by_chars(texts):
                codes = enc.encode(texts[s:e])
                lists = [list(map(int, "".join([c[0] for c in doc]).split())) for doc in codes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), pa.array(lists, pa.list_(pa.int32()))], [id_col, "ids"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_bytes(ids: list[int], vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.bytes_of.__getitem__, ids))


def decode(encoded: DataFrame, ranks: str, pattern: str, *, id_col="doc_id") -> DataFrame:
    """(id, data binary) of every row of ids."""

    ship(encoded.sparkSession)

    @lean
    def run(batches):
        vocab = vocabulary(ranks)
        for batch in batches:
            data = [decode_bytes(x or [], vocab) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, data binary")


def encode_digests(docs: DataFrame, ranks: str, pattern: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass over the texts."""

    ship(docs.sparkSession)

    @lean
    def run(batches):
        enc = encoder(ranks, pattern)
        bytes_of = enc.vocab.bytes_of
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in _by_chars(texts):
                n, a, b = [], [], []
                for doc in enc.encode(texts[s:e]):
                    said = "".join([c[0] for c in doc])
                    n.append(said.count(" "))
                    a.append(hashlib.sha256(said[1:].encode()).hexdigest())
                    b.append(hashlib.sha256(b"".join([c[1] for c in doc])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
