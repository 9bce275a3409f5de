"""Toxicity categories by a classifier chain.

Linear models predict the categories in a fixed order; each later model sees, besides the
words, the probabilities of the earlier categories. In training these are out-of-fold
predictions, so a later model learns from inputs as uncertain as those it will get.

Inputs are words and beginnings of words (in compounding languages a slur heads many
words), chosen by a chi-square test over counts gathered by Spark; the models are
fitted on at most `MAX_ROWS` labelled documents, chosen by a hash of their id
(documented bound). Scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts have no words and get the models' base rate; labels
that are null, held out or without a document are not used; without a positive or without
a negative label of a category its probability is the constant share of positives (0 with no labels);
repeated rows stay; null ids are scored; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.llm.lean import lean
from boutspark.llm.quality import held_out
from boutspark.shipping import ship

MAX_ROWS = 12_000
MAX_WORDS = 400
MIN_DOCS = 5
FOLDS = 3
#: Lengths of the word beginnings.
HEADS = (4, 5, 6, 7, 8)
_WORDS = re.compile(r"[^\W\d_]+").findall


def terms(text: str | None) -> set[str]:
    """Lower-case words of a text, and their beginnings marked by "*"."""
    words = set(_WORDS((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in HEADS if len(w) > k}


@dataclass
class Chain:
    categories: list[str]
    words: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    def inputs(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)), np.float64)
        number = {w: i for i, w in enumerate(self.words)}
        whole = {w: i for w, i in number.items() if w[-1] != "*"}
        heads: dict[int, dict[str, int]] = {}
        for w, i in number.items():
            if w[-1] == "*":
                heads.setdefault(len(w) - 1, {})[w[:-1]] = i
        for row, t in zip(x, texts, strict=True):
            if not t:
                continue
            words = set(_WORDS(t.lower()))
            for w in whole.keys() & words:
                row[whole[w]] = 1
            for k, known in heads.items():
                # a beginning is shorter than its word
                longer = {w[:k] for w in words if len(w) > k}
                for w in known.keys() & longer:
                    row[known[w]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column per category."""
        out = np.zeros((len(x), len(self.weights)))
        for j, w in enumerate(self.weights):
            out[:, j] = _probability(np.hstack([x, out[:, :j]]), w)
        return out


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    w = np.zeros(x.shape[1] + 1)
    if not len(y):
        w[-1] = -35
        return w
    if y.min() == y.max():
        w[-1] = 35 if y[0] else -35
        return w
    one = np.hstack([x, np.ones((len(x), 1))])
    hold = np.full(len(w), ridge)
    hold[-1] = 1e-6
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -35, 35)))
        grad = one.T @ (p - y) + hold * w
        h = (one * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ one + np.diag(hold)
        step = np.linalg.solve(h, grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 3.0 / max(size, 1e-12))
        if size < 1e-3:
            break
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, chain: Chain) -> Chain:
    """Fit the categories in order, feeding out-of-fold probabilities forward."""
    fed = np.zeros((len(x), 0))
    for j in range(y.shape[1]):
        inputs = np.hstack([x, fed])
        chain.weights.append(fit_linear(inputs, y[:, j]))
        if j + 1 == y.shape[1]:
            break
        apart = np.zeros(len(x))
        for f in range(FOLDS):
            mine = fold == f
            apart[mine] = _probability(inputs[mine], fit_linear(inputs[~mine], y[~mine, j]))
        fed = np.hstack([fed, apart[:, None]])
    return chain


def fit(
    docs: DataFrame,
    targets: DataFrame,
    categories: list[str],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
) -> Chain:
    """`targets` holds one 0/1 column per category; the last is the one that the words are chosen for."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    marks = (
        targets.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(c) for c in categories])
        .dropna()
        .where(~held_out("id"))
        .groupBy("id")
        .agg(*[F.max(c).alias(c) for c in categories])
        .orderBy(F.xxhash64(F.col("id"), F.lit("sample")), "id")
        .limit(max_rows)
    )
    sample = docs.join(F.broadcast(marks), "id")

    @lean
    def seen(batches):
        for batch in batches:
            count: dict[str, list[int]] = {}
            for text, y in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                for w in terms(text):
                    c = count.setdefault(w, [0, 0])
                    c[0] += 1
                    c[1] += y
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(count.keys(), pa.string()),
                    pa.array([c[0] for c in count.values()], pa.int64()),
                    pa.array([c[1] for c in count.values()], pa.int64()),
                ],
                ["word", "n", "hit"],
            )

    last = categories[-1]
    total, hits = marks.agg(F.count("*"), F.sum(last)).first()
    chain = Chain(list(categories), [])
    if total and hits:
        counts = (
            sample.select(last, "text")
            .mapInArrow(seen, "word string, n bigint, hit bigint")
            .groupBy("word")
            .agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
            .where(F.col("n") >= MIN_DOCS)
        )
        off = F.col("hit") * float(total) - F.col("n") * float(hits)
        spread = F.col("n") * (float(total) - F.col("n")) * float(hits) * float(max(total - hits, 1))
        best = (
            counts.where(F.col("n") < float(total))
            .withColumn("chi", F.round(off * off / spread * float(total), 6))
            .orderBy(F.desc("chi"), "word")
            .limit(MAX_WORDS)
        )
        chain.words = sorted(r["word"] for r in best.collect())

    @lean
    def inputs(batches):
        for batch in batches:
            x = chain.inputs(batch.column(batch.num_columns - 1).to_pylist()).astype(np.uint8)
            bits = [r.tobytes() for r in np.packbits(x, axis=1)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(bits, pa.binary())], ["fold", *categories, "bits"]
            )

    fold = ((F.crc32(F.col("id").cast("string")) / 3).cast("bigint") % FOLDS).cast("int")
    kinds = ", ".join(f"`{c}` int" for c in categories)
    rows = (
        sample.select(fold.alias("fold"), *categories, "text")
        .mapInArrow(inputs, f"fold int, {kinds}, bits binary")
        .collect()
    )
    rows = sorted(tuple(r) for r in rows)
    n = len(chain.words)
    x = np.array([np.unpackbits(np.frombuffer(r[-1], np.uint8))[:n] for r in rows], float).reshape(len(rows), n)
    y = np.array([r[1:-1] for r in rows], float).reshape(len(rows), len(categories))
    return fit_chain(x, y, np.array([r[0] for r in rows], int), chain)


def score(docs: DataFrame, chain: Chain, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, p_<category>..., held_out, score, predicted): score is the last category's probability."""
    ship(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]

    @lean
    def run(batches):
        for batch in batches:
            p = chain.predict(chain.inputs(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, j], pa.float64()) for j in range(p.shape[1])]], [id_col, *names]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    cols = ", ".join(f"`{c}` double" for c in names)
    scored = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {cols}")
    return scored.select(
        id_col,
        *names,
        held_out(id_col).alias("held_out"),
        F.col(names[-1]).alias("score"),
        (F.col(names[-1]) >= 0.5).cast("int").alias("predicted"),
    )
