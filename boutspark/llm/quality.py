"""Quality scores by positive-unlabelled learning.

A logistic model over shape features of a text is fitted on trusted positives and on
unlabelled documents by the non-negative risk estimator: with class prior p and loss l,
    p * E_pos[l(+)] + max(0, E_unl[l(-)] - p * E_pos[l(-)]);
where the second part falls below zero the step goes the other way, so the model cannot
win by calling unlabelled text negative. The prior is the share of positives among all
usable labels; where only positives are given it is bounded from the scores themselves.

The fit uses at most `MAX_POSITIVE` + `MAX_UNLABELLED` documents, chosen by a hash of
their id (documented bound; the model has some forty numbers). Scoring is one pass over
all texts without a shuffle.

Defined results: a null or empty text has all features 0 and gets a score like others;
labels that are null, of held-out rows or without a document are not used; without any
positive every score is 0.5; several labels of one document count as their maximum;
repeated rows stay; null ids are scored and not held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.llm.lean import lean
from boutspark.shipping import ship

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 10_000
STEPS = 400
SYMBOLS = b"#$%&*@^~+=<>{}[]\\/_`"
N_FEATURES = 21


def _classes() -> np.ndarray:
    """Shares of byte classes: one column per class."""
    groups = [
        range(65, 91),
        range(97, 123),
        range(48, 58),
        b" ",
        b"\n",
        b"|",
        b"!?",
        SYMBOLS,
        b".,",
        b"\"'();:-",
        range(128, 256),
        [*range(9), *range(11, 32), 127],
    ]
    out = np.zeros((256, len(groups)))
    for j, g in enumerate(groups):
        out[list(g), j] = 1
    return out


_CLASSES = _classes()


def features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES))
    counts = np.zeros((len(texts), 256))
    for i, text in enumerate(texts):
        if not text:
            continue
        counts[i] = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        words = text.split()
        n, kinds = len(words), len(set(words))
        lines = text.split("\n")
        out[i, :9] = (
            np.log1p(len(text)),
            kinds / max(n, 1),
            np.log1p(n),
            np.log1p(len(text) / len(lines)),
            1 - len(set(lines)) / len(lines),
            len(text) / max(n, 1) if n else 0.0,
            np.log1p(len(lines)),
            counts[i].max() / counts[i].sum(),
            # the same word again and again
            sum(map(eq, words, islice(words, 1, None))) / max(n, 1),
        )
    out[:, 9:] = counts @ _CLASSES / np.maximum(counts.sum(axis=1), 1)[:, None]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def _inputs(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z / 4, np.ones((len(z), 1))])

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._inputs(raw) @ self.weights, -35, 35)))


def fit_non_negative(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Minimise the non-negative risk by full gradient steps with momentum terms (Adam)."""
    both = np.vstack([pos, unl])
    scale = both.std(axis=0)
    model = Model(both.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), np.zeros(0), prior)
    p, u = model._inputs(pos), model._inputs(unl)
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        as_negative_u = -np.log(np.maximum(1 - su, 1e-12)).mean()
        as_negative_p = -np.log(np.maximum(1 - sp, 1e-12)).mean()
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        if as_negative_u - prior * as_negative_p >= 0:
            grad = prior * (p.T @ (sp - 1)) / len(p) + down
        else:
            grad = -down
        grad += 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    model.weights = w
    return model


def bound_prior(pos_scores: np.ndarray, unl_scores: np.ndarray) -> float:
    """Least ratio of unlabelled to positive mass above any threshold with enough positives."""
    cuts = np.quantile(pos_scores, np.linspace(0, 0.9, 50))
    ratios = [(unl_scores >= c).mean() / max((pos_scores >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.01, 0.99))


def held_out(id_col: str | Column) -> Column:
    """True where the crc32 of the id as text leaves 1 when divided by 3."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def _sample_features(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Group and features of the chosen documents; their number is bounded by the parameters."""

    @lean
    def run(batches):
        for batch in batches:
            x = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["kind", "x"]
            )

    chosen = docs.join(F.broadcast(ids), "id").select("kind", "text")
    rows = chosen.mapInArrow(run, "kind int, x array<double>").collect()
    kind = np.array([r[0] for r in rows], int)
    x = np.array([r[1] for r in rows]).reshape(len(rows), N_FEATURES)
    # the order in which rows arrive must not change the fit
    order = np.lexsort([*x.T, kind])
    return kind[order], x[order]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model | None:
    """The model, or None where there is no positive to learn from."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labels = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    usable = labels.where(~held_out("id"))
    total, good = usable.agg(F.count("*"), F.sum((F.col("label") == 1).cast("bigint"))).first()
    if not good:
        return None
    by_hash = F.xxhash64(F.col("id"), F.lit("sample"))
    ids = docs.select("id").where("id is not null").distinct()
    pos = ids.join(usable.where("label = 1"), "id", "left_semi").orderBy(by_hash, "id").limit(max_positive)
    rest = ids.join(labels, "id", "left_anti").where(~held_out("id"))
    unl = rest.orderBy(by_hash, "id").limit(max_unlabelled)
    kind, x = _sample_features(docs, pos.withColumn("kind", F.lit(1)).unionAll(unl.withColumn("kind", F.lit(0))))
    if not (kind == 1).any():
        return None
    p, u = x[kind == 1], x[kind == 0]
    if not len(u):
        u = p
    if good < total:
        prior = good / total
    else:
        first = fit_non_negative(p, u, 0.5)
        prior = bound_prior(first.score(p), first.score(u))
    return fit_non_negative(p, u, prior)


def score(docs: DataFrame, model: Model | None, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    ship(docs.sparkSession)

    @lean
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = model.score(features(texts)) if model is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(
        id_col,
        held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model | None, *, text_col="text") -> DataFrame:
    """The documents with a score of 0.5 or more; all columns as they are."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(text.tolist())) if model is not None else np.full(len(text), 0.5))

    return docs.where(scores(F.col(text_col)) >= 0.5)
