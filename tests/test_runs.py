"""Run operators: golden vectors, and random vectors against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutspark.operators.runs import expand_runs, flag_runs, link_runs, surviving_runs

CHUNK = 4


def vector_frame(spark, vectors, upper=None):
    rows = []
    for key, vec in vectors.items():
        top = upper[key] if upper else vec
        for i, (v, t) in enumerate(zip(vec, top, strict=True)):
            rows.append((key, i, i // CHUNK, float(i), bool(v), bool(t)))
    return spark.createDataFrame(
        rows, "k string, pos long, chunk long, minutes double, flag boolean, top boolean"
    )


def runs_of(spark, vectors, upper=None):
    return flag_runs(
        vector_frame(spark, vectors, upper), F.col("flag"), ["k"], confirm=F.col("top"), chunk_rows=CHUNK
    )


def as_lengths(rows, size):
    out = [0] * size
    for r in rows:
        out[r["start"]] = r["end"] - r["start"] + 1
    return out


def loop_runs(vec):
    """Start and end of every TRUE run, by a plain loop."""
    found, start = [], None
    for i, v in enumerate([*vec, False]):
        if v and start is None:
            start = i
        if not v and start is not None:
            found.append((start, i - 1))
            start = None
    return found


def loop_link(runs, gap):
    linked = []
    for s, e in runs:
        if linked and s - linked[-1][1] - 1 <= gap:
            linked[-1] = (linked[-1][0], e)
        else:
            linked.append((s, e))
    return linked


T, N = True, False
GOLD = [T, T, N, N, T, N, T, T, T]


def test_golden_run_lengths(spark):
    got = as_lengths(runs_of(spark, {"a": GOLD}).collect(), 9)
    assert got == [2, 0, 0, 0, 1, 0, 3, 0, 0]


def test_golden_expand(spark):
    pos = {r["pos"] for r in expand_runs(runs_of(spark, {"a": GOLD})).collect()}
    assert [i in pos for i in range(9)] == GOLD


def test_golden_surviving(spark):
    upper = {"a": [N, T, N, N, N, N, N, N, T]}
    got = as_lengths(surviving_runs(runs_of(spark, {"a": GOLD}, upper)).collect(), 9)
    assert got == [2, 0, 0, 0, 0, 0, 3, 0, 0]


def test_golden_link(spark):
    runs = runs_of(spark, {"a": [T, T, N, N, N, T, N, T, T, T][:10]})
    got = link_runs(runs, ["k"], 3).collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 9)]


def test_golden_intervals(spark):
    df = vector_frame(spark, {"a": GOLD})
    got = as_lengths(flag_runs(df, ~F.col("flag"), ["k"], chunk_rows=CHUNK).collect(), 9)
    assert got == [0, 0, 2, 0, 0, 1, 0, 0, 0]


@pytest.fixture(scope="module")
def many():
    rnd = random.Random(5)
    vectors = {}
    for i in range(120):
        p = rnd.choice([0.05, 0.3, 0.5, 0.8, 0.97, 1.0])
        vectors[f"v{i}"] = [rnd.random() < p for _ in range(rnd.randint(1, 60))]
    return vectors


@pytest.mark.parametrize("gap", [0, 1, 2, 5, 1000])
def test_link_against_loop(spark, many, gap):
    """Covers: gap 0 is a no-op, event count falls with the gap, a huge gap fills the interior."""
    got = {}
    for r in link_runs(runs_of(spark, many), ["k"], gap).collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"]))
    for k, vec in many.items():
        assert sorted(got.get(k, [])) == loop_link(loop_runs(vec), gap), (k, gap)


def test_run_measures_join_over_chunks(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(50, 30, 200)
    rows = [(1, i, i // CHUNK, float(i), float(b)) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "k int, pos long, chunk long, minutes double, base double")
    got = flag_runs(df, F.col("base") > 25, ["k"], measure="base", chunk_rows=CHUNK).collect()
    want = loop_runs(base > 25)
    assert sorted((r["start"], r["end"]) for r in got) == want
    for r in got:
        seg = base[r["start"] : r["end"] + 1]
        assert r["total"] == pytest.approx(seg.sum())
        assert (r["low"], r["high"]) == (seg.min(), seg.max())
        assert r["minutes"] == r["start"]
        if len(seg) > 1:
            assert r["variance"] == pytest.approx(seg.var(ddof=1))
        else:
            assert r["variance"] is None
