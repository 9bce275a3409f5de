"""Hard negatives against a loop over all pairs; bounds, ties, copies and odd vectors."""

import random

import numpy as np
import pytest

from boutspark.llm import negatives


def plain(rows, every=10, k_pos=5, k=10, low=30, high=90):
    rows = [
        r for r in rows
        if None not in r and None not in r[2] and sum(float(x) ** 2 for x in r[2]) < 2.0**62
    ]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, (aid, label, q) in enumerate(rows):
        if aid % every:
            continue
        scored = sorted((-score(q, r[2]), r[0], r[1]) for j, r in enumerate(rows) if j != i)
        for s, pid, other in [x for x in scored if x[2] == label][:k_pos]:
            window = [(-n, nid) for n, nid, l in scored if l != label and low * -s <= 100 * -n <= high * -s]
            out += [(aid, pid, rank + 1, nid, -s, n) for rank, (n, nid) in enumerate(window[:k])]
    return sorted(out)


def mined(spark, rows, parts=5, **kw):
    schema = "vec_id bigint, label bigint, vector array<bigint>, id string, gid string, score string, rows string, q string"
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema).repartition(parts)
    return sorted(map(tuple, negatives.mine(df, every=10, **kw).collect()))


def clustered(n, seed, dim=6, spread=4, copies=0):
    r = random.Random(seed)
    centres = [[r.randint(-60, 60) for _ in range(dim)] for _ in range(7)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        rows.append((i, r.randint(0, 3), [x + r.randint(-spread, spread) for x in c]))
    rows += [(n + i, r.randint(0, 3), list(centres[0])) for i in range(copies)]
    return rows


@pytest.mark.parametrize("spread, copies", [(4, 0), (60, 0), (0, 150), (1, 300)])
def test_equal_to_all_pairs(spark, monkeypatch, spread, copies):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    monkeypatch.setattr(negatives, "GROUP", 7)
    monkeypatch.setattr(negatives, "TILE", 3)
    rows = clustered(300, spread + copies, spread=spread, copies=copies)
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    r = random.Random(2)
    rows = [
        (10, None, [1, 2]), (None, 1, [1, 2]), (20, 1, None), (30, 1, [1, None]), (40, 1, []), (50, 1, [3]), (60, 2, [3, 4, 5]),
        (70, 1, [2**40, 1]), (80, 1, [2**30, 5]), (81, 2, [2**29 + 3, 2**29]), (82, 1, [2**30, 2**30]), (83, 1, [-(2**30), 3]),
    ]
    rows += [(i, r.randint(1, 2), [r.randint(-9, 9) for _ in range(r.randint(0, 4))]) for i in range(100, 180)]
    rows += [rows[-1]] * 3 + [(100, 1, [5, 5, 5, 5])] * 2
    assert mined(spark, rows, parts=3) == plain(rows)


def test_empty_and_lonely(spark):
    assert mined(spark, [(5, 1, [1])]) == [] and mined(spark, [(10, 1, [1])]) == []
    assert mined(spark, [(10, 1, [9]), (11, 1, [9])]) == []
    df = spark.createDataFrame([], "vec_id bigint, label bigint, vector array<bigint>")
    assert negatives.mine(df).count() == 0


def test_bounds_spare_scores():
    """In tight clusters most scores are never computed; kept rows are right all the same."""
    r = np.random.default_rng(3)
    centres = r.integers(-200, 200, (40, 16))
    q = np.concatenate([c + r.integers(-1, 2, (50, 16)) for c in centres]).astype(float)
    ids = np.arange(len(q))

    def packed(i):
        return negatives.Rows({"ids": ids[i], "labels": ids[i] * 0, "rows": ids[i], "dim": 16, "data": q[i].astype("<i4").tobytes()})

    group, block = packed(ids[::4]), packed(ids)
    down = negatives.Descent(group, *negatives.spanning_tree(group.q))
    full = group.q @ q.T
    least = np.sort(full, 1)[:, -5]
    best = negatives.Best(len(group.ids), 5)
    for level, score, known in down.walk(block, lambda v: least[v], lambda v: np.full(len(v), np.inf)):
        assert (score[known] == full[level][known]).all()
        best.offer(level, score, block.ids, known)
    want = [sorted(zip(-row, ids))[:5] for row in full]
    assert [list(zip(-s, i)) for s, i in zip(best.score, best.id)] == want
    assert down.scored < 0.7 * down.met
