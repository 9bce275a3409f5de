"""Balanced mixing: targets against plain water filling, closeness of the mix, defined corner cases."""

import random
import re
from collections import Counter, defaultdict

from boutspark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict) -> dict:
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s])
    order += [None] if None in sizes else []
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed: dict = {}
    total = sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        free = sum(w for s, w in weight.items() if s not in fixed)
        got = {s: rest * w / free for s, w in weight.items() if s not in fixed} if free else {}
        above = [s for s, t in got.items() if t > 3 * sizes[s]]
        if not above:
            return fixed | got
        fixed |= {s: 3.0 * sizes[s] for s in above}


def table(spark, rows, parts=4):
    schema = "doc_id bigint, text string, source string, size string, key string, p string, h string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema).repartition(parts)


def rows_of(n=3000, seed=3):
    r = random.Random(seed)
    names = ["b", "a", "é", "zz", None, "\U0001f600", "hot"]
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else r.choice(names)
        k = r.choice([0, 1, 3, 20, 50, 200]) if i % 500 else 5000
        out.append((i, " \t".join(["w"] * k), source))
    return out


def test_targets_sizes_and_closeness(spark):
    rows = rows_of()
    got = mixing.mix(table(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes: dict = defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    targets = plain_targets(sizes)
    taken, docs, wanted = defaultdict(int), defaultdict(int), defaultdict(float)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source"] == s and r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s]
        assert abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s])
        m = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["times"] in (int(m), int(m) + 1) and r["times"] <= 3 and r["taken"] == r["times"] * r["size"]
        taken[s] += r["taken"]
        docs[s] += r["times"]
        wanted[s] += m
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 3, (s, taken[s], targets[s])
        assert abs(docs[s] - wanted[s]) <= 20


def test_reruns_and_other_partitions_agree(spark):
    rows = rows_of(2000, 5)
    one, two = (
        sorted((r["doc_id"], r["taken"]) for r in mixing.mix(table(spark, rows, p)).collect()) for p in (1, 7)
    )
    assert one == two


def test_many_blocks_and_rounds(spark, monkeypatch):
    """Leftovers of small blocks meet in later rounds and end near the target."""
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = [(i, " ".join(["w"] * (i % 37)), "a" if i % 3 else "b") for i in range(2000)]
    got = mixing.mix(table(spark, rows)).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(7, "a b c", "s")] * 300 + [(None, "x y", None)] * 200 + [(1, None, "t"), (2, "", "t"), (3, "w " * 50_000, "t")]
    got = mixing.mix(table(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert max(r["taken"] - 3 * r["size"] for r in got) <= 0
    by = {r["source"]: r for r in got}
    for s in ("s", None):
        mine = [r["taken"] for r in got if r["source"] == s]
        assert abs(sum(mine) - by[s]["target"]) <= 3
        assert max(mine) - min(mine) <= by[s]["size"]
    assert mixing.mix(table(spark, [(1, None, None)])).collect()[0]["taken"] == 0
    assert mixing.mix(table(spark, rows).where("false")).count() == 0


def test_walk_keeps_words_and_documents():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(0, 40)
        p, z = [r.random() for _ in range(n)], [float(r.randint(0, 9)) for _ in range(n)]
        q, still = mixing.walk(p, z, r.random)
        assert len(still) <= 2 and all(x in (0, 1) for i, x in enumerate(q) if i not in still)
        assert abs(sum(p) - sum(q)) < 1e-6
        assert abs(sum(a * b for a, b in zip(p, z)) - sum(a * b for a, b in zip(q, z))) < 1e-6


def test_walk_keeps_probabilities():
    """Over many walks every document is taken as often as its probability says."""
    r = random.Random(2)
    p, z = [0.2, 0.5, 0.7, 0.35, 0.9, 0.1], [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    sums = [0.0] * 6
    for _ in range(4000):
        sums = [a + b for a, b in zip(sums, mixing.walk(p, z, r.random)[0])]
    assert all(abs(s / 4000 - x) < 0.03 for s, x in zip(sums, p))
