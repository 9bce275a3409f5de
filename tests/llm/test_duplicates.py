"""Near-duplicates, repeated strings, components and contamination against plain versions."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from boutspark.llm import components, decontam, neardup, suffixes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_set(text, size=5):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain_near(rows, percent=85):
    """component by id, over (id, text) rows with ids."""
    sets = [(i, plain_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i in up}


def words(r, n, kinds=400):
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def near_rows(seed=3):
    r = random.Random(seed)
    rows = [None, "", " \n ", "one two", "One  TWO", "one two three four five", "a" * 5000, "x " * 3000]
    for _ in range(12):
        base = words(r, r.randint(20, 300))
        rows.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(400)}"
            rows.append(" ".join(copy))
        rows.append(" ".join(base))
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    return rows + [(5, rows[10][1]), (5, rows[30][1]), (5, rows[30][1]), (None, rows[10][1]), (None, None)]


def test_near_duplicates(make):
    rows = near_rows()
    got = neardup.near_duplicates(make(rows)).collect()
    want = plain_near(rows)
    # an id on several rows is one document
    shared = {want[i] for i in (5, rows[10][0], rows[30][0])}
    want = {i: min(shared) if c in shared else c for i, c in want.items()}
    assert len(got) == len(rows)
    for g in got:
        if g["doc_id"] is None:
            assert g["component_id"] is None and g["kept"]
        else:
            assert g["component_id"] == want[g["doc_id"]], g
            assert g["kept"] == (g["doc_id"] == g["component_id"])
    sizes = sorted(len(plain_set(t)) for _, t in rows)
    assert sorted(g["n_shingles"] for g in got) == sizes


def test_near_duplicates_at_80(make):
    rows = [r for r in near_rows(11) if r[0] not in (5, None)]
    got = neardup.near_duplicates(make(rows), percent=80).collect()
    assert {g["doc_id"]: g["component_id"] for g in got} == plain_near(rows, 80)


@pytest.mark.parametrize(("percent", "rows"), [(85, 5), (80, 4)])
def test_bands_for_a_similarity(percent, rows):
    assert neardup.rows_of(percent) == rows
    assert (1 - (percent / 100) ** rows) ** (neardup.BINS // rows) < 1e-6


def test_near_duplicates_of_nothing(make):
    assert neardup.near_duplicates(make([])).count() == 0
    assert neardup.near_duplicates(make([None, ""])).where("kept").count() == 2


def test_a_large_bucket_is_compared_in_blocks(make, monkeypatch):
    """Copies that differ too much from the first one, but not from each other, in pieces of three."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    r = random.Random(9)
    base = words(r, 200, 5000)
    rows, now = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(now)))
        now = list(now)
        for _ in range(3):
            now[r.randrange(200)] = f"v{i}_{r.random()}"
    got = {g["doc_id"]: g["component_id"] for g in neardup.near_duplicates(make(rows)).collect()}
    assert got == plain_near(rows)


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        assert (neardup.sketch(np.unique(neardup.mix(r.integers(0, 2**62, n, dtype=np.uint64)))) != 0).all()
    errors = []
    for _ in range(30):
        both = r.integers(0, 2**62, 800, dtype=np.uint64)
        a = np.unique(neardup.mix(np.r_[both, r.integers(0, 2**62, 100, dtype=np.uint64)]))
        b = np.unique(neardup.mix(np.r_[both, r.integers(0, 2**62, 100, dtype=np.uint64)]))
        errors.append((neardup.sketch(a) == neardup.sketch(b)).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_keep_first(make):
    rows = near_rows()
    docs = make(rows)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    got = neardup.near_duplicates(docs)
    ids = {r["doc_id"] for r in got.where("kept and doc_id is not null").collect()}
    out = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in out if i is not None) == sorted(ids)
    assert out.count(None) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(150), r.randrange(150)) for _ in range(100)] + [(i, i + 1) for i in range(200, 260)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    found = {g["node"]: g["comp"] for g in got}
    assert len(found) == len(got)
    assert found == {n: find(n) for n in up if any(n in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_repeats(texts, length):
    datas = [(t or "").encode() for t in texts]
    count = {}
    for d in datas:
        for s in range(len(d) - length + 1):
            count[d[s : s + length]] = count.get(d[s : s + length], 0) + 1
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if count[d[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(d) else 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if len(d) else b""
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ñ") for _ in range(r.randint(1, 9)))
    pieces = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)]
    texts = [None, "", "x", "a" * 700, "ab" * 300, "é" * 90]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(r.choice(pieces) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(3, 50))))
        text = " ".join(parts)
        if r.random() < 0.3:
            k = r.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        texts.append(text)
    return texts + texts[10:14]


@pytest.mark.parametrize(("length", "together"), [(40, 2000), (40, 2), (200, 2000), (100, 0), (3, 2000)])
def test_repeats(make, length, together):
    texts = repeat_texts()
    rows = [*enumerate(texts), (7, texts[7]), (8, "another text of a repeated id " * 9), (None, texts[20]), (None, "z")]
    got = suffixes.repeats(make(rows), length=length, together=together).collect()
    want = plain_repeats([t for _, t in rows], length)
    found = sorted((str(g["doc_id"]), g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for g in got)
    assert found == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))


def test_repeats_with_unique_ids(make):
    texts = repeat_texts(5)
    got = {g["doc_id"]: g for g in suffixes.repeats(make(texts), length=60).collect()}
    want = plain_repeats(texts, 60)
    assert {i: (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for i, g in got.items()} == dict(enumerate(want))
    assert suffixes.repeats(make([])).count() == 0


def test_runs_over_piece_edges(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 50)
    data = np.frombuffer(bytes(random.Random(2).choices(b"ab", k=400)), np.uint8)
    whole = suffixes.runs(data, suffixes.Hashers(), 40, 12)
    monkeypatch.setattr(suffixes, "PIECE", 1 << 19)
    same = suffixes.runs(data, suffixes.Hashers(), 40, 12)
    spread = lambda f: [(int(p), s) for p, a, b in zip(f[1], f[2], f[3], strict=True) for s in range(a, b + 1)]
    assert spread(whole) == spread(same) and len(spread(whole)) == 361


def test_leftmost_least_places():
    r = np.random.default_rng(3)
    for kinds in (1, 2, 5, 1000):
        v = r.integers(0, kinds, 300).astype(np.uint64)
        for width in (1, 2, 7, 145, 300):
            got = suffixes._least_places(v, width)
            assert got.tolist() == [s + int(np.argmin(v[s : s + width])) for s in range(len(v) - width + 1)]


def test_remove_repeats_keeps_characters_and_columns(make):
    shared = "é" * 60
    docs = make([(1, "start " + shared + " a"), (2, "begin " + shared + " b"), (3, "x"), (4, None), (4, "y")])
    cut = suffixes.remove_repeats(docs, length=40)
    assert cut.columns == docs.columns
    got = sorted((r["doc_id"], r["text"] or "") for r in cut.collect())
    assert got == [(1, "starta"), (2, "beginb"), (3, "x"), (4, ""), (4, "y")]


def items_and_docs():
    r = random.Random(6)
    item = [words(r, r.randint(14, 60), 3000) for _ in range(8)] + [words(r, 6, 3000)]
    clean = [words(r, r.randint(5, 200), 3000) for _ in range(20)]
    docs = [" ".join(w) for w in clean] + [None, "", "w1", "w " * 4000]
    planted = {}
    for k, w in enumerate(item[:8]):
        copy = list(w)
        if k % 2:
            for p in range(5, len(copy), 9):
                copy[p] = "changed"
        docs.append(" ".join(words(r, 20, 3000)).upper() + ". " + ", ".join(copy).title() + " -- " + " ".join(words(r, 9, 3000)))
        planted[len(docs) - 1] = k
    return [" ".join(w) for w in item], docs, planted


def test_overlaps_are_found(spark, make):
    items, docs, planted = items_and_docs()
    table = spark.createDataFrame([*enumerate(items), (0, items[0]), (50, None), (51, "")], "item_id bigint, text string")
    rows = [*enumerate(docs), (None, docs[-1]), (len(docs) - 1, docs[-1])]
    got = decontam.find_overlaps(make(rows), table)
    assert {r["doc_id"]: r["item_id"] for r in got.collect()} == planted
    for r in got.collect():
        n = len(items[r["item_id"]].split())
        assert r["start"] == 20 and r["n_tokens"] >= n - 4 and r["n_equal"] >= 0.8 * r["n_tokens"]
    left = decontam.decontaminate(make(rows), table)
    assert left.columns == make(rows).columns
    assert {r["doc_id"] for r in left.collect()} == {None, *range(len(docs))} - set(planted)


def test_overlaps_without_broadcast(spark, make, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    items, docs, planted = items_and_docs()
    table = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    got = decontam.find_overlaps(make(docs), table)
    assert {r["doc_id"]: r["item_id"] for r in got.collect()} == planted


def test_two_parts_of_an_item_around_foreign_text(spark, make):
    item = [f"i{k}" for k in range(60)]
    other = [f"o{k}" for k in range(60)]
    around = [f"d{k}" for k in range(30)]
    docs = [
        " ".join([*around, *item[:20], *other[20:40], *item[40:], *around]),
        " ".join([*around, *item[:11], *other[11:49], *item[49:], *around]),
        " ".join([*around, *item[:5], *other[5:20], *item[20:45], *other[45:50], *item[50:], *around]),
        " ".join([*around, *item[:9], *other[9:51], *item[51:]]),
    ]
    table = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["n_equal"]) for r in decontam.find_overlaps(make(docs), table).collect()}
    assert got == {0: (30, 20, 20), 1: (30, 12, 11), 2: (50, 40, 35)}
    assert [r["doc_id"] for r in decontam.decontaminate(make(docs), table).collect()] == [3]


def plain_stretch(equal, least=12):
    """Most equal tokens of any stretch that keeps 4 of 5."""
    total = np.r_[0, np.cumsum(equal)]
    return max(
        (int(total[e] - total[s]) for s in range(len(equal)) for e in range(s + least, len(equal) + 1)
         if 5 * (total[e] - total[s]) >= 4 * (e - s)), default=None,
    )


def test_the_best_stretch_of_any_diagonal(spark):
    r = random.Random(4)
    rows = [[int(r.random() < p) for _ in range(r.randrange(60))] for p in (0.5, 0.7, 0.8, 0.9) for _ in range(100)]
    # a diagonal shorter than the least length is dropped before
    rows = [x for x in rows if len(x) >= 12]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, equal array<int>")
    got = df.select("i", decontam._best_stretch(df.equal, 12, 0.8).alias("b")).collect()
    assert {g["i"]: g["b"] and g["b"]["n_equal"] for g in got} == {i: plain_stretch(x) for i, x in enumerate(rows)}


def test_masks_fit_into_every_passage():
    """All ways to change 2 of 12, 3 of 15, 4 of 20 and 5 of 25 tokens; longer passages hold one of these."""
    for n, k in ((12, 2), (15, 3), (20, 4), (25, 5)):
        at = np.array([*itertools.combinations(range(n), k)])
        changed = (1 << at).sum(axis=1)
        hit = np.zeros(len(changed), bool)
        for mask in decontam.MASKS:
            for s in range(n - mask[-1]):
                hit |= changed & sum(1 << (s + p) for p in mask) == 0
        assert hit.all(), (n, at[~hit][0])


def test_overlaps_with_changed_tokens(spark, make):
    r = random.Random(6)
    around = [f"d{k}" for k in range(20)]
    items, docs = [], []

    def plant(n, at):
        item = [f"i{len(items)}x{k}" for k in range(n)]
        items.append(" ".join(item))
        docs.append(" ".join([*around, *["other" if k in at else w for k, w in enumerate(item)], *around]))

    for at in itertools.combinations(range(12), 2):
        plant(12, at)
    plant(15, (3, 7, 11))
    for n in (15, 16, 20, 24, 30, 100, 504):
        plant(n, range(4, n, 5))
        for _ in range(10):
            plant(n, r.sample(range(n), n // 5))
    table = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    got = decontam.find_overlaps(make(docs), table).collect()
    assert sorted((g["doc_id"], g["item_id"]) for g in got) == [(i, i) for i in range(len(items))]


def test_a_text_that_repeats_an_item(spark, make):
    """20,000 tokens of one sentence: diagonals cost what the item is long, not the text."""
    sentence = [f"w{k}" for k in range(12)]
    items = [" ".join([*[f"i{n}x{k}" for k in range(20)], *sentence, *[f"j{n}x{k}" for k in range(20)]]) for n in range(5)]
    table = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    long = " ".join(sentence * 1667)
    started = time.time()
    got = decontam.find_overlaps(make([long, "a b c", long]), table).collect()
    assert time.time() - started < 60
    want = {(d, i): (0, 12, 12) for d in (0, 2) for i in range(5)}
    assert {(g["doc_id"], g["item_id"]): (g["start"], g["n_tokens"], g["n_equal"]) for g in got} == want


@pytest.mark.parametrize("block", [1, 7, 256])
def test_blocks_do_not_change_overlaps(spark, make, monkeypatch, block):
    """All diagonals by brute force; items longer than a block, texts that share an id, repeated rows."""
    monkeypatch.setattr(decontam, "BLOCK", block)
    r = random.Random(9)
    items = [[r.choice("abcdefgh") + str(r.randrange(3)) for _ in range(n)] for n in (12, 13, 30, 70, 300)]
    rows = []
    for d in range(12):
        item = items[d % 5]
        copy = [w if r.random() > 0.12 else "zz" for w in item]
        rows.append((d // 2, [f"k{r.randrange(9)}" for _ in range(r.randrange(20))] + copy[r.randrange(3) :] + copy[:9]))
    rows += rows[:2]
    table = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (0, " ".join(items[2]))], "item_id bigint, text string")
    got = decontam.find_overlaps(make([(d, " ".join(w)) for d, w in rows]), table).collect()
    want = {}
    for d, doc in rows:
        for i, item in [*enumerate(items), (0, items[2])]:
            for shift in range(1 - len(item), len(doc)):
                lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
                if hi - lo >= 12 and (n := plain_stretch([int(item[k] == doc[k + shift]) for k in range(lo, hi)])):
                    want[d, i] = max(n, want.get((d, i), 0))
    assert {(g["doc_id"], g["item_id"]): g["n_equal"] for g in got} == want and want


def test_overlaps_of_nothing(spark, make):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find_overlaps(make(["a b c"]), none).count() == 0
    one = spark.createDataFrame([(1, "w " * 20)], "item_id bigint, text string")
    assert decontam.find_overlaps(make([]), one).count() == 0


def test_results_do_not_depend_on_broadcasts(make, monkeypatch):
    monkeypatch.setattr(suffixes, "few", lambda names, most=0: names)
    monkeypatch.setattr(neardup, "few", lambda names, most=0: names)
    texts = repeat_texts(8)
    got = {g["doc_id"]: g["n_removed"] for g in suffixes.repeats(make(texts), length=50).collect()}
    assert got == {i: w[1] for i, w in enumerate(plain_repeats(texts, 50))}
    rows = [r for r in near_rows(5) if r[0] not in (5, None)]
    found = {g["doc_id"]: g["component_id"] for g in neardup.near_duplicates(make(rows)).collect()}
    assert found == plain_near(rows)
