"""Cross-tokenizer alignment against a plain version over both libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from boutspark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(texts, tok, sp):
    """Columns of every text by sets of ends and loops over all links."""
    alphabet = alignment.byte_alphabet()
    named = {i: bytes(alphabet[c] for c in t) for t, i in tok.get_vocab(with_added_tokens=False).items()}
    rows, holds = [], Counter()
    for text in texts:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        ab = [named[i] for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(ab) != raw or b"".join(bb) != raw:
            rows.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links, s = [], [], 0
        t = 0
        for e in cuts:
            i, j = ends_a.index(e, s) + 1, ends_b.index(e, t) + 1
            groups.append((a[s:i], b[t:j]))
            links += [(x, y) for x in a[s:i] for y in b[t:j]]
            s, t = i, j
        holds.update(set(links))
        rows.append((a, b, groups, links))
    top = defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    out = []
    for a, b, groups, links in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                len(a), len(b), len(groups), len(links),
                sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links),
                hashlib.sha256(said.encode()).hexdigest() if groups else "",
            )
        )
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts(n=250, seed=4):
    r = random.Random(seed)
    parts = [
        "the ", "Straße", "naïve ", "12345678", "   ", "\n\n", "\t", "ångström", "日本語のテキスト", "\U0001f600\U0001f468‍\U0001f469",
        "<s>", "<|endoftext|>", "<0x41>", "</s>", "don't", "aaaaaaaaaaaaaaaa", "x\x00y", "ﬁ", "　", "é", " ", "=====", "İ",
    ]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_equal_to_plain_version(spark, make, libraries):
    texts = [None, "", " ", "▁", "a", "same text here"] + ["same text here"] * 5 + odd_texts()
    texts += ["x" * 3_000, "日本" * 2_000, "a b " * 9_000, " " * 1_000, "".join(chr(0x2500 + i % 90) for i in range(900))]
    want = plain(texts, *libraries)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in alignment.align(make(texts, parts=5), A, B).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i] and texts[i][:60])


def test_small_blocks_and_long_groups(spark, make, libraries, monkeypatch):
    """Counts come together over many blocks; links of groups are also counted by distinct ids."""
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 7)
    monkeypatch.setattr(alignment, "SMALL_GROUP", 1)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 50)
    texts = odd_texts(120, 9)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in alignment.align(make(texts, parts=2), A, B).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, *libraries)


def test_repeated_null_ids_and_empty_tables(spark, make):
    rows = [(None, "one two"), (None, "one two"), (3, "one two"), (3, None)]
    got = alignment.align(make(rows), A, B).collect()
    assert sorted(r["count_sum"] for r in got) == [0, *[3 * got[0]["n_links"] or 3 * got[1]["n_links"]] * 3]
    assert alignment.align(make(rows).where("false"), A, B).count() == 0
    assert alignment.groups(make(rows).where("false"), A, B).count() == 0


def test_groups_are_whole(spark, make, libraries):
    texts = odd_texts(60, 11) + [None, ""]
    tok, sp = libraries
    for r in alignment.groups(make(texts), A, B).collect():
        text = texts[r["doc_id"]]
        if r["a_ids"]:
            assert r["a_ids"] == tok.encode(" " + text, add_special_tokens=False).ids and r["b_ids"] == sp.encode(text)
            assert len(r["a_starts"]) == len(r["b_starts"]) and r["a_starts"][0] == r["b_starts"][0] == 0
            assert r["a_starts"] == sorted(set(r["a_starts"])) and r["b_starts"] == sorted(set(r["b_starts"]))


def test_leaf_groups_of_random_ends():
    """Against intersections of ends, with long stretches without a cut."""
    r = random.Random(7)
    for _ in range(300):
        docs, base, a_ends, b_ends, ab, bb, want = r.randint(0, 4), 0, [], [], [0], [0], []
        for _ in range(docs):
            n = r.choice([0, 1, 5, 60, 300])
            step = r.choice([1, 2, 5])
            even = r.random() < 0.3  # sides that meet at the end only
            a = sorted({n, *[2 * r.randint(0, n // 2) if even else r.randint(1, n) for _ in range(n // step)]} - {0}) if n else []
            b = sorted({n, *[2 * r.randint(0, n // 2) + 1 if even else r.randint(1, n) for _ in range(n // step)]} - {0}) if n else []
            a, b = [x for x in a if x <= n], [x for x in b if x <= n]
            cuts = sorted(set(a) & set(b))
            s = 0
            for e in cuts:
                want.append((len(a_ends) + sum(x <= s for x in a), len(b_ends) + sum(x <= s for x in b)))
                s = e
            a_ends += [base + x for x in a]
            b_ends += [base + x for x in b]
            ab.append(len(a_ends))
            bb.append(len(b_ends))
            base += n
        got = alignment.leaf_groups(np.array(a_ends, np.int64), np.array(b_ends, np.int64), np.array(ab), np.array(bb))
        assert list(zip(got[0].tolist(), got[1].tolist())) == want
