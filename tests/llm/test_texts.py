"""Per-document operators against the libraries or plain versions: tokens, BPE, media, pages, licences."""

import base64
import hashlib
import random
import time
import zlib

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from boutspark.llm import bpe, extract, licenses, media, tokencount

RANKS = P.path("byte_bpe_50k.tiktoken")
MODEL = P.path("piece_bpe_32k.model")

ODD = [
    None,
    "",
    " ",
    "   ",
    "a",
    " a",
    "a ",
    "a  b",
    "a\nb\r\n c\n\n\n d",
    "▁ ▁x ▁▁",
    "<s> x </s> <unk> <|endoftext|>",
    "don't I'LL we've 's 'S",
    "½² 12³ 123456 ٣٤",
    "\x1c\x1dx\x1f \x85  y​",
    "日本語テキスト" * 60,
    "a" * 3000,
    "ab" * 2000 + " x",
    "🙂🙂 é́ x" * 20,
    "same text twice over",
    "same text twice over",
]


def noise(seed, n):
    r = random.Random(seed)
    letters = [chr(c) for c in (32, 32, 10, 97, 98, 101, 115, 39, 48, 57, 44, 0x301, 0x4E00, 233, 0x1F600, 9, 0x2003)]
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return ODD + noise(1, 80)


def test_token_counts_equal_the_library(make, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*enumerate(texts), (3, texts[3]), (3, "other text of a repeated id"), (None, "no id")]
    got = tokencount.token_counts(make(rows), MODEL).collect()
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_token_counts_of_nothing(make):
    assert tokencount.token_counts(make([]), MODEL).count() == 0


def test_small_blocks_and_few_kept_counts(make, texts, monkeypatch):
    monkeypatch.setattr(tokencount, "BLOCK_BYTES", 500)
    monkeypatch.setattr(tokencount, "KEPT", 20)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(make(texts), MODEL).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(make, texts):
    own = library()
    got = {r["doc_id"]: r for r in bpe.encode_digests(make(texts), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_of_texts_that_start_with_a_sign(make):
    words = ["'still here", "'see", "'several of them", "'tis", "'Re 'LL", "(still so", "1st of", "-see", "_s", "\tstill", "é'see a"]
    own = library()
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(make(words), RANKS, P.PATTERN).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in enumerate(words)}


def test_bpe_round_trip_of_ids(make, texts):
    encoded = bpe.encode(make(texts), RANKS, P.PATTERN)
    own = library()
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {
        i: own.encode_ordinary(t or "") for i, t in enumerate(texts)
    }
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(make([]), RANKS, P.PATTERN).count() == 0


def test_both_trees_agree():
    vocab = bpe.Vocabulary(RANKS)
    datas = [t.encode()[:32] for t in noise(2, 300)]
    assert bpe.encode_together(datas, vocab) == [bpe.encode_one(d, vocab) for d in datas]


def test_media_round_trip(spark, make, texts, tmp_path):
    folder = str(tmp_path / "archives")
    media.write_archives(make([*enumerate(texts), (None, "no id")]), folder)
    got = media.media_features(media.read_archives(spark, folder, range_bytes=2000)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(texts) + 1 and all(r["error"] is None for r in got)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64) if data else bytes(64)
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(payload) + 44
    assert by[18]["feature"] == by[19]["feature"] and by[18]["media_sha256"] == by[19]["media_sha256"]


def test_media_of_nothing(spark, make, tmp_path):
    folder = str(tmp_path / "none")
    media.write_archives(make([]), folder)
    assert media.media_features(media.read_archives(spark, folder)).count() == 0


def test_a_broken_member_does_not_hold_up_others(spark, make, tmp_path):
    folder = tmp_path / "broken"
    media.write_archives(make([f"text number {i} " * 40 for i in range(20)], parts=1), str(folder))
    archive = next(p for p in folder.iterdir() if p.suffix == ".zip")
    data = bytearray(archive.read_bytes())
    rows = media.read_archives(spark, str(folder)).select("member", "offset").collect()
    hit = sorted(r["offset"] for r in rows)[7]
    data[hit + 60 : hit + 64] = b"\xff\xff\xff\xff"
    archive.write_bytes(data)
    got = media.media_features(media.read_archives(spark, str(folder))).collect()
    assert sum(r["error"] is not None for r in got) == 1
    assert sum(r["payload_sha256"] is not None for r in got) == 19


def test_a_member_is_read_again_over_a_fresh_archive(tmp_path):
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", b"payload")

    class Failing:
        def open(self, info):
            raise OSError("connection lost")

    fresh = []

    def again():
        fresh.append(zipfile.ZipFile(path))
        return fresh[-1]

    info = zipfile.ZipFile(path).infolist()[0]
    assert media.read_member(Failing(), info, again) == b"payload" and len(fresh) == 1


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<div id="header" class="site-header"><a href="/">Home</a></div>
<div class="cookie-notice">We use cookies, to improve, things, for you, as a reader of pages.</div>
<div id="wrap"><div class="sidebar"><ul><li><a>Related, a</a></li></ul><p>Side text, long enough, has commas, more.</p></div>
<div class="post-content"><h2>Title here</h2><p>First para, with commas, and a length that scores &amp; more.<p>Second   para
 goes on,&nbsp;and on, with <b>bold</b> text.</p><ul><li>Item one<li>Item two</ul><table><tr><td>cell a<td>cell b</table></div>
<div class="comments"><p>Reader said, something long, with commas, more, and more, and longer.</p></div></div>
<form><p>Sign up, please, now, for more, and more</p></form><footer>&copy; x</footer><script>var a="<p>no</p>"</script></body></html>"""


def test_main_text_of_a_page():
    assert extract.main_text(PAGE).split("\n") == [
        "Title here",
        "First para, with commas, and a length that scores & more.",
        "Second para goes on, and on, with bold text.",
        "Item one",
        "Item two",
        "cell a",
        "cell b",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>hello", "hello"),
        ("plain text", "plain text"),
        ("<script>var x", ""),
        ("<!-- open", ""),
        ("<nav>a</nav>", ""),
        ("<p>a &lt;b&gt; &#233; &bogus;</p>", "a <b> é &bogus;"),
        ("<article><h1>T</h1><p>one<br>two</p></article>", "T\none two"),
        ("<div><p>" + "word, " * 5000 + "</p></div>", ("word, " * 5000).strip()),
        ("<div>" * 3000 + "deep text, long enough to be scored here" + "</div>" * 3000, "deep text, long enough to be scored here"),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert extract.main_text(page) == text


def test_pages_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "<p>x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted(
        (r[0] or 0, len(extract.main_text(r[2]))) for r in rows
    )
    assert extract.extract(df.limit(0)).count() == 0


def test_license_scan(make):
    mit = dict((n, t) for n, t in licenses.KNOWN if "\n" in t)["MIT"]
    changed = "Copyright (c) 2020 Some Body\nAll rights reserved.\n" + mit.replace("sublicense", "sub-license").replace(",", " ,").upper()
    rows = [
        (1, mit),
        (2, changed),
        (3, mit + " or not"),
        (4, "Text.\nReleased under the MIT Licence!\nMore text.\nLicensed under CC BY-NC 4.0"),
        (5, None),
        (6, ""),
        (7, "..."),
        (8, "Released under the MIT License."),
        (1, mit),
        (None, "Released under the MIT License.\nx"),
    ]
    got = licenses.scan(make(rows)).collect()
    found = sorted(str((r["doc_id"], r["license"], r["n_notices"], r["notices"])) for r in got)
    want = [
        (1, "MIT", 0, ""),
        (1, "MIT", 0, ""),
        (2, "MIT", 0, ""),
        (3, None, 0, ""),
        (4, None, 2, "CC-BY-NC-4.0, MIT"),
        (5, None, 0, ""),
        (6, None, 0, ""),
        (7, None, 0, ""),
        (8, "MIT", 1, "MIT"),
        (None, None, 1, "MIT"),
    ]
    assert found == sorted(map(str, want))
    assert licenses.scan(make([])).count() == 0


def test_licenses_of_rows_with_one_id(make):
    notice = "Released under the MIT License."
    rows = [(None, f"{notice}\nx"), (None, "clean"), (3, f"{notice}\n{notice}"), (3, "clean"), (3, f"x\n{notice}"), (None, f"{notice}\nx")]
    got = licenses.scan(make(rows)).collect()
    found = sorted((r["doc_id"] or 0, r["n_notices"], r["notices"]) for r in got)
    assert found == [(0, 0, ""), (0, 1, "MIT"), (0, 1, "MIT"), (3, 0, ""), (3, 1, "MIT"), (3, 2, "MIT")]


def test_whole_texts_and_lines_of_usual_licenses(make):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    texts = [(licenses.TEXTS / f"{n}.txt").read_text() for n in names]
    apache = texts[0][: texts[0].index("APPENDIX")]
    filled = texts[0].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2019 Some Body")
    bare = texts[2].partition("\n\n")[2]
    lines = ["GPL-2.0-only", "GPL-3.0-or-later", "MPL-2.0", "Unlicense"]
    docs = [*texts, apache, filled, f"Copyright (c) 2020, X\n\n{bare}", *[f"// SPDX-License-Identifier: {x}" for x in lines]]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(make(docs)).collect()}
    want = [*names, "Apache-2.0", "Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0-or-later", "MPL-2.0", "Unlicense"]
    assert got == dict(enumerate(want))


PARA = "<p>" + "The river ran past the old mill, slow and brown, and nobody came by all day. " * 4 + "</p>"
WRAPPERS = (
    "layout has-sidebar", "site no-header", "container header-fixed", "wrapper extra", "search-page", "with-comments",
    "page-header-wrap", "post-share-enabled",
)


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("tag", ["", "article"])
def test_wording_of_wrappers_removes_no_article(name, tag):
    inner = f"<{tag}>{PARA * 3}</{tag}>" if tag else PARA * 3
    page = f"<body><div class='{name}'><div class='menu'><a href='/'>Home</a></div>{inner}<div class='sidebar'>Buy now</div></div></body>"
    text = extract.main_text(page)
    assert text.count("The river") == 12 and "Buy" not in text and "Home" not in text


def test_headlines_in_headers_of_the_article():
    for head in ('<div class="entry-header"><h1>Old mill</h1></div>', "<header><h1>Old mill</h1></header>"):
        page = f"<body><header><h1>Site</h1></header><div class='content'>{head}{PARA * 3}</div><footer>x</footer></body>"
        assert extract.main_text(page).split("\n")[0] == "Old mill"


def test_long_comments_are_left_out():
    said = "<div class='comment'><p>" + "I do not agree with any of this, and neither does my cousin. " * 6 + "</p></div>"
    page = f"<body><div class='post'>{PARA * 3}</div><div id='comments' class='comments'>{said * 4}</div></body>"
    text = extract.main_text(page)
    assert "cousin" not in text and text.count("The river") == 12


def test_letters_whose_lower_case_is_longer():
    odd = "İ" * 12
    for page in (
        f"<body><p>{odd}</p><script>var x = '<p>no</p>';</script>{PARA}<SCRIPT>y</Script>{PARA}</body>",
        f"<html><head><title>{odd}</title></head><body>{PARA * 2}</body></html>",
    ):
        text = extract.main_text(page)
        assert text.count("The river") == 8 and "var x" not in text


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "<li>" * 20_000 + PARA,
        "<b>" * 20_000 + "<div>a</div></i>" * 20_000 + PARA,
        "<p>" + "<span>" * 20_000 + "</td>" * 20_000 + PARA,
        "<table><tr><td>" + "<header>" * 15_000 + "</div>" * 15_000 + PARA * 3_000,
        "<ul>" + "<li><a>x</a>" * 50_000 + "</ul>" + PARA,
    ],
)
def test_time_is_linear_in_nesting(page):
    start = time.perf_counter()
    extract.main_text(page)
    assert time.perf_counter() - start < 8
