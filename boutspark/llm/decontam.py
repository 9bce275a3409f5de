"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask of fixed length keeps some token positions and ignores the others, so its hash
survives substitutions at the ignored ones. Every position of every document and item is
hashed under each mask; equal hashes put document and item on a diagonal, and each
diagonal is verified token by token: of all its stretches of `MIN_TOKENS` or more, at least
`MIN_SHARE` of whose tokens are equal, the one with the most equal tokens is the passage,
from its first to its last equal token (widened to `MIN_TOKENS` if that is shorter).
The masks miss no passage of that length and share; other lengths and shares need others.

Item hashes are joined by broadcast only when their counted number is within
`BROADCAST_ROWS`; beyond it the same join shuffles. Documents whose texts are read again
for verification are those with a hit only; they meet the items in blocks of `BLOCK` tokens,
so a diagonal costs what its item is long and work grows with the text, also where a text
repeats the words of an item throughout.

Defined results: null, empty and short texts (fewer tokens than the shortest mask) have no hits;
an item shorter than a mask is looked up by the masks that fit; repeated documents are
reported per id; of several diagonals of a document and item the longest match counts,
then the leftmost; null ids match nothing; an empty table on either side gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.llm.sides import few
from boutspark.staging import stage

#: Kept positions of the masks, each of weight 5. One of them fits into every passage of at
#: least 12 tokens of which 4 of 5 are equal: into 12 tokens with 2 unequal ones, 15 with 3,
#: 20 with 4 and 25 with 5, and every such passage holds one of these four.
MASKS = (
    (0, 1, 2, 4, 5),
    (0, 1, 2, 3, 4),
)
MIN_TOKENS = 12
MIN_SHARE = 0.8
BROADCAST_ROWS = 300_000
#: Tokens of a text that are moved together for verification.
BLOCK = 256


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.split(F.trim(plain), " ")


def _seeds(df: DataFrame, id_col: str, masks=MASKS) -> DataFrame:
    """(id, at, seed) for every position of `words` under every mask that fits.

    The words stay in the row beside the exploded position, so a seed is plain
    generated code over the array and no token row is made.
    """
    shortest = min(m[-1] for m in masks)
    at = df.where(F.size("words") > shortest).select(
        id_col, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1 - shortest)).alias("at")
    )
    cases = [
        F.when(
            F.col("at") + m[-1] < F.size("words"),
            F.xxhash64(F.lit(k), *[F.get("words", F.col("at") + p) for p in m]),
        )
        for k, m in enumerate(masks)
    ]
    return at.select(id_col, "at", F.array(*cases).alias("seeds"))


def _best_stretch(equal: Column, min_tokens: int, min_share: float) -> Column:
    """The best stretch of a diagonal whose equal tokens are given as 1, the others as 0."""
    places = F.filter(F.transform(equal, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return _best_of_places(places, min_tokens, min_share)


def _best_of_places(places: Column, min_tokens: int, min_share: float) -> Column:
    """(n_equal, back, n) of the best stretch of a diagonal, from an equal token to an equal token; null if none.

    `places` are the positions of its equal tokens in rising order. From the k-th, at p, to
    the l-th, at q, the share is kept where
    k - share * p <= l + 1 - share * (q + 1). In the order of these values the least k met
    before an l begins its longest stretch, so one sort and one pass see all stretches.
    """

    def ends(of: Column, side: int) -> Column:
        return F.transform(
            of,
            lambda p, k: F.struct(
                F.round((k + side - min_share * (p + side)) * 1e6).cast("bigint").alias("value"),
                F.lit(side).alias("side"),
                k.alias("k"),
                p.alias("p"),
            ),
        )

    kind = "struct<k:int,p:int,best:struct<n_equal:int,back:int,n:int>>"
    none = F.lit(None).cast("struct<n_equal:int,back:int,n:int>")
    zero = F.struct(F.lit(2**31 - 1).alias("k"), F.lit(0).alias("p"), none.alias("best")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        first = (x["side"] == 0) & (x["k"] < s["k"])
        n_equal, n = x["k"] - s["k"] + 1, x["p"] - s["p"] + 1
        # with unequal tokens beside it a shorter stretch can keep the share, too
        fits = (x["side"] == 1) & ((n >= min_tokens) | (n_equal >= min_share * min_tokens - 1e-6))
        now = F.struct(n_equal.alias("n_equal"), (-s["p"]).alias("back"), n.alias("n"))
        return F.struct(
            F.when(first, x["k"]).otherwise(s["k"]).alias("k"),
            F.when(first, x["p"]).otherwise(s["p"]).alias("p"),
            F.when(fits, F.greatest(s["best"], now)).otherwise(s["best"]).alias("best"),
        ).cast(kind)

    return F.aggregate(F.array_sort(F.concat(ends(places, 0), ends(places, 1))), zero, step)["best"]


def _blocks(low: Column, high: Column) -> Column:
    """Numbers of the blocks that hold positions from low up to, not including, high."""
    number = lambda x: F.floor(x / BLOCK).cast("int")
    return F.when(high > low, F.sequence(number(low), number(high - 1)))


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = MIN_TOKENS,
    min_share: float = MIN_SHARE,
    masks=MASKS,
) -> DataFrame:
    """(id, item, start, n_tokens, n_equal): the best verified passage of each document and item."""
    train = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    test = (
        items.where(F.col(item_col).isNotNull())
        .select(F.col(item_col).alias("item"), tokens(F.col(item_text_col)).alias("words"))
        .dropDuplicates(["item", "words"])
    )
    marks = _seeds(test, "item", masks).select("item", F.col("at").alias("place"), F.explode("seeds").alias("seed"))
    marks = marks.where(F.col("seed").isNotNull())
    side = few(marks, BROADCAST_ROWS)
    read = train.select("id", tokens(F.col("text")).alias("words"))
    seeds = _seeds(read, "id", masks)
    hits = seeds.select("id", "at", F.explode("seeds").alias("seed")).join(side, "seed")
    lanes = hits.select("id", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    lanes = stage(lanes, "lanes")
    # read again only what has a hit; tokens are made after the join
    texts = train.join(few(lanes.select("id").distinct()), "id", "left_semi").select(
        "id", F.xxhash64("text").alias("version"), tokens(F.col("text")).alias("words")
    )
    # texts and items meet in blocks, so a lane moves as many tokens as its item has, however
    # long the text, and a text with very many lanes is dealt out by its blocks
    n_words = F.size("words").alias("n_words")
    parts = texts.select("id", "version", n_words, "words", F.explode(_blocks(F.lit(0), F.size("words"))).alias("block"))
    parts = parts.withColumn("words", F.slice("words", F.col("block") * BLOCK + 1, BLOCK))
    asked = lanes.join(test.select("item", F.xxhash64("words").alias("item_version"), "words"), "item")
    low = F.greatest(F.lit(0), F.col("shift"))
    asked = asked.select(
        "id", "item", "item_version", "shift", F.size("words").alias("n_wanted"), F.col("words").alias("wanted"),
        F.explode(_blocks(low, F.size("words") + F.col("shift"))).alias("block"),
    )
    # the first place of the item in this block, and of the block on the item
    at = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("shift"))
    asked = asked.withColumn("at", at)
    upto = F.least(F.col("n_wanted"), (F.col("block") + 1) * BLOCK - F.col("shift"))
    asked = asked.withColumn("wanted", F.slice("wanted", F.col("at") + 1, upto - F.col("at")))
    both = asked.join(parts, ["id", "block"])
    first = F.greatest(F.lit(0), -F.col("shift"))
    both = both.withColumn("first", first).withColumn(
        "size", F.least("n_wanted", F.col("n_words") - F.col("shift")) - F.col("first")
    )
    here = F.slice("words", F.col("at") + F.col("shift") - F.col("block") * BLOCK + 1, F.size("wanted"))
    same = F.zip_with("wanted", here, lambda x, y: x == y)
    places = F.filter(
        F.transform(same, lambda x, i: F.when(x, i + F.col("at") - F.col("first"))), lambda i: i.isNotNull()
    )
    # equal rows of documents give equal pieces; versions keep texts of one id apart
    pieces = both.where(F.col("size") >= min_tokens).withColumn("places", places).where(F.size("places") > 0)
    joined = pieces.groupBy("id", "version", "item", "item_version", "shift", "first", "size").agg(
        F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("block", "places"))), lambda x: x["places"])).alias("places")
    )
    enough = joined.where(F.size("places") >= min_share * min_tokens - 1e-6)
    found = enough.withColumn("found", _best_of_places(F.col("places"), min_tokens, min_share)).where("found is not null")
    # a stretch below the least length takes in tokens beside it
    n_tokens = F.greatest(F.col("found.n"), F.lit(min_tokens))
    sure = found.select(
        "id",
        "item",
        (F.col("first") + F.col("shift") + F.least(-F.col("found.back"), F.col("size") - n_tokens))
        .cast("bigint")
        .alias("start"),
        n_tokens.cast("bigint").alias("n_tokens"),
        F.col("found.n_equal").cast("bigint").alias("n_equal"),
    )
    best = sure.groupBy("id", "item").agg(
        F.max(F.struct("n_equal", (-F.col("start")).alias("back"), "n_tokens")).alias("best")
    )
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        (-F.col("best.back")).alias("start"),
        F.col("best.n_tokens").alias("n_tokens"),
        F.col("best.n_equal").alias("n_equal"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents without a verified overlap; rows without an id stay."""
    found = stage(find_overlaps(docs, items, id_col=id_col, **how).select(id_col).distinct(), "contaminated")
    return docs.join(few(found), id_col, "left_anti").select(*docs.columns)
