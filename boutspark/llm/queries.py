"""The queries of this subpackage over the given tables, and the SQL that must agree."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutspark.llm import (
    alignment,
    bpe,
    decontam,
    extract,
    licenses,
    media,
    mixing,
    neardup,
    negatives,
    quality,
    suffixes,
    tokencount,
    toxicity,
)
from boutspark.llm.lean import small_batches
from boutspark.llm.sides import few

# Words that name the two kinds of abuse which the chain predicts before toxicity as a whole.
INSULTS = ("idiot", "moron", "loser", "clown", "stupid")
CONTEMPT = ("trash", "scum", "worthless", "pathetic", "disgusting")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    counted = tokencount.token_counts(table(spark, sf_dir, "documents"), model)
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxic_targets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One 0/1 column per category: toxic documents that hold a word of the kind, and all toxic ones."""
    kinds = [
        F.coalesce(F.lower("text").rlike(r"\b(?:" + "|".join(words) + r")\b"), F.lit(False)).alias(name)
        for name, words in (("insult", INSULTS), ("contempt", CONTEMPT))
    ]
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null"
    )
    # only toxic documents can be of a kind, so only their texts are searched
    toxic = few(marks.where("toxic = 1").select("doc_id").distinct())
    seen = docs.join(toxic, "doc_id", "left_semi").select("doc_id", *kinds)
    return marks.join(seen, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.col("insult").cast("int"), F.lit(0)).alias("insult"),
        F.coalesce(F.col("contempt").cast("int"), F.lit(0)).alias("contempt"),
        "toxic",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    targets = toxic_targets(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, toxicity.fit(docs, targets, ["insult", "contempt", "toxic"]))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.new_folder(spark, "archives")
    media.write_archives(table(spark, sf_dir, "documents"), folder)
    return media.media_features(media.read_archives(spark, folder))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in 256ths; every label of an id divisible by 7 is moved to the next."""
    rows = table(spark, sf_dir, "embeddings")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & ~odd).select(
        "vec_id",
        F.expr("if(vec_id % 7 = 0, (cast(label as bigint) + 1) % 10, label)").alias("label"),
        F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("vector"),
    )
    return negatives.mine(rows, every=100, positives=5, negatives=10, low=30, high=90)


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), a, b)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_token_counts,
        op3_quality,
        op4_toxicity,
        op5_near_duplicates,
        op6_media,
        op7_repeats,
        op8_main_text,
        op9_contamination,
        op10_bpe,
        op11_hard_negatives,
        op12_mixture,
        op13_alignment,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    sql = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(licenses.COPYRIGHT_LINE)}, '', 'g')"
    for other, one in licenses.SPELLINGS:
        sql = f"replace({sql}, {_quoted(other)}, {_quoted(one)})"
    return rf"regexp_replace({sql}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _license_sql() -> str:
    known = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN)
    whole = "sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g')))"
    return f"""
with known as (
  select digest, min(license) as license
  from (select license, {whole} as digest
        from (select license, {_canonical_sql("text")} as lines from (values {known}) as k(license, text)))
  where digest <> sha256('') group by digest
), base as (
  select row_number() over () as row, doc_id, {_canonical_sql("text")} as lines from documents
), notices as (
  select b.row, string_agg(distinct k.license, ', ' order by k.license) as notices, count(*) as n
  from (select row, unnest(string_split(lines, chr(10))) as line from base) b
  join known k on k.digest = sha256(trim(b.line)) where trim(b.line) <> ''
  group by b.row
)
select b.doc_id, b.digest, k.license, coalesce(n.n, 0)::bigint as n_notices, coalesce(n.notices, '') as notices
from (select row, doc_id, {whole} as digest from base) b
left join known k using (digest) left join notices n on n.row = b.row
"""


_NEGATIVES_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id, list_inner_product(a.q, r.q)::bigint as score
  from rows a join rows r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
), positives as (
  select * from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.vec_id as positive_id,
       row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int as rank,
       n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n
  on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""

# every diagonal with enough equal tokens, without seeds; all its stretches from an equal token to another
_OVERLAPS_SQL = r"""
with d as (
  select row_number() over () as row, doc_id,
         string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w
  from documents where doc_id is not null
), i as (
  select row_number() over () as item_row, item_id,
         string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w
  from benchmark where item_id is not null
), dt as (
  select row, unnest(w) as w, unnest(range(len(w))) as pos from d where len(w) >= 12
), it as (
  select item_row, unnest(w) as w, unnest(range(len(w))) as place from i where len(w) >= 12
), lanes as (
  select row, item_row, pos - place as shift, list(place order by place) as places
  from dt join it using (w) where w <> '' group by all having count(*) >= 10
), sized as (
  select row, item_row, doc_id, item_id, shift, greatest(0, -shift) as first,
         least(len(i.w), len(d.w) - shift) - greatest(0, -shift) as size, places
  from lanes join d using (row) join i using (item_row)
), equal as (
  select *, unnest(places) - first as p, unnest(range(len(places))) as k from sized where size >= 12
), stretches as (
  select a.doc_id, a.item_id, a.shift, a.first, a.size, a.p, b.k - a.k + 1 as n_equal, b.p - a.p + 1 as n
  from equal a join equal b on a.row = b.row and a.item_row = b.item_row and a.shift = b.shift and a.k <= b.k
  where 5 * (b.k - a.k + 1) >= 4 * (b.p - a.p + 1) and (b.p - a.p + 1 >= 12 or b.k - a.k + 1 >= 10)
), best as (
  select *, greatest(n, 12) as n_tokens from stretches
  qualify row_number() over (partition by doc_id, item_id, shift order by n_equal desc, p, n desc) = 1
), placed as (
  select doc_id, item_id, first + shift + least(p, size - n_tokens) as start, n_tokens, n_equal from best
)
select doc_id, item_id, start::bigint as start, n_tokens::bigint as n_tokens, n_equal::bigint as n_equal from placed
qualify row_number() over (partition by doc_id, item_id order by n_equal desc, start, n_tokens desc) = 1
"""

# all pairs that share a shingle, links closed by recursion
_NEAR_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then []
    else list_transform(range(greatest(1, len(w) - 4)), lambda k: array_to_string(w[k + 1 : k + 5], ' ')) end) as shingle
  from d
), n as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared
  from s a join s b using (shingle) where a.doc_id < b.doc_id group by all
), links as (
  select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 85 * (a.n + b.n - shared)
), sides as (
  select x, y from links union all select y, x from links
), reach as (
  select doc_id as x, doc_id as y from d union select r.x, l.y from reach r join sides l on l.x = r.y
)
select x as doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(y)::bigint as component_id, x = min(y) as kept
from reach left join n on n.doc_id = x group by x
"""

# every 200-byte string by its digest; places where one starts again are joined to runs
_REPEATS_SQL = """
with d as (
  select row_number() over () as row, doc_id, encode(coalesce(text, '')) as b from documents
), strings as (
  select row, s, md5(b[s + 1 : s + 200]) as h from (select row, b, unnest(range(octet_length(b) - 199)) as s from d)
), again as (
  select row, s from strings qualify count(*) over (partition by h) > 1
), stepped as (
  select row, s, coalesce((s - lag(s) over (partition by row order by s) > 200)::int, 1) as fresh from again
), runs as (
  select row, min(s) as first, max(s) + 200 as past
  from (select row, s, sum(fresh) over (partition by row order by s) as run from stepped) group by row, run
), pieces as (
  select row, first, past, coalesce(lag(past) over (partition by row order by first), 0) as before from runs
), cut as (
  select row, sum(past - first) as n_removed, count(*) as n_spans, max(past) as past,
         string_agg(hex(b[before + 1 : first]), '' order by first) as kept
  from pieces join d using (row) group by row
)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || hex(b[coalesce(past, 0) + 1 : octet_length(b)]))) as kept_sha256
from d left join cut using (row)
"""

ORACLES = {
    "op1_license_scan": _license_sql(),
    "op5_near_duplicates": _NEAR_SQL,
    "op7_repeats": _REPEATS_SQL,
    "op9_contamination": _OVERLAPS_SQL,
    "op11_hard_negatives": _NEGATIVES_SQL,
}
