"""Registered queries of the operators, each over its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm import ann, bpe, exact_dedup, exact_topk, hard_negatives, mixing, ngram_join, phrases, quality, token_files, toxicity, url_filter, warc
from strandloom.llm.scratch import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """A file of the public vocabularies; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vectors that take part in a search over whole numbers.
WHOLE_SQL = """where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

#: Fixed values of the queries' contracts.
MIX_WEIGHTS = [5, 2, 1]
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, max_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.joined(table(spark, sf_dir, "documents"), width=5, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")
    both = bpe.round_trip(docs, path, {"doc_id": F.col("doc_id")}, table=bpe.word_table(docs, path))
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    rows = token_files.with_start(token_files.checksums(token_files.read(spark, path)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    rows = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold != 0)
    return rows.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op7_url_filter"] = r"""
with parts as (
  select page_id,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
cut as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from parts),
named as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from cut),
judged as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    end as rule
  from named)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from judged
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    scored = toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold != 1)
    return scored.select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, index = new_path(spark, "archive"), new_path(spark, "index")
    warc.write_archives(table(spark, sf_dir, "pages"), archive, min_bytes=0)
    warc.write_index(warc.captures(spark, archive), index)
    records = warc.read_records(warc.index_lines(spark.read.parquet(index)), archive)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op10_exact_dedup"] = f"""
with texts as (select doc_id, sha256({LOWER_SQL}) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = max(doc_id) over g as kept, text_sha256
from texts window g as (partition by text_sha256)
"""


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_phrases"] = rf"""
with texts as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
pieces as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from texts),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
places as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as p
  from pieces, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k),
found as (select lang, k, p, count(*) as a from places group by all having count(*) >= 30),
cuts as (
  select c.lang, c.p, c.a, cut, l.a as l, r.a as r,
    (2000000 * c.a::hugeint // (l.a::hugeint + r.a::hugeint))::bigint as score
  from (select *, unnest(range(1, k)) as cut from found where k > 1) c
  join found l on l.lang = c.lang and l.p = c.p[1:cut]
  join found r on r.lang = c.lang and r.p = c.p[cut + 1:]),
low as (
  select lang, p, any_value(a) as a, arg_min(l, score * 4 + cut) as l, arg_min(r, score * 4 + cut) as r, min(score) as score
  from cuts group by lang, p),
inside as (
  select lang, list_transform(range(1, k - m + 2), lambda i: p[i:i + m - 1]) as parts, a
  from found, (select unnest([2, 3]) as m) where m < k),
longer as (select lang, p, max(a) as longer from (select lang, unnest(parts) as p, a from inside) group by lang, p),
kept as (
  select low.*, array_to_string(low.p, ' ') as phrase from low left join longer using (lang, p)
  where longer is null or 100 * longer::hugeint < 80 * low.a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


@query
def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op12_exact_topk"] = f"""
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings {WHOLE_SQL}),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from rows q join rows c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op13_hard_negatives"] = f"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings {WHOLE_SQL} and label is not null),
scored as (
  select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, list_inner_product(q.v, c.v)::bigint as score
  from rows q join rows c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
near as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
met as (
  select n.*, vec_id as negative_id, score as negative_score,
    row_number() over (partition by n.anchor_id, positive_id order by score desc, vec_id)::int as rank
  from near n join scored s on s.anchor_id = n.anchor_id and not same
  where 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from met where rank <= 10
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
