"""A training corpus from raw documents, in stages that each read what the one before has written.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` applies them to ``documents``.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from strandloom.llm.queries import MIX_WEIGHTS, vocabulary
from strandloom.llm.rows import text_key, without
from strandloom.llm.scratch import written

#: A document is rejected from this score on.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from all labelled rows among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = {"doc_id": F.col("doc_id").cast("bigint"), "text_key": text_key("text")}
    scored = toxicity.classified(docs, labels, keep=keep)
    decided = scored.select("doc_id", "text_key", (F.col("score") < TOXIC).alias("kept")).filter("not kept")
    return without(docs, written(decided, "rejected"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles: the one with the smallest id."""
    joined = ngram_join.joined(docs, width=5, percent=80)
    return without(docs, written(joined.select("doc_id", "text_key", "kept"), "decided"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its middle word: never, once, or up to three times."""
    mixed = mixing.mix(docs, MIX_WEIGHTS, max_repeats=3)
    copies = written(mixed.select("doc_id", "text_key", "copies"), "copies")
    # Rows that repeat an id and a text are told apart by nothing; each gets their mean, rounded up.
    copies = copies.groupBy(F.col("doc_id").alias("__id__"), F.col("text_key").alias("__key__")).agg(F.ceil(F.avg("copies")).cast("int").alias("__copies__"))
    keyed = docs.withColumns({"__i__": F.col("doc_id").cast("bigint"), "__x__": text_key("text")})
    same = F.col("__i__").eqNullSafe(F.col("__id__")) & (F.col("__x__") == F.col("__key__"))
    taken = keyed.join(copies.filter("__copies__ > 0"), same)
    return taken.withColumn("__each__", F.explode(F.array_repeat(F.lit(0), F.col("__copies__")))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_tokens`` and ``decoded``, the text that the ids give back."""
    path = vocabulary("byte_bpe_50k.json")
    keep = {c: F.col(c) for c in ("doc_id", "lang", "source") if c in docs.columns}
    return bpe.round_trip(docs, path, keep, table=bpe.word_table(docs, path)).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", tokenise),
]

#: The classifier and the tokenizer are not expressible in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
