"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets
are masked, sources are mixed to their target weights, and what remains is encoded and decoded again.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and all but the last
return the columns of documents. A stage's table is removed when the next one's is written; the last
one read stays, as the result is made from it.

Defined results: null and empty texts are clean, have no near copies and no secrets, weigh nothing in the
mix (a source of nothing but such texts leaves it) and have no tokens; equal rows are near copies of each
other, so one stays, but rows without words all do; a null doc_id comes after all others; a text of any length
is one row throughout; an empty table gives an empty result; extra columns, whatever their names, pass through
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, ngram_join, secret_scan, source_mix, toxicity
from millrace.sources.shared import removed, scratch, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, k=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the digest of what they decode to."""
    path, pattern = bpe.vocabulary()
    both = bpe.encode_decode(docs, path, pattern)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: The toxicity model and the encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        made: list[str] = []
        with scratch(spark):
            docs = settled(stage(spark, docs, sf_dir), made)
        for path in before:
            removed(spark, path)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
