"""A training corpus from the documents table: five stages, each on all that the one before has kept.

Toxic texts go, one document of each group of near duplicates stays, texts that hold a benchmark item go, the
sources are mixed to target weights, and the mix is written as token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.llm import decontamination, mixing, ngram_join, token_output, toxicity
from tracelake.llm.common import dropped, stored

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; rows without a text are scored like empty ones."""
    return toxicity.without_toxic(docs, toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; rows without an id stay.  Of rows that repeat an id the one with the
    smallest text, as strings compare, stays (null texts first)."""
    groups = ngram_join.jaccard_components(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    again = kept.groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("_row")).select("doc_id", "_row.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(one).unionByName(docs.where("doc_id is null")).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found with at most 10 % of its letters edited; empty and null texts hold none and stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 2 times at most.  Rows that share an id, or have none, are each taken as often as the
    one of them that is taken most; documents without words are never taken.  Other columns may have any name."""
    mix = mixing.mixed(docs.select("doc_id", "source", mixing.words_of("text").alias("size")))
    copies = mix.where("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    d, c = docs.select(F.struct(*docs.columns).alias("row")), copies.select(F.struct("doc_id", "copies").alias("mix"))
    taken = d.join(c, F.col("row.doc_id").eqNullSafe(F.col("mix.doc_id")))
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies")))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token frames, read back as an index of documents: doc_id, start, n_tokens and ids_crc32 of each row, null ids first and null
    texts as empty ones."""
    return token_output.token_index(docs, public_tokenizers.path(TOKENIZER), end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The first stage is a trained network, so SQL can't express the rows; tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one keeps is stored and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
