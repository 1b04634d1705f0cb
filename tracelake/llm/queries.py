"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, media, mixing, ngram_join, quality, role_repair, secret_scan, sharding, substring_dedup, term_scan, token_counts, token_output, toxicity

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=75)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=512)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_index(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end=0)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_of("text").alias("size"))
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, repeats=2).select("doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), n=8)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path")), model)


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording of a page is the melody of its words without tags."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style).*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), media.melody_of(text).alias("audio"))
    return media.recording_groups(pages).withColumnRenamed("id", "page_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"), length=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels"), spared=2), spared=2, threshold=0.3)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan.ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return role_repair.with_lost(role_repair.report(role_repair.damaged(rows)), rows)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_counts, op3_benchmark_decontamination, op4_token_output, op5_source_mixing, op6_sharding, op7_quality, op8_substring_dedup, op9_audio_fingerprints, op10_toxicity, op11_secret_scan, op12_lexical_search, op13_conversation_repair)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
with recursive w as (select doc_id, coalesce({_SPLIT.format(_LOWER)}, []::varchar[]) as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                          when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end as s from w),
u as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (select a.doc_id as a, b.doc_id as b from u a join u b on a.g = b.g and a.doc_id < b.doc_id
          group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edges e on r.b = e.a),
comp as (select a, min(b) as c from reach group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.c as component_id from s join comp c on c.a = s.doc_id
""",
    "op8_substring_dedup": f"""
with w as (select doc_id, coalesce({_SPLIT.format("text")}, []::varchar[]) as w from documents),
runs as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from w),
named as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as run from runs),
firsts as (select doc_id, i, row_number() over (partition by run order by doc_id, i) as k from named),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from firsts where k > 1),
per as (select doc_id, list(j) as js from gone group by doc_id),
kept as (select w.doc_id, len(w.w) as n, list_filter(w.w, lambda x, j: js is null or not list_contains(js, j)) as k from w left join per using (doc_id))
select doc_id, cast(n as bigint) as n_words, cast(n - len(k) as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
""",
    "op12_lexical_search": f"""
with t as (select doc_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) as term from documents),
n as (select doc_id, count(*) as n from t group by doc_id),
tot as (select count(*) as docs, cast(sum(n) as bigint) as terms from n),
tf as (select doc_id, term, count(*) as tf from t group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
q as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) as term from benchmark),
s as (select q.item_id, tf.doc_id,
             cast(sum(cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
      from q join tf using (term) join df using (term) join n using (doc_id), tot group by q.item_id, tf.doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 50
""",
}
