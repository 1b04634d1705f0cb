"""Projects: roots, fingerprints, merging and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from ..functions.extract import extensions


def roots(paths: DataFrame, markers: DataFrame, levels: int = 8) -> DataFrame:
    """(path, root): the nearest of the path and its ancestors that holds a marker; markers: (dir).  Null where none does."""
    parts = F.split(F.rtrim(F.col("path"), F.lit("/")), "/")
    up = F.transform(F.sequence(F.lit(0), F.least(F.lit(levels), F.size(parts) - 2)), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/").alias("dir")))
    each = paths.where("path is not null").select("path").distinct().select("path", F.inline(up))
    near = each.join(markers.select("dir").distinct(), "dir").groupBy("path").agg(F.min_by("dir", "level").alias("root"))
    return paths.select("path").distinct().join(near, "path", "left")


def project_id(path: Column) -> Column:
    return F.concat(F.lit("p_"), F.substring(F.sha1(path.cast("binary")), 1, 16))


def display_name(path: Column) -> Column:
    raw = F.regexp_extract(path, r"([^/]+)/*$", 1)
    shown = F.trim(F.regexp_replace(raw, "[-_]", " "))
    return F.when(shown == "", raw).otherwise(shown)


def aliases(path: Column, category: Column) -> Column:
    name = F.lower(display_name(path))
    parts = F.filter(F.split(name, r"[-_\s]+"), lambda p: F.length(p) >= 3)
    kind = F.when(category.isNotNull(), F.array(F.lower(category), F.when(~F.contains(category, F.lit(" ")), F.concat(F.lit("the "), category)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(name, F.lower(F.regexp_extract(path, r"([^/]+)/*$", 1))), parts, kind), lambda a: a.isNotNull() & (a != ""))))


def category(haystack: Column) -> Column:
    """First category in order that has a signal in the lower-cased text."""
    low = F.lower(haystack)
    out = F.lit(None).cast("string")
    for name, signals in reversed(rules.CATEGORIES):
        hit = F.lit(False)
        for s in signals:
            hit = hit | F.contains(low, F.lit(s))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def languages(paths: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.LANGUAGES.items() for x in kv])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(extensions(paths), lambda e: F.try_element_at(table, e)))))


def fingerprints(events: DataFrame, session_roots: DataFrame, words: DataFrame) -> DataFrame:
    """One row a session: project, its names, keywords, languages and category.  session_roots: (session_id, project_path); words: (session_id, keywords)."""
    files = events.where("file_path is not null").groupBy("session_id").agg(F.array_sort(F.collect_set("file_path")).alias("paths"), F.count_if(F.col("file_operation").isin(rules.EDITS)).alias("edits"))
    times = events.groupBy("session_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    s = session_roots.where("project_path is not null").join(times, "session_id").join(files, "session_id", "left").join(words, "session_id", "left")
    none = F.array().cast("array<string>")
    s = s.withColumns({"paths": F.coalesce("paths", none), "keywords": F.coalesce("keywords", none), "edits": F.coalesce("edits", F.lit(0))})
    s = s.withColumn("category", category(F.concat_ws(" ", display_name(F.col("project_path")), F.array_join("keywords", " "), F.array_join("paths", " "))))
    return s.select("session_id", project_id(F.col("project_path")).alias("project_id"), F.col("project_path").alias("canonical_path"), display_name(F.col("project_path")).alias("display_name"), aliases(F.col("project_path"), F.col("category")).alias("aliases"), "keywords", languages(F.col("paths")).alias("languages"), "category", "first_seen", "last_seen", "edits")


def merged(prints: DataFrame) -> DataFrame:
    """One row a project over its sessions' fingerprints; recomputed, so repeating it changes nothing."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    last = lambda c: F.max_by(c, F.struct("last_seen", "session_id")).alias(c)
    return prints.groupBy("project_id", "canonical_path").agg(last("display_name"), union("aliases"), union("keywords"), last("languages"), last("category"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count_distinct("session_id").alias("session_count"), F.sum("edits").alias("total_edits"))


def project_text() -> Column:
    """Text of a merged project to embed."""
    some = lambda label, c, n: F.concat(F.lit(f"{label}: "), F.array_join(F.slice(c, 1, n), ", "))
    return F.concat_ws(" | ", "display_name", F.concat(F.lit("("), "category", F.lit(")")), some("Aliases", "aliases", 10), some("Keywords", "keywords", 20), F.concat(F.lit("Languages: "), F.array_join("languages", ", ")))


def recency(last_seen: Column, now: Column) -> Column:
    days = F.greatest(F.lit(1.0), (now.cast("timestamp").cast("double") - last_seen.cast("timestamp").cast("double")) / 86400)
    return F.coalesce(F.greatest(F.lit(0.3), 1 - 0.15 * F.log10(F.floor(days) + 1)), F.lit(0.5))


def listed(projects: DataFrame, keyword: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    out = projects
    if keyword:
        part = F.lit(keyword.lower())
        out = out.where(F.contains(F.lower("display_name"), part) | F.exists("aliases", lambda a: F.contains(a, part)) | F.exists("keywords", lambda a: F.contains(a, part)))
    if kind:
        out = out.where(F.col("category") == kind)
    return out.orderBy(F.desc("last_seen"), "project_id").limit(limit)


def matched(queries: DataFrame, projects: DataFrame, top: int = 5, near: DataFrame | None = None) -> DataFrame:
    """Best projects of each question: an alias in it scores 2, a named category 0.5 more or 1.5 alone, both by recency; near
    (query_id, project_id, distance) adds closeness.  queries: (query_id, query, now).

    Words of the questions are joined with words of the aliases, so no question meets every project."""
    q = queries.withColumn("low", F.concat(F.lit(" "), F.regexp_replace(F.lower("query"), r"[^\p{L}\p{N}]+", " "), F.lit(" ")))
    word = F.explode(F.array_distinct(F.filter(F.split(F.trim("low"), " "), lambda w: w != ""))).alias("word")
    qw = q.select("query_id", "low", word)
    a = projects.select("project_id", F.explode("aliases").alias("alias")).withColumn("alias", F.trim(F.regexp_replace("alias", r"[^\p{L}\p{N}]+", " ")))
    aw = a.select("project_id", "alias", F.substring_index("alias", " ", 1).alias("word"))
    hit = qw.join(aw, "word").where(F.contains("low", F.concat(F.lit(" "), F.col("alias"), F.lit(" ")))).groupBy("query_id", "project_id").agg(F.lit(2.0).alias("alias_score"))
    terms = F.create_map(*[F.lit(x) for kv in rules.CATEGORY_TERMS.items() for x in kv])
    named = qw.withColumn("category", F.try_element_at(terms, F.col("word"))).where("category is not null").select("query_id", "category").distinct()
    kind = named.join(projects.select("project_id", "category"), "category").select("query_id", "project_id", F.lit(True).alias("by_kind"))
    both = hit.join(kind, ["query_id", "project_id"], "full_outer")
    if near is not None:
        close = near.select("query_id", "project_id", (1 - F.col("distance")).alias("close")).where("close >= 0.15")
        both = both.join(close, ["query_id", "project_id"], "full_outer")
    else:
        both = both.withColumn("close", F.lit(None).cast("double"))
    scored = both.join(queries.select("query_id", "now"), "query_id").join(projects.select("project_id", "display_name", "last_seen"), "project_id")
    boost = recency(F.col("last_seen"), F.col("now"))
    base = F.when(F.col("alias_score").isNotNull(), F.col("alias_score") * boost + F.when(F.col("by_kind"), 0.5).otherwise(0.0)).when(F.col("by_kind"), 1.5 * boost)
    score = F.when(base.isNotNull(), base + F.coalesce("close", F.lit(0.0))).otherwise(F.col("close") * boost)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "project_id")
    return scored.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "project_id", "display_name", "score", "rank")


def matched_or_inferred(queries: DataFrame, projects: DataFrame, unindexed: DataFrame, top: int = 5) -> DataFrame:
    """`matched` and, for questions without any match, one more try with the projects of files that are not indexed yet (inferred)."""
    found = matched(queries, projects, top)
    again = matched(queries.join(found.select("query_id").distinct(), "query_id", "left_anti"), unindexed, top)
    return found.withColumn("inferred", F.lit(False)).unionByName(again.withColumn("inferred", F.lit(True)))
