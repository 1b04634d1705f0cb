"""Transcripts: JSON lines, one entry a line, one file a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LONGEST_LINE, LARGEST_FILE = 50 << 20, 500 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, line_no, raw) of all transcripts below a folder, in file order, without blank, overlong or broken lines.

    Order comes from the split's start and the row's place in it, both taken in the scan.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    skip = F.contains("path", F.lit("skill-injections")) | F.contains("path", F.lit("vercel-plugin")) | F.contains("path", F.lit("/subagents/")) | F.contains("path", F.lit("pytest-of-"))
    kept = raw.where(~skip & (F.col("size") <= LARGEST_FILE) & (F.trim("value") != "") & (F.octet_length("value") <= LONGEST_LINE))
    return kept.where(F.try_parse_json("value").isNotNull()).select("path", "size", F.col("at").alias("line_no"), F.col("value").alias("raw"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) without reading the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
