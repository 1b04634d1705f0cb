"""Derived tables made again for the sessions whose events have changed, and for no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import keyed_overwrite, keyed_table, manifest

KEY = ["session_id"]


def session_prints(events: DataFrame) -> DataFrame:
    """(session_id, n, mixed, total): number of events and two order-free digests of all their columns; reduced before the exchange."""
    h = F.xxhash64(*sorted(events.columns))
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("mixed"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"))


def reanalysed(events: DataFrame, folder: str, derived: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Brings the tables below a folder up to date with events and returns the ids of the sessions that were made again.

    derived: for each table, what makes its rows (with session_id) from events; it must treat each session by itself.  A session is made again if
    its digests are not those of its last run.  A session that gives a table no row leaves an empty mark there, which `analysed` hides.  Sessions
    that events lack, as their files are gone, keep their rows.  The digests are written last: a run that broke off is done again.
    """
    spark = events.sparkSession
    prints = session_prints(events)
    seen = f"{folder}/prints"
    changed = (prints.join(keyed_table(spark, seen), prints.columns, "left_anti") if manifest(spark, seen) else prints).persist()
    if not changed.isEmpty():
        some = events.join(changed.select(*KEY), KEY, "left_semi")
        for name, make in derived.items():
            rows = changed.select(*KEY).join(make(some).withColumn("is_row", F.lit(True)), KEY, "left")
            keyed_overwrite(spark, f"{folder}/{name}", rows, KEY)
        keyed_overwrite(spark, seen, changed, KEY)
    return changed.select(*KEY)


def analysed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that `reanalysed` keeps."""
    return keyed_table(spark, f"{folder}/{name}").where("is_row").drop("is_row")
