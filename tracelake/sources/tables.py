"""Keyed tables on plain Parquet: the last write of a key wins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and the rows of old whose key it lacks."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def newest(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """One row a key, the last by `by`, with partial aggregation before the exchange."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*key, "_r.*")


BUCKETS = 16  # that a new table begins with; the number in force stands in its manifest and doubles as it grows
BUCKET_BYTES = 256 << 20
MOST_PARTS = 32  # beyond it all parts are merged, whatever their keys and sizes


def _files(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, make = _files(spark, path)
    folder = make(f"{path}/commits")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()) if fs.exists(folder) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The table's last committed state (or that of a version): buckets, bucket_by, marks, and its parts from the oldest on, each with
    version, key and bytes.  None for a table without a commit."""
    if version is None:
        known = _manifests(spark, path)
        if not known:
            return None
        version = known[-1]
    fs, make = _files(spark, path)
    with_text = fs.open(make(f"{path}/commits/{version:012d}"))
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_text)))
    finally:
        with_text.close()


def _bucket(columns: list[str], n: int):
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def _merged(spark: SparkSession, path: str, parts: list[dict], buckets: list[int] | None = None) -> DataFrame:
    """The rows of some parts that no later part replaces.  A part replaces all older rows that agree with one of its rows in its key (nulls are equal)."""
    frames = []
    for p in parts:
        df = spark.read.parquet(f"{path}/version={p['version']:012d}")
        df = df if buckets is None else df.where(F.col("key_bucket").isin(buckets))
        frames.append(df.drop("key_bucket").withColumn("_version", F.lit(p["version"])))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    for key in sorted({tuple(p["key"]) for p in parts[1:]}):
        of = [f.select(*key, "_version") for f, p in zip(frames[1:], parts[1:], strict=True) if tuple(p["key"]) == key]
        last = of[0]
        for f in of[1:]:
            last = last.unionByName(f)
        last = last.groupBy(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)]).agg(F.max("_version").alias("_last"))
        same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(key)]
        rows = rows.join(last, same, "left").where("_last is null or _version >= _last").drop("_last", *[f"_key{i}" for i in range(len(key))])
    return rows.drop("_version")


def keyed_table(spark: SparkSession, path: str, near: DataFrame | None = None) -> DataFrame:
    """A keyed table as its last commit left it; a write that failed half-way is never seen.

    near: rows with the table's bucket columns; only the buckets that could hold such rows are read.
    """
    state = manifest(spark, path)
    if state is None:
        raise FileNotFoundError(f"no keyed table at {path}")
    touched = None if near is None else [r[0] for r in near.select(_bucket(state["bucket_by"], state["buckets"])).distinct().collect()]  # at most one a bucket
    return _merged(spark, path, state["parts"], touched)


def _commit(spark: SparkSession, path: str, version: int, state: dict) -> None:
    """Writes the manifest of a version; fails if another writer has committed it."""
    fs, make = _files(spark, path)
    out = fs.create(make(f"{path}/commits/.{version:012d}"), True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(make(f"{path}/commits/{version:012d}")) or not fs.rename(make(f"{path}/commits/.{version:012d}"), make(f"{path}/commits/{version:012d}")):
        raise RuntimeError(f"version {version} of {path} was committed by another writer")


def _write(rows: DataFrame, path: str, version: int, state: dict, tasks: int) -> int:
    """Writes one part and returns its bytes; a bucket is dealt over as many tasks as its share asks for."""
    spark = rows.sparkSession
    rows = rows.withColumn("key_bucket", _bucket(state["bucket_by"], state["buckets"]))
    rows.repartition(tasks, "key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(f"{path}/version={version:012d}")
    fs, make = _files(spark, path)
    return int(fs.getContentSummary(make(f"{path}/version={version:012d}")).getLength())


def keyed_overwrite(spark: SparkSession, path: str, new: DataFrame, key: list[str], bucket_by: list[str] | None = None, mark: tuple[str, int] | None = None) -> None:
    """Upserts rows; new may hold several rows of a key, which replace all old ones.

    A write adds a part of the new rows alone, so its cost is that of the batch; readers merge the parts, of which a table has about
    log2(table / batch), and never more than MOST_PARTS: after a write the last parts are merged while the older of them is at most twice as large as those after it.  Merging down to the
    first part rewrites the table; then its buckets double until one holds at most BUCKET_BYTES.  Parts with different keys merge
    only all the way down.  Rows lie in buckets by hash of bucket_by (the key, if not given; kept from the first write on).  Readers see
    the table before or after a commit; parts that the last two manifests do not name are deleted.
    mark: (writer, number); a write whose number is not above the writer's last one is left out, so a repeated batch changes nothing.
    """
    known = _manifests(spark, path)
    state = manifest(spark, path, known[-1]) if known else {"buckets": BUCKETS, "bucket_by": bucket_by or key, "parts": [], "marks": {}}
    if mark and state["marks"].get(mark[0], -1) >= mark[1]:
        return
    version = (known[-1] if known else 0) + 1
    bytes_ = _write(new, path, version, state, state["buckets"])
    fs, make = _files(spark, path)
    empty = not any(x.getPath().getName().startswith("key_bucket=") for x in fs.listStatus(make(f"{path}/version={version:012d}")))
    if not empty:
        state["parts"].append({"version": version, "key": key, "bytes": bytes_})
    elif not mark:
        return
    if mark:
        state["marks"][mark[0]] = mark[1]
    _commit(spark, path, version, state)
    if not empty:
        compact(spark, path)


def _tail(parts: list[dict]) -> int:
    """How many of the last parts to merge: those that are at most twice as large as all after them; a run that does not reach the
    first part ends where the key changes."""
    if len(parts) > MOST_PARTS:
        return len(parts)
    n, total = 1, parts[-1]["bytes"]
    while n < len(parts) and parts[-n - 1]["bytes"] <= 2 * total:
        total += parts[-n - 1]["bytes"]
        n += 1
    if n < len(parts):
        same = 1
        while same < n and parts[-same - 1]["key"] == parts[-1]["key"]:
            same += 1
        n = same
    return n


def compact(spark: SparkSession, path: str, whole: bool = False) -> None:
    """Merges the parts that are due (all, if whole) and deletes parts of older manifests."""
    known = _manifests(spark, path)
    state = manifest(spark, path, known[-1])
    n = len(state["parts"]) if whole else _tail(state["parts"])
    if n > 1:
        merged, version = state["parts"][-n:], known[-1] + 1
        if n == len(state["parts"]):
            while sum(p["bytes"] for p in merged) > BUCKET_BYTES * state["buckets"]:
                state["buckets"] *= 2
        bytes_ = _write(_merged(spark, path, merged), path, version, state, state["buckets"])
        state["parts"] = [*state["parts"][:-n], {"version": version, "key": merged[-1]["key"], "bytes": bytes_}]
        _commit(spark, path, version, state)
        known.append(version)
    if len(known) > 2:
        fs, make = _files(spark, path)
        live = {p["version"] for v in known[-2:] for p in manifest(spark, path, v)["parts"]}
        for v in known[:-2]:
            for p in manifest(spark, path, v)["parts"]:
                if p["version"] not in live:
                    fs.delete(make(f"{path}/version={p['version']:012d}"), True)
            fs.delete(make(f"{path}/commits/{v:012d}"), False)


def to_ingest(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose path and size are not in the ingestion log yet."""
    return files.join(log.select("path", "size"), ["path", "size"], "left_anti")
