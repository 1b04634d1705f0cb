"""Stored tables: derived once for a state of their sources, and read by row groups."""

import pathlib
import tempfile

import pyarrow.parquet as pq

from tracelake.operators import search as I, scoped as C
from tracelake.sources import store


def test_kept_and_pruned(spark):
    d = tempfile.mkdtemp(prefix="spark-t-")
    made = []

    def make():
        made.append(1)
        return spark.range(4000).selectExpr("concat('s', id % 40) as session_id", "id as sequence")

    spark.range(3).write.parquet(f"{d}/in")
    get = lambda: store.kept(spark, f"{d}/out", "t", [f"{d}/in"], make, ["session_id", "sequence"])
    assert get().count() == get().count() == 4000 and len(made) == 1
    spark.range(3).write.mode("append").parquet(f"{d}/in")
    assert get().count() == 4000 and len(made) == 2  # the source has changed
    store.write_sorted(make(), f"{d}/small", ["session_id", "sequence"], rows=100)
    got = store.point(spark.read.parquet(f"{d}/small"), "session_id", ["s7", "nowhere"])
    assert sorted(r.sequence for r in got.collect()) == list(range(7, 4000, 40))
    assert "In(session_id" in got._jdf.queryExecution().toString()
    groups = [pq.ParquetFile(f).metadata.row_group(i).column(0).statistics for f in pathlib.Path(f"{d}/small").glob("*.parquet") for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(s.min <= "s7" <= s.max for s in groups) <= 3 < 30 < len(groups)


def test_nearest_within_equals_plain(spark, monkeypatch):
    """Blocks of 5 rows and 2 questions, ties, hot values, and rows without a vector or a value."""
    monkeypatch.setattr(I, "ROWS_A_GROUP", 5)
    monkeypatch.setattr(I, "QUESTIONS_A_GROUP", 2)
    rows = [(i, None if i % 11 == 0 else ("hot" if i % 3 else f"g{i % 5}"), None if i % 13 == 0 else [float(i % 4), float(i % 7)]) for i in range(80)]
    asked = [(i, "hot" if i % 2 else f"g{i % 6}", [float(i % 3), 1.0]) for i in range(12)]
    c = spark.createDataFrame(rows, "id int, g string, vector array<double>")
    q = spark.createDataFrame(asked, "query_id long, g string, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.id, r.distance) for r in I.nearest_within(c, q, 3, "id", "g").collect())
    want = []
    for query_id, g, v in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, h, w in rows if w is not None and h == g)[:3]
        want += [(query_id, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == sorted(want) and want
    assert I.nearest_within(c.limit(0), q, 3, "id", "g").count() == I.nearest_within(c, q.limit(0), 3, "id", "g").count() == 0


def test_newest_in_projects(spark):
    e = spark.createDataFrame([(f"e{i}", f"p{i % 3}", f"2024-01-{i + 1:02d}") for i in range(12)], "episode_id string, project_id string, t string").selectExpr("*", "cast(t as timestamp) as ended_at")
    q = spark.createDataFrame([(1, None, None, ["p0", "p1", "p0"]), (2, "2024-01-03", "2024-01-05", ["p2"]), (3, None, "2024-01-02", None), (4, None, None, []), (5, None, None, ["p9"])], "query_id int, since string, until string, projects array<string>")
    got = sorted((r.query_id, r["rank"], r.episode_id) for r in C.newest_in_projects(e, q, 2).collect())
    assert got == [(1, 1, "e10"), (1, 2, "e9"), (2, 1, "e2"), (3, 1, "e1"), (3, 2, "e0"), (4, 1, "e11"), (4, 2, "e10")]


def test_one_changed_session_is_made_again(spark):
    from pyspark.sql import functions as F

    from tracelake.operators import reanalyse as R

    d = tempfile.mkdtemp(prefix="spark-t-")
    e = spark.createDataFrame([(f"s{i % 4}", i, f"v{i}") for i in range(20)], "session_id string, sequence int, v string")
    asked = []

    def odd(some):
        asked.append({r.session_id for r in some.select("session_id").distinct().collect()})
        return some.where("v like '%1'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))

    run = lambda df: {r.session_id for r in R.reanalysed(df, d, {"odd": odd}).collect()}
    rows = lambda: {(r.session_id, r.n) for r in R.analysed(spark, d, "odd").collect()}
    assert run(e) == {"s0", "s1", "s2", "s3"} and rows() == {("s1", 1), ("s3", 1)}
    assert run(e) == set() and len(asked) == 1
    more = e.where("v <> 'v11'").union(spark.createDataFrame([("s1", 40, "x1")], e.schema))
    assert run(more) == {"s1", "s3"} and asked[-1] == {"s1", "s3"}
    assert rows() == {("s1", 2)}  # s3 has no row any more
    assert run(more.where("session_id = 's0'")) == set() and rows() == {("s1", 2)}  # files that are gone keep theirs
