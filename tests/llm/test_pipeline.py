"""Each stage against its operator's plain version, on documents built for it."""

import random

import corpus_pipeline as c
from tracelake.llm.common import stored


def test_stages(spark, tmp_path):
    r = random.Random(3)
    vocab = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, text(30)) for i in range(3)]
    rows, toxic, leaks, copies = [], set(), set(), {}
    for i in range(400):
        t = text(r.randrange(20, 90))
        if i % 4 == 0:
            toxic.add(i)
            t += r.choice([" nasty vile zorg", " vile zorg nasty"])
        elif i % 10 == 1:
            leaks.add(i)
            t += " " + bench[i % 3][1].upper() + " end"
        elif i % 10 == 3:
            copies[i] = i - 1 if i % 4 == 3 and (i - 1) % 4 else None
        rows.append((i, t))
    for i, j in copies.items():
        if j:
            rows[i] = (i, rows[j][1] + " tail")
    schema = "doc_id long, text string, lang string, source string, n_chars long, sig string"
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t), "x") for i, t in rows] + [(1000, None, None, None, None, None), (1001, "", "en", "src0", 0, "x")], schema)
    spark.createDataFrame([(i, int(i in toxic)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {x.doc_id for x in df.select("doc_id").collect()}

    one = stored(c.drop_toxic(spark, docs, str(tmp_path)), "one")
    assert one.columns == docs.columns and ids(docs) - ids(one) == toxic
    two = stored(c.drop_near_duplicates(spark, one.union(one.limit(5)), str(tmp_path)), "two")
    assert two.columns == docs.columns and two.count() == len(ids(two))
    gone = {i for i, j in copies.items() if j}
    assert ids(one) - ids(two) == gone
    three = stored(c.drop_benchmark_leaks(spark, two, str(tmp_path)), "three")
    assert three.columns == docs.columns and ids(two) - ids(three) == leaks - gone
    four = stored(c.mix_sources(spark, three, str(tmp_path)), "four")
    assert four.columns == docs.columns and ids(four) <= ids(three)
    size = lambda df: sum(len((x.text or "").split()) for x in df.collect())
    assert abs(size(four) - 1.5 * size(three)) < 100
    five = c.write_tokens(spark, four, str(tmp_path)).orderBy("start").collect()
    assert len(five) == four.count() and [x.doc_id for x in five] == sorted(x.doc_id for x in five)
    start = 0
    for x in five:
        assert x.start == start
        start += x.n_tokens
    assert [name for name, _ in c.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).collect() == []
