import random
import re

import pytest

from tracelake.llm import components, ngram_join
from tracelake.llm.ngram_join import jaccard_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORDS.findall(low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows = ["", None, " \n\t", "one", "ONE", "one two", "two one", "Äa bb cc", "äa bb cc"]
    passage = text(30)
    for _ in range(25):
        base = text(r.choice([3, 5, 6, 8, 12, 30, 80, 200, 400]))
        rows.append(" ".join(base))
        for _ in range(r.randrange(6)):
            x = list(base)
            for _ in range(r.randrange(1 + len(x) // r.choice([15, 25, 60]))):
                k = r.randrange(len(x))
                x[k : k + r.randrange(2)] = text(r.randrange(1, 3))
            if r.random() < 0.3:
                x = x[: max(1, int(len(x) * r.uniform(0.75, 1)))]
            rows.append("  ".join(x).upper() if r.random() < 0.2 else " ".join(x))
        rows.append(" ".join(text(40) + passage + text(20)))
    rows += [rows[-1]] * 30
    ids = r.sample(range(10 * len(rows)), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("crowd", [64, 1])
def test_brute_force(spark, monkeypatch, crowd):
    """With a small CROWD, nearly all runs are compared as crowds; the share makes more or fewer shingles popular."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "POPULAR", 0.005 if crowd > 1 else 0.05)
    for seed in (crowd,):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*x, "extra", 1) for x in rows], "doc_id long, text string, node string, sig int").repartition(3)
        got = sorted(map(tuple, jaccard_components(docs).collect()))
        assert got == brute(rows)


def test_mostly_popular_sets(spark, monkeypatch):
    """A passage that most texts share, with much, little or no text of their own around it."""
    monkeypatch.setattr(ngram_join, "POPULAR", 0.03)
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    passages, rows = [text(40), text(90)], []
    for _ in range(120):
        p = r.choice(passages)
        x = text(r.choice([0, 2, 5, 9, 14, 25])) + p[r.randrange(3) :] + text(r.choice([0, 1, 4, 8, 12, 30]))
        if r.random() < 0.3:
            x[r.randrange(len(x))] = "changed"
        rows.append(" ".join(x))
    rows = list(enumerate(rows + [" ".join(text(n)) for n in range(1, 30)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute(rows)


def test_rows_without_id_and_repeated_ids_link(spark):
    """A row without an id joins its neighbours, and each text of a repeated id links for itself."""
    words = [f"y{i}" for i in range(200)]
    near = [" ".join(words[i : i + 60]) for i in (0, 6, 12)]
    other = " ".join(words[100:160])
    rows = [(1, near[0]), (None, near[1]), (2, near[2]), (7, near[0]), (7, other), (8, other), (9, "long " + "z " * 2_500_000 + "end"), (10, "z " * 2_500_000 + "end")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 1), (1, 1), (2, 1), (7, 1), (7, 7), (8, 7), (9, 9), (10, 10)]


def test_hot_run_and_chain(spark):
    """A chain of texts, each near the next one only, is one component."""
    words = [f"x{i}" for i in range(700)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute(rows)


def test_empty_and_nulls(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = jaccard_components(docs).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 2, 3), (2, 0, 2), (3, 2, 3), (3, 2, 3)]


@pytest.mark.parametrize("id_bits", [3, 7])
def test_sets_with_equal_ids_stay_apart(spark, id_bits):
    """With ids of so few bits nearly all sets share theirs with others."""
    rows = corpus(id_bits)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(docs, id_bits=id_bits).collect())) == brute(rows)


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_components_need_few_rounds(spark, monkeypatch, held):
    """Chains, repeated edges, loops and nulls by plain union-find; tasks that reduce their edges leave at most three rounds."""
    monkeypatch.setattr(components, "HELD", held)
    rounds = []
    monkeypatch.setattr(components, "stored", lambda df, name, of=components.stored: (rounds.append(name), of(df, name))[1])
    r = random.Random(held)
    edges = [(r.randrange(400) - 50, r.randrange(400) - 50) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5), (2000, 2001), (2001, 2000), (2000, 2001)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in list(top))
    assert rounds.count("stars") <= 3
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
