import random

import numpy as np
import pyarrow as pa

from tracelake.llm import media, quality


def texts(n, seed):
    r = random.Random(seed)
    vocab = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 120))]
        good = r.random() < 0.7
        if not good:
            w = r.choice([[x + "%%%" for x in w], [w[0]] * len(w), [x.upper() + "!!" for x in w], [y for x in w for y in (x, "|")]])
        rows.append((i, " ".join(w), int(good)))
    return rows


def test_quality(spark):
    rows = texts(800, 1)
    site = lambda i, q: ("bad.example" if not q and i % 3 else f"h{i % 5}", f"p{i % 2}" if i % 11 else None)
    docs = spark.createDataFrame([(i, t, *site(i, q), 1.0) for i, t, q in rows] + [(None, None, None, None, 0.0), (3, rows[3][1], "h3", "p1", 0.0)], "doc_id long, text string, host string, path string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:500]] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fit_on(docs, labels)).collect()
    assert len(got) == 802
    truth = {i: q for i, _, q in rows}
    held = [r.keep == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id >= 500]
    assert np.mean(held) > 0.97
    host = {r.doc_id: r.host_posterior for r in got}
    bad = [h for i, h in host.items() if i is not None and site(i, truth[i])[0] == "bad.example"]
    good = [h for i, h in host.items() if i is not None and site(i, truth[i])[0] != "bad.example"]
    assert max(bad) < 0.3 < 0.7 < min(good)
    assert quality.scored(docs.limit(0), quality.fit([])).collect() == []


def test_shrinkage(spark):
    """Posteriors by hand: a site of one row stays near its prior."""
    docs = spark.createDataFrame([(i, "good words here", "big", "p") for i in range(50)] + [(99, "%%% %%%", "small", "p")], "doc_id long, text string, host string, path string")
    model = quality.fit([("good words here", 1)] * 20 + [("%%% %%%", 0)] * 20)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert got[99].evidence < 0.1 < 0.5 < got[99].host_posterior < got[0].host_posterior


def test_posteriors_by_hand(spark):
    """Sums, prior strengths, posteriors and scores again in plain Python, over sites from one row to many."""
    r = random.Random(5)
    rows = [(i, t, r.choice(["a", "b", "c", f"solo{i % 40}", None]), r.choice(["x", "y", f"only{i}", None])) for i, t, _ in texts(300, 9)]
    rows += [rows[0], (None, None, "a", "x"), (900, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = quality.scored(docs, quality.fit([(t, y) for _, t, y in texts(200, 10)])).collect()
    assert len(got) == len(rows)
    evidence = {x.doc_id: x.evidence for x in got}
    sites: dict = {}
    for d, _, h, p in rows:
        sites.setdefault(h, {}).setdefault(p, []).append(evidence[d])
    hosts = {h: [e for es in ps.values() for e in es] for h, ps in sites.items()}
    everything = [e for es in hosts.values() for e in es]
    mean = sum(everything) / len(everything)

    def strength(groups):
        """groups: (values, prior mean) of each group."""
        many = [(len(v), sum(v) / len(v), m) for v, m in groups if len(v) > 1]
        total = sum(n for n, _, _ in many)
        spread = sum(n * (x - m) ** 2 for n, x, m in many) - sum(m * (1 - m) for _, _, m in many)
        if not many or spread <= 0:
            return 1e6
        return min(1e6, max(2.0, sum(n * m * (1 - m) for n, _, m in many) / spread - 1))

    k = strength([(v, mean) for v in hosts.values()])
    host = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(v, host[h]) for h, ps in sites.items() for v in ps.values()])
    path = {(h, p): (sum(v) + k * host[h]) / (len(v) + k) for h, ps in sites.items() for p, v in ps.items()}
    odds = lambda x: np.log(x / (1 - x))
    where = {d: (h, p) for d, _, h, p in rows}
    for x in got:
        h, p = where[x.doc_id]
        score = 1 / (1 + np.exp(-(odds(max(x.evidence, 1e-9)) + odds(path[h, p]) - odds(mean))))
        assert np.allclose([x.host_posterior, x.path_posterior, x.score], [host[h], path[h, p], score], atol=1e-9) and x.keep == (x.score >= 0.5)


def test_features_are_whole():
    long = "a b c. " * 20000 + "| " * 20000
    x = quality.features(pa.array([long, None, "", "Ab"]))
    assert x.shape == (4, quality.FEATURES) and np.isfinite(x).all() and x[0, 1] > 0.1


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(500)}" for _ in range(n)]


def test_recordings(spark):
    a, b = words(150, 1), words(150, 2)
    noisy = np.frombuffer(media.melody(a), "<i2").astype(int) + np.random.default_rng(0).normal(0, 800, 150 * media.HOP).astype(int)
    rows = [
        (10, media.melody(a)),
        (11, media.melody(a)),
        (12, media.melody(["x"] * 17 + a[30:])),
        (13, noisy.astype("<i2").tobytes()),
        (20, media.melody(b)),
        (21, media.melody(words(150, 3))),
        (30, None),
        (31, b""),
        (32, b"\1"),
        (33, media.melody(["short"])),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id long, audio binary, key string")
    got = {r.id: r for r in media.recording_groups(df).collect()}
    assert [got[i].group_id for i in (10, 11, 12, 13)] == [10] * 4 and got[11].class_id == 10 and got[12].class_id == 12
    assert all(got[i].group_id == i for i in (20, 21, 30, 31, 32, 33)) and got[30].n_items == 0
    # every pair by brute force over all offsets
    prints = {i: media.integers(x) for i, x in rows if len(media.integers(x))}
    for i in prints:
        for j in prints:
            best = min((media.bit_errors(prints[i], prints[j], o)[1] for o in range(-140, 140) if media.bit_errors(prints[i], prints[j], o)[0] >= 60), default=1)
            assert (best <= media.ERRORS) == (got[i].group_id == got[j].group_id), (i, j, best)
    assert media.recording_groups(df.limit(0)).collect() == []
    same = spark.createDataFrame([rows[0], rows[0], (None, rows[0][1])], "id long, audio binary")
    assert sorted((r.id or -1, r.group_id) for r in media.recording_groups(same).collect()) == [(-1, 10), (10, 10), (10, 10)]


def test_recordings_with_shared_passages(spark):
    """Passages that unrelated recordings share hide no link; every pair and offset by brute force."""
    near = lambda n, seed: words(n, 1000 + seed)
    p1, p2, p3 = near(60, 1), near(60, 2), near(40, 3)
    texts = {
        1: near(300, 4) + p1 + near(300, 5),  # leads every key of p1
        2: near(300, 6) + p2 + near(300, 7),
        10: p1 + near(4, 8) + p2,
        11: p1 + near(4, 9) + p2,
        20: p3 + near(12, 10) + p3 + near(60, 11),  # a passage twice: only its second place agrees below
        21: p3 + near(60, 11),
        30: ["same"] * 200,
        31: ["same"] * 120,
    }
    r = random.Random(3)
    for i in range(40, 52):
        texts[i] = [w for _ in range(4) for w in r.choice([p1, p2, p3, near(30, 100 + i), near(30, 200 + i % 3)])]
    prints = {i: media.integers(media.melody(t)) for i, t in texts.items()}
    label = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j:
                a, b = prints[i], prints[j]
                ka, kb = ([(x[p], x[p + 1]) for p in range(len(x) - 1)] for x in (a, b))
                for o in range(-len(kb), len(ka)):
                    lo, hi = max(0, o), min(len(ka), len(kb) + o)
                    n, e = media.bit_errors(a, b, o)
                    if n >= media.OVERLAP and e <= media.ERRORS and sum(ka[p] == kb[p - o] for p in range(lo, hi)) >= media.VOTES:
                        old, new = max(label[i], label[j]), min(label[i], label[j])
                        label = {k: new if v == old else v for k, v in label.items()}
                        break
    assert label[1] == 1 and label[2] == 2 and label[11] == label[10] >= 10 and label[21] == label[20] and label[31] == 30
    df = spark.createDataFrame([(i, media.melody(t)) for i, t in texts.items()], "id long, audio binary")
    assert {x.id: x.group_id for x in media.recording_groups(df).collect()} == label
    media.SPLIT, kept = 7, media.SPLIT
    try:
        assert {x.id: x.group_id for x in media.recording_groups(df).collect()} == label
    finally:
        media.SPLIT = kept


def test_every_link_of_recordings(spark):
    """Each pair of a crowd of near copies counts, not only those that join groups; every pair by brute force."""
    base = words(120, 50)
    texts = {i: [*words(4 + i, 60 + i), *base[3 * i :], *words(5, 80 + i)] for i in range(7)} | {9: words(100, 99)}
    prints = {i: media.integers(media.melody(t)) for i, t in texts.items()}
    links = dict.fromkeys(texts, 0)
    for i in prints:
        for j in prints:
            a, b = prints[i], prints[j]
            ka, kb = ([(x[p], x[p + 1]) for p in range(len(x) - 1)] for x in (a, b))
            for o in range(-len(kb), len(ka)):
                n, e = media.bit_errors(a, b, o)
                if i != j and n >= media.OVERLAP and e <= media.ERRORS and sum(ka[p] == kb[p - o] for p in range(max(0, o), min(len(ka), len(kb) + o))) >= media.VOTES:
                    links[i] += 1
                    break
    assert sum(links.values()) > 2 * len(texts) and links[9] == 0
    df = spark.createDataFrame([*((i, media.melody(t)) for i, t in texts.items()), (20, media.melody(texts[0]))], "id long, audio binary")
    got = {x.id: x.n_links for x in media.recording_groups(df).collect()}
    assert got == links | {20: links[0]}


def test_recordings_exchange_no_pairs(spark):
    """Recordings that share passages are compared inside the tasks: what is exchanged does not grow with their pairs."""
    base = words(60, 200)
    texts = {i: [*words(120, 300 + i), *base, *words(120, 400 + i)] for i in range(80)}
    df = spark.createDataFrame([(i, media.melody(t)) for i, t in texts.items()], "id long, audio binary")

    def written():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    assert media.recording_groups(df).count() == 80
    assert 0 < written() - before < 80 * 300 * 4


def test_pairs_of_blocks(monkeypatch):
    """Linked pairs are the same however few places meet at once; every pair and offset by brute force."""
    base, steady = words(90, 500), ["same"] * 60
    texts = [[*words(3 + i, 600 + i), *base[2 * i :], *words(4, 700 + i)] for i in range(5)] + [steady, steady[:40], [*words(30, 1), *steady], ["a", "b"] * 40, ["b", "a"] * 30, ["one"]]
    prints = [p for t in texts if len(p := media.integers(media.melody(t)))]
    block = lambda ps, base: media._Block(list(range(base, base + len(ps))), np.cumsum([len(p) for p in ps]).astype("<i8").tobytes(), b"".join(p.astype("<u4").tobytes() for p in ps), list(range(len(ps))))
    want = set()
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            ka, kb = ([(x[p], x[p + 1]) for p in range(len(x) - 1)] for x in (a, b))
            for o in range(-len(kb), len(ka)):
                same = [p for p in range(max(0, o), min(len(ka), len(kb) + o)) if ka[p] == kb[p - o]]
                n, e = media.bit_errors(a, b, o)
                if len(same) >= media.VOTES and n >= media.OVERLAP and e <= media.ERRORS:
                    want.add((i, j))
                    break
    assert len(want) > 2 * len(prints)
    for most in (1 << 20, 200, 1):
        monkeypatch.setattr(media, "MATCHES", most)
        assert set(zip(*(x.tolist() for x in media._linked(block(prints, 0), block(prints, 0), False)), strict=True)) == want
        x, y = media._linked(block(prints, 0), block(prints, 0), True)
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(i, j) for i, j in want if i < j} and len(x) == len({*zip(x.tolist(), y.tolist(), strict=True)})
