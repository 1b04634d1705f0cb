import random
import zlib

import numpy as np
import pyarrow as pa

from tracelake.llm import gru, toxicity


def test_gradients():
    r = np.random.default_rng(0)
    p = gru.fresh(3, 4, 5, dtype=np.float64)
    x, mask = r.normal(size=(6, 4, 3)), np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    y, w = np.array([1.0, 0, 1, 0]), np.array([0.5, 1, 2, 1])
    _, g = gru.gradients(p, x, mask, y, w)
    for k in p:
        at = tuple(r.integers(0, n) for n in p[k].shape)
        old = p[k][at]
        p[k][at] = old + 1e-5
        up = gru.gradients(p, x, mask, y, w)[0]
        p[k][at] = old - 1e-5
        down = gru.gradients(p, x, mask, y, w)[0]
        p[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5, k


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 200))]
        bad = r.random() < 0.3
        if bad:
            w[r.randrange(len(w))] = r.choice(["nasty", "NASTY,", "vile", "%%vile%%", "zorgat", "zorglum", "zorgix"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, ""), (5000, "", ""), (5001, "...", ""), (5001, "...", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:800]] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    y = {i: v for i, _, v in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    right = [r.predicted == y[r.doc_id] for r in held if r.doc_id in y]
    assert np.mean(right) > 0.93


def test_windows_and_whole_texts():
    t = toxicity.Tokens(pa.array(["a b", None, "", " ".join(["x"] * 200), "." * 9, " ".join(["y"] * 64)]))
    start, text = t.windows()
    assert text.tolist() == [0, 3, 3, 3, 3, 5]
    assert (start - t.first[text]).tolist() == [0, 0, 48, 96, 144, 0]
    rows = [(x, y) for _, x, y in corpus(400, 2)]
    model = toxicity.fit(rows, epochs=8)
    late = " ".join(["wak"] * 3000 + ["nasty"])
    s = gru.sigmoid(toxicity.Tokens(pa.array([late, " ".join(["wak"] * 3000)])).scores(model))
    assert s[0] > 0.5 > s[1]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.fit_on(docs, none)).count() == 1
    assert toxicity.scored(docs.limit(0), toxicity.fit([("a", 1)])).collect() == []


def test_scores_by_plain_loops():
    """Tokens, their inputs, both directions, the attention and the highest window again, one token at a time."""
    rows = [(x, y) for _, x, y in corpus(200, 3)]
    model = toxicity.fit(rows, epochs=2)
    p, tables = model["network"], model["tables"]
    texts = [rows[0][0], "One tWo, three", "x", "", "... !", " ".join(f"w{i % 7} nasty{i}" for i in range(120)), "ä" * 3 + " Öl", rows[1][0] * 3]

    def tokens(text):
        out, now = [], b""
        for b in text.encode():
            if b < 128 and not chr(b).isalnum():
                out, now = out + [now] * bool(now), b""
            else:
                now += bytes([b + 32 if 65 <= b <= 90 else b])
        return out + [now] * bool(now)

    def vector(token):
        one = toxicity.Tokens(pa.array([token.decode()]))
        a, b = (tables[f"w{i}"][one.word[i][0]] for i in (0, 1))
        out = [a, b, a if abs(a) < abs(b) else b, np.log(len(token) + 2) - 2]
        marked = b"\2" + token + b"\3"
        for i, g in enumerate(toxicity.GRAMS):
            odds = [tables[f"g{i}"][one.grams[i][0][j]] for j in range(len(marked) - g + 1)]
            out += [max([-2.0, *odds]), sum(odds) / max(1, len(odds))]
        return np.array(out)

    def cell(d, x, h):
        k = len(h)
        g, u = x @ p[f"{d}W"] + p[f"{d}b"], h @ p[f"{d}U"]
        r, z = (1 / (1 + np.exp(-(g[s] + u[s]))) for s in (slice(0, k), slice(k, 2 * k)))
        return (1 - z) * np.tanh(g[2 * k :] + r * u[2 * k :]) + z * h

    def logit(window):
        ways = []
        for d, order in (("f", window), ("b", window[::-1])):
            h, out = np.zeros(len(p["fU"])), []
            for x in order:
                h = cell(d, x, h)
                out.append(h)
            ways.append(out if d == "f" else out[::-1])
        states = [np.concatenate(x) for x in zip(*ways, strict=True)]
        e = np.array([np.tanh(s @ p["aW"]) @ p["av"] for s in states])
        w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return sum(a * s for a, s in zip(w, states, strict=True)) @ p["o"] + p["c"][0]

    want = []
    for text in texts:
        v = [vector(t) for t in tokens(text)]
        edges = [0]
        while edges[-1] + toxicity.WINDOW < len(v):
            edges.append(edges[-1] + toxicity.STRIDE)
        want.append(max(logit(v[i : i + toxicity.WINDOW]) for i in edges) if v else model["empty"])
    assert np.allclose(toxicity.Tokens(pa.array(texts)).scores(model), want, atol=1e-3)
