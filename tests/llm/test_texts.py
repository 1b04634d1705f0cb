"""Operators over texts against plain Python: token counts, token files, substring dedup, mixing, sharding."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelake.llm import coder, mixing, pieces, sharding, substring_dedup, token_counts, token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n", "a  b", " lead", "tail ", "x\n y", "Don't we'll  \t stop\r\n", "naïve Ünïcode — “quotes” 日本語 🙂   nbsp", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "1234567 8", "word " * 3000, "x" * 5000]


def texts(seed=3, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of", "Zwölf", "it's"]
    out = list(ODD)
    shared = [r.choice(vocab) for _ in range(70)]
    for _ in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(1, 120))]
        if r.random() < 0.4:
            i, j = sorted(r.sample(range(71), 2))
            at = r.randrange(len(w))
            w[at:at] = shared[i:j]
        if r.random() < 0.1:
            w = ["same"] * r.randrange(15, 60)
        out.append(r.choice([" ", "  ", "\n"]).join(w))
    out += [out[-1]] * 5
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    ids = random.Random(5).sample(range(1000), len(t))
    return list(zip(ids, t, strict=True))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, "clash", f"s{x[0] % 3}" if x[0] % 7 else None) for x in rows], "doc_id long, text string, bucket string, source string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size long")


def encoded(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, empty, rows, monkeypatch):
    got = sorted(map(tuple, token_counts.token_counts(docs, PATH, 50).collect()))
    assert got == sorted((d, len((t or "").encode()), n := len(encoded(t)), n > 50) for d, t in rows)
    assert token_counts.token_counts(empty, PATH).collect() == []


def test_token_output(spark, docs, empty, rows, monkeypatch):
    start, want = 0, []
    for d, t in sorted(rows, key=lambda x: x[0]):
        ids = [*encoded(t), 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = f"{token_output.work_folder(spark)}/t-{random.random()}"
    token_output.write_tokens(docs, PATH, path)
    assert sorted(map(tuple, token_output.read_index(spark, path).collect())) == want
    back = {r.doc_id: r.ids for r in token_output.read_tokens(spark, path).collect()}
    assert all(back[d] == [*encoded(t), 0] for d, t in rows)
    assert token_output.token_index(empty, PATH).collect() == []
    null = spark.createDataFrame([(None, "b"), (None, "a"), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_output.token_index(null, PATH).orderBy("start").collect()] == [(None, 0, 2), (None, 2, 2), (1, 4, 1)]


def test_coder():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(9000), r.integers(0, 2**32, 5000), r.zipf(1.4, 20000) % 50257, np.tile(r.integers(0, 99, 50), 300), np.array([2**32 - 1])):
        ids = ids.astype(np.uint32)
        packed = coder.encode(ids)
        assert (coder.decode(packed) == ids).all()
    assert len(coder.encode(np.tile(np.arange(50, dtype=np.uint32), 1000))) < 6000
    damaged = bytearray(packed := coder.encode((r.zipf(1.4, 6000) % 500).astype(np.uint32)))
    damaged[-20] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(damaged))


def test_coder_time_and_size():
    r = np.random.default_rng(3)
    ids = (r.zipf(1.3, 500_000) % 50257).astype(np.uint32)
    start = time.process_time()
    packed = coder.encode(ids)
    assert (coder.decode(packed) == ids).all()
    assert time.process_time() - start < 3 and len(packed) < 2 * len(ids)
    for n in (1, 1023, 1025, coder.SHORT * coder.LANES + 1):  # one block, a short last one, blocks that grow
        assert (coder.decode(coder.encode(ids[:n])) == ids[:n]).all() and (coder.decode(coder.encode(np.repeat(ids, 3)[:n])) == np.repeat(ids, 3)[:n]).all()
    for at in (len(packed) // 3, len(packed) // 2):
        damaged = bytearray(packed)
        damaged[at] ^= 4
        with pytest.raises(ValueError):
            coder.decode(bytes(damaged))


def test_coder_mixes_orders():
    """What each prediction alone can tell is told by it; random ids take 10 to 13 bits each, so a lost prediction shows in the size."""
    r = np.random.default_rng(4)
    block = lambda make: np.concatenate([make() for _ in range(64)]).astype(np.uint32)[: 64 * coder.SHORT]

    def size(ids):
        packed = coder.encode(ids)
        assert (coder.decode(packed) == ids).all()
        return len(packed) / len(ids)

    def alternate():  # after 0 come turns of all others, so only the last two ids tell the next
        others = r.permutation(np.arange(1, 33))
        return np.tile(np.stack([np.zeros(32, int), others], 1).ravel(), coder.SHORT // 64)

    assert size(block(alternate)) < 0.2

    def chain():  # 512 ids of 2000, each with a follower of its own, which contexts that share a place would forget
        return np.tile(r.permutation(2000)[:512], coder.SHORT // 512)

    assert size(block(chain)) < 0.85
    few = lambda: r.choice(r.permutation(20_000)[:16], coder.SHORT)  # noqa: E731  each block has its own 16 ids, 4 bits each and 16 new ones
    assert size(block(few)) < 0.65


def test_coder_keeps_each_block_apart():
    r = np.random.default_rng(5)
    ids = (r.zipf(1.3, 9000) % 3000).astype(np.uint32)
    for n in (2, 3, 1024, 1030, 5000):
        assert (coder.decode(coder.encode(ids[:n])) == ids[:n]).all()
    kept = coder.LANES, coder.SHORT
    coder.LANES, coder.SHORT = 3, 64  # several groups of lanes, blocks of BLOCK ids and a short last one
    try:
        assert (coder.decode(coder.encode(ids)) == ids).all()
    finally:
        coder.LANES, coder.SHORT = kept


def without(rows, length=20):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in sorted(split, key=lambda x: x[0]):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (d, i))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < (d, i) for j in range(i, i + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, docs, empty, rows, monkeypatch):
    got = substring_dedup.without_repeats(docs).drop("kept")
    assert sorted(map(tuple, got.collect())) == without(rows)
    assert substring_dedup.without_repeats(empty).collect() == []
    run = " ".join(f"v{i}" for i in range(25))
    odd = spark.createDataFrame([(None, run), (4, run), (4, run), (9, "a " + run + " b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.without_repeats(odd).collect())
    assert got == [(-1, 25, 0), (4, 25, 25), (4, 25, 25), (9, 27, 25)]


def test_mixing(spark, docs, empty):
    sized = docs.select("doc_id", "source", mixing.words_of("text").alias("size"))
    out = mixing.mixed(sized)
    got = out.collect()
    assert len(got) == docs.count()
    source = {}
    for r in got:
        s = source.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.taken
        s[3] += r.size
        assert r.taken in (0, r.size, 2 * r.size)
    order = sorted(source, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, goal, full = 1.5 * sum(s[0] for s in source.values()), {}, set()
    while True:  # share, cut, reshare
        left = total - sum(2 * source[s][0] for s in full)
        goal = {s: 2 * source[s][0] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        if not (over := {s for s in order if goal[s] > 2 * source[s][0]}):
            break
        full |= over
    for s, (size, target, taken, summed) in source.items():
        assert size == summed and abs(target - goal[s]) < 1e-6
        assert abs(taken - target) <= 3000  # the longest document
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(sized).collect()), key=str)
    assert mixing.mixed(empty).collect() == []
    alone = spark.createDataFrame([(None, None, 5), (1, None, 5), (1, None, 5), (2, "a", 0)], "doc_id long, source string, size long")
    assert sum(r.taken for r in mixing.mixed(alone).collect()) == 20


def test_sharding(spark, docs, empty):
    for df in (docs, docs.union(docs), spark.createDataFrame([(i, "same text of a large group") for i in range(500)] + [(None, None), (3, None)], "doc_id long, text string")):
        got = sharding.shards(df, 4, 0.002).collect()
        assert len(got) == df.count()
        size, slots, groups = [0] * 4, [[] for _ in range(4)], {}
        for r in got:
            size[r.shard] += r.size
            slots[r.shard].append(r.slot)
            groups.setdefault(r.text_crc32, set()).add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots)
        assert max(size) - min(size) <= max(2 * max(r.size for r in got), 0.01 * sum(size)), size
        assert sum(len(g) > 1 for g in groups.values()) <= 3
    assert sharding.shards(empty).collect() == []
    crc = {r.doc_id: (r.size, r.text_crc32) for r in sharding.shards(docs).collect()}
    assert all(crc[r.doc_id] == (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())


def test_units_are_encoded_together(monkeypatch):
    p, r, whole = pieces.Pieces(PATH), random.Random(6), Tokenizer.from_file(PATH)
    ids_of = lambda t: np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    alone = []
    monkeypatch.setattr(p, "_encoded", lambda texts, of=p._encoded: (alone.extend(texts), of(texts))[1])
    odd = [" ", "x", "é", "\U0001f600", "'s", "\t", "\n", "a", "B9", "<|endoftext|>", "\x00", "　", "﻿", "\x85", ","]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["a " + " ".join(f"w{i}" for i in range(2 * pieces.JOINED + 1)), ""]
    assert p.ids(texts) == [ids_of(t) for t in texts]
    assert len(alone) == len(texts)  # beginnings and texts with special strings; other units go together
    p.width[:] = 2  # where the bytes do not meet the units' ends, each unit is encoded alone
    p.units.clear()
    assert p.ids(texts[-2:]) == [ids_of(t) for t in texts[-2:]]


def test_plain_units_go_to_the_model(monkeypatch):
    """Units of plain characters reach the library's model by distinct pre-tokens, others its whole path; what is remembered changes no ids."""
    p, r, whole = pieces.Pieces(PATH), random.Random(8), Tokenizer.from_file(PATH)
    ids_of = lambda t: np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    joined = []
    monkeypatch.setattr(p, "_encoded_units", lambda units, of=p._encoded_units: (joined.extend(units), of(units))[1])
    monkeypatch.setattr(pieces, "KEPT_UNITS", 300)
    odd = ["don't", "Ünïcode", "x²½", "a,b", "(ª", "été!", "12a", "\u0131", "\u0250", "日本", "a\tb", "\x1c", "\u00ad", "\u00a0", "", "…"]
    for seed in range(4):
        texts = [" ".join(r.choice(odd) if r.random() < 0.3 else f"w{r.randrange(2000)}" for _ in range(r.randint(0, 90))) for _ in range(60)]
        assert p.ids(texts) == [ids_of(t) for t in texts] and len(p.units) <= 300
    assert joined and all(any(c in "\t\x1c\u00ad\u00a0\u0250日本…" for c in u) or " " in u[1:] for u in joined)
    monkeypatch.setattr(p, "split", None)  # no pre-token is split again where all units are remembered
    some = [" ".join(["x", *list(p.units)[:50]])]
    assert p.ids(some) == [ids_of(some[0])]
