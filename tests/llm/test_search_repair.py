"""Operators 12 and 13 against brute-force versions on small tables."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import pytest

from tracelake.llm import role_repair as rr, term_scan as ts

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranking(docs, items, top):
    terms = lambda t: re.findall(ts.TERM, (t or "").translate(FOLD))
    held = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in wanted.items():
        scores = []
        for d, t in held:
            if not t:
                continue
            m = 50 + 50 * len(t) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in q if x in t)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_ranking_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(ts, "BLOCK_BYTES", block)
    rng = random.Random(3)
    words = ["a", "B", "ab", "été", "ÉTÉ", "x1", "日本", "the", "THE", "zz", "q"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x7f", "-", "  "]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 30))) for k in range(120)] + [(3, "the zz"), (3, "the zz"), (None, "ab q"), (200, None), (201, ""), (202, "zz " * 3000)]
    items = [(k, text(rng.randint(0, 5))) for k in range(9)] + [(None, "q zz"), (4, "ab"), (50, None), (51, "unheard")]
    got = ts.ranking(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, score string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), top=7)
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain_ranking(docs, items, 7))


def test_ranking_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab")], "item_id long, text string")
    assert ts.ranking(none, items).count() == 0
    assert ts.ranking(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ts, "PIECE_BYTES", 16)
    block = ts.Block([(1, "ab"), (1, "é"), (1, "x" * 40)])
    n, doc, term, tf = block.counted(pa.array(["ab é " * 50, None, "x" * 40 + " ab", "abab"]))
    assert n.tolist() == [100, 0, 2, 1] and sorted(zip(doc.tolist(), tf.tolist(), strict=True)) == [(0, 50), (0, 50), (2, 1), (2, 1)]


# ---------------------------------------------------------------- conversations


def cheapest(symbols):
    """Least (cost, audit) over all edits, by dynamic programming over (rows read, place in s?(ua)+)."""
    arcs = {"start": {"s": "system", "u": "open"}, "system": {"u": "open"}, "open": {"a": "pair"}, "pair": {"u": "open"}}
    best = {(0, "start"): (0, "")}
    for k in range(len(symbols) + 1):
        for _ in range(4):  # insertions
            for (i, state), (c, audit) in list(best.items()):
                if i == k:
                    for s in "ua":
                        if s in arcs[state]:
                            to, v = (k, arcs[state][s]), (c + 2, audit + "I")
                            best[to] = min(best.get(to, v), v)
        if k == len(symbols):
            break
        role, extra, dead = symbols[k]
        for (i, state), (c, audit) in list(best.items()):
            if i != k:
                continue
            moves = [(state, (c + 3, audit + "D"))]
            if not dead:
                moves += [(arcs[state][role], (c + extra, audit + "K"))] if role in arcs[state] else []
                moves += [(arcs[state][s], (c + 2 + extra, audit + "R")) for s in "ua" if s != role and s in arcs[state]]
            for to, v in moves:
                best[k + 1, to] = min(best.get((k + 1, to), v), v)
    return min(best[len(symbols), s] for s in ("start", "pair") if (len(symbols), s) in best)


def test_repair_against_search():
    code = {("s", 0): "s", ("u", 0): "u", ("a", 0): "a", ("s", 1): "S", ("u", 1): "U", ("a", 1): "A"}
    for n in range(5):
        for symbols in itertools.product([*code, ("u", None)], repeat=n):
            text = "".join(rr.GONE if e is None else code[r, e] for r, e in symbols)
            assert rr.repair(text) == cheapest([(r, e or 0, e is None) for r, e in symbols]), text
    rng = random.Random(8)
    for _ in range(300):
        symbols = [rng.choice([*code, ("u", None)]) for _ in range(rng.randint(5, 60))]
        text = "".join(rr.GONE if e is None else code[r, e] for r, e in symbols)
        assert rr.repair(text) == cheapest([(r, e or 0, e is None) for r, e in symbols]), text


def plain_report(rows):
    """(conv_id, ...) of each conversation of rows (conv_id, turn, role, text) as they come, after damage."""
    every = {r[0] for r in rows}
    say = lambda x: " " if x is None else str(x)
    kept = {}
    for conv, turn, role, text in rows:
        role, fault = say(role), zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", say(text)) if fault == 2 else say(text)
        for _ in range(2 if fault == 3 else fault != 0):
            kept.setdefault(conv, []).append((turn, "user" if fault == 4 else role, text))
    out = []
    for conv in every:
        own = sorted(kept.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults, symbols = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append((role[:1], int(fault == "truncated"), fault in ("blank", "duplicate")))
        cost, audit = cheapest(symbols)
        i, need, left = 0, "u", []
        for c in audit:
            if c == "D":
                i += 1
                continue
            role = own[i][1] if c == "K" else {"u": "user", "a": "assistant"}[need]
            left.append(f"{role}:{'' if c == 'I' else own[i][2]}")
            i += c != "I"
            need = "a" if role[:1] == "u" else "u"
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [12, 2])
def test_report_against_plain(spark, monkeypatch, bits):
    monkeypatch.setattr(rr, "CHUNK_BITS", bits)  # 4 rows a chunk: most conversations lie in several
    rng = random.Random(4)
    rows = [(k, t, "user" if t % 2 else "assistant" if rng.random() < 0.9 else "system", rng.choice(["So it is.", "And then", "", " \n", "Why?", "x. ", "ok!"])) for k in range(60) for t in range(rng.randint(1, 12))]
    rows += [(None, 1, "user", "Hm."), (None, None, None, None), (70, None, "assistant", "a."), (71, 1, "tool", "b."), (72, 9, "user", "x" * 30_000)] + [(80, t, "user", "Same.") for t in range(40)] + [(rows[0])] * 3
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int").repartition(3)
    got = rr.with_lost(rr.report(rr.damaged(frame)), frame).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain_report(rows), key=key)
    assert rr.report(frame.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (2, 0, "user", " ")]
    got = rr.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.action, r.role, r.text) for r in got] == [(1, "K", "user", "Hi."), (1, "I", "assistant", ""), (1, "K", "user", "Again."), (1, "K", "assistant", "Yes."), (2, "D", "user", " ")]


def test_long_conversation_costs_no_more_a_row():
    rng = random.Random(2)
    text = "".join(rng.choice("uaUAsSx") for _ in range(400))
    start = time.process_time()
    cost, audit = rr.repair(text)
    assert time.process_time() - start < 5
    code = {"s": ("s", 0), "u": ("u", 0), "a": ("a", 0), "S": ("s", 1), "U": ("u", 1), "A": ("a", 1), "x": ("u", 0)}
    assert (cost, audit) == cheapest([(*code[c], c == "x") for c in text])
