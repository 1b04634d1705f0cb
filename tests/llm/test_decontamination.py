import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from tracelake.llm import decontamination as d


def plain(text):
    return bytes(b for b in text.lower().encode() if b >= 128 or chr(b).isalnum())


def brute(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.randrange(8, 30)))) for i in range(12)]
    rows = [(0, None), (1, ""), (2, "..."), (3, items[0][1]), (3, items[0][1]), (4, "no id " * 9), (5, "a Tiny word, here."), (6, "a tiny word heretic short")]
    for k in range(60):
        text = [word() for _ in range(r.randrange(5, 60))]
        if k % 2:
            leak = list(r.choice(items)[1])
            for _ in range(int(len(leak) * r.choice([0, 0.02, 0.06, 0.09, 0.11, 0.2]))):
                p = r.randrange(len(leak))
                leak[p : p + r.randrange(2)] = r.choice(["", "x", "yz"])
            text[len(text) // 2 : len(text) // 2] = ["".join(leak).upper() if k % 3 == 0 else "".join(leak)]
        rows.append((10 + k, ", ".join(text)))
    return items, rows


def test_brute_force(spark):
    items, rows = corpus(4)
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (None, "no id " * 9), (77, "short"), (78, None), (79, "tiny word here")], "item_id long, text string")
    want = {(4, None, 0), (5, 79, 0), (6, 77, 0)}  # "short" is a word of text 6
    for i, t in rows:
        for k, item in items:
            least = brute(plain(item), plain(t or ""))
            if least <= d.edits_allowed(len(plain(item)), 10):
                want.add((i, k, least))
        least = brute(plain("tiny word here"), plain(t or ""))
        if least <= 1:
            want.add((i, 79, least))
    got = d.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and len(want) >= 12
    assert sum(r.doc_id == 3 for r in got) == 2
    kept = {r.doc_id for r in d.clean(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, *_ in want}
    assert d.leaks(docs, bench.limit(0)).collect() == [] and d.leaks(docs.limit(0), bench).collect() == []


def test_short_items():
    """Items of 1 to 40 letters against brute force; without edits they stand between word ends."""
    r = random.Random(9)
    texts, items = ["", "a", "b a", "ab" * 40, "a" * 60], []
    for n in range(1, 41):
        item = "".join(r.choice("abcdefg") for _ in range(n))
        items.append((n, item))
        bad = list(item)
        for _ in range(r.choice([1, max(1, n // 10)])):
            bad[r.randrange(n)] = r.choice("abcxyz")
        texts += [f"xx {item} yy", f"xx{item}yy", f"zz {''.join(bad)} cc", item]
    got = {m[:3] for m in d.Index(items, 10).matches(pa.array(texts))}
    want = set()
    for k, t in enumerate(texts):
        for n, item in items:
            least = brute(plain(item), plain(t))
            if n >= 10 and least <= n // 10 or n < 10 and re.search(rf"\b{item}\b", t):
                want.add((k, n, least))
    assert got == want


def test_repeated_letters_in_bounded_memory():
    index = d.Index([(1, "a" * 200), (2, "ab" * 150), (3, "q")], 10)
    tracemalloc.start()
    got = index.matches(pa.array(["a" * 1_000_000, "ab" * 100_000, "b" * 300_000, "aab" * 50_000]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [m[:3] for m in got] == [(0, 1, 0), (1, 2, 0)] and most < 500 << 20


def test_blocks(spark, monkeypatch):
    items, rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.leaks(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, d.leaks(docs, bench).collect())) == whole


def test_alignment():
    r = random.Random(2)
    for _ in range(300):
        item = bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 25)))
        region = bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 10))) + item[: r.randrange(len(item) + 1)] + bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 10)))
        got = d.edit_distance(np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8), 60, 0)
        assert got[0] == brute(item, region)
        assert brute(item, region[got[1] : got[2]]) == got[0]
