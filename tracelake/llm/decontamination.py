"""Operator 3: benchmark decontamination by q-gram lemma filtering.

A text and an item are compared as their letters and digits (case folded), so spacing and punctuation do
not hide a leak.  Two strings within e edits share at least L - q + 1 - q * e of the item's q-grams, and
the shared ones lie within e diagonals of each other.  Hits of a text's q-grams in the item
are counted in overlapping bands of diagonals, 2 e wide and starting every e, so some band
holds all hits of a match; bands that reach the bound give regions, and a banded alignment of item and
region, free to start and end anywhere in the region, decides.

The benchmark goes to the tasks in blocks of a fixed size, one pass over the texts for each
block, so what is sent is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, flat, slices

Q = 8
BLOCK_BYTES = 4 << 20
Q_SHORT = 5  # q-grams of items of fewer than LONG letters, so that these too share one for certain within 10 % of edits
LONG = 32  # letters and digits of an item
HITS = 1 << 21  # hits, or grams with their items, that are held at once
LANES = 256  # alignments that advance together
CELLS = 1 << 20  # cells of a row in all lanes together
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of letters and digits (and of all characters beyond ASCII), A-Z folded, with the texts' new offsets."""
    kept = np.flatnonzero(_LETTER[data])
    return _FOLD[data[kept]], np.searchsorted(kept, off)


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes from each place on (q is 8 at most), as one integer."""
    if len(data) < q:
        return np.zeros(0, U64)
    data = np.concatenate([data, np.zeros(8 - q, np.uint8)])
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) & U64(2 ** (8 * q) - 1)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * U64(0x9E3779B97F4A7C15)) >> U64(42)


def gram_length(length: int) -> int:
    """q for an item of so many letters: with it, an item within its edits shares a q-gram for certain."""
    return Q if length >= LONG else min(length, Q_SHORT)


def edits_allowed(length, percent: int):
    """percent % of the letters (up to 10 %, an item's q-grams are enough for that), but no more than leave one shared q-gram for certain."""
    q = np.where(length >= LONG, Q, np.minimum(length, Q_SHORT))
    return np.minimum(length * percent // 100, (length - q) // np.maximum(1, q))


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of numbers: the range of each number, and the numbers."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[which]


def _blocked(size: np.ndarray, most: int):
    """Slices of consecutive rows that hold about `most` together."""
    total, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def alignments(items: list[np.ndarray], data: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """For each lane the least edits between its whole item and any part of data[low:high] (most + 1: more), and that part's
    first and end place in the region.  All lanes advance in step, one letter of their items at a time.

    Cells further than `most` diagonals from `shift` (region place minus item place) are not looked at.
    """
    length, n = np.array([len(x) for x in items]), high - low
    out = np.zeros((len(items), 3), np.int64)
    out[:, 0] = most + 1
    width = 2 * int(most.max()) + 1
    k = np.arange(width)
    padded = np.zeros((len(items), int(length.max())), np.uint8)
    for row, x in zip(padded, items, strict=True):
        row[: len(x)] = x
    lane, big = np.arange(len(items)), (most + 1)[:, None]
    base, first, end = low[:, None], (shift - most)[:, None], n[:, None]  # cell k of row i stands at region place i + first + k
    place = first + k
    out_of_band = k > 2 * most[:, None]
    cost = np.where((place >= 0) & (place <= end) & ~out_of_band, 0, big)
    start = place.copy()
    last = max(0, len(data) - 1)
    for i in range(padded.shape[1]):
        at = i + first + k  # region letter that cell k's diagonal step would use
        same = (data[np.clip(base + at, 0, last)] == padded[lane, i, None]) & (at >= 0) & (at < end)
        step, origin = np.where(same, cost, np.where((at >= 0) & (at < end), cost + 1, big)), start
        skip = np.concatenate([cost[:, 1:], big], 1) + 1  # the item's letter is missing in the region
        better = skip < step
        step, origin = np.where(better, skip, step), np.where(better, np.roll(start, -1, 1), origin)
        step = np.where((at >= -1) & (at < end) & ~out_of_band, np.minimum(step, big), big)
        # letters that only the region has: a running minimum along the row
        run = np.minimum.accumulate((step - k) * width + k, 1)
        cost, start = np.minimum(run // width + k, big), np.take_along_axis(origin, run % width, 1)
        done = length[lane] == i + 1
        if done.any():
            for j in np.flatnonzero(done):
                c = int(cost[j].argmin())
                out[lane[j]] = cost[j, c], start[j, c], i + 1 + first[j, 0] + c
        if done.any() or i % 16 == 15:
            keep = ~done & (cost.min(1) < big[:, 0])
            if not keep.any():
                break
            lane, big, base, first, end, out_of_band, cost, start = (x[keep] for x in (lane, big, base, first, end, out_of_band, cost, start))
    return out


def edit_distance(item: np.ndarray, region: np.ndarray, most: int, shift: int) -> tuple[int, int, int]:
    """`alignments` of one item."""
    if not len(region):
        region = np.zeros(1, np.uint8)  # never read: the region's end is 0
        return tuple(alignments([item], region, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([most]), np.array([shift]))[0].tolist())
    return tuple(alignments([item], region, np.zeros(1, np.int64), np.array([len(region)]), np.array([most]), np.array([shift]))[0].tolist())


class Index:
    """A block of items: those of one q-gram length together."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        data, off = letters(*flat(pa.array([t for _, t in items], pa.string())))
        texts = [data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        kinds: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            if len(t):
                kinds.setdefault(gram_length(len(t)), []).append(k)
        self.parts = [_Grams(q, [items[k][0] for k in own], [texts[k] for k in own], percent) for q, own in sorted(kinds.items())]

    def matches(self, col) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, edits, first and end letter) of every item found in a text, at its best place."""
        raw, raw_off = flat(col)
        data, off = letters(raw, raw_off)
        kept = np.flatnonzero(_LETTER[raw])
        found = [(t, part.ids[i], *v) for part in self.parts for (t, i), v in part.matches(raw, raw_off, kept, data, off).items()]
        return sorted(found, key=lambda m: (m[0], m[1] is None, m[1] or 0, *m[2:]))


class _Grams:
    """The q-grams of items: for each gram the items that hold it, and for each such pair the gram's places in the item."""

    def __init__(self, q: int, ids: list, texts: list[np.ndarray], percent: int):
        self.q, self.ids, self.texts = q, ids, texts
        self.length = np.array([len(t) for t in texts], np.int64)
        g = np.concatenate([grams(t, q) for t in texts])
        n = self.length - q + 1
        who, at = _spread(np.zeros(len(n), np.int64), n)
        order = np.lexsort((at, who, g))
        g, who, self.at = g[order], who[order], at[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (who[1:] != who[:-1])
        self.place = np.append(np.flatnonzero(new), len(g))  # of a (gram, item) pair: where its places begin
        self.who = who[new]
        self.keys, first = np.unique(g[new], return_index=True)
        self.first = np.append(first, len(self.who))  # of a gram: where its pairs begin
        self.seen = np.zeros(1 << 22, bool)
        self.seen[_slot(self.keys)] = True
        self.edits = edits_allowed(self.length, percent)
        self.bound = np.maximum(1, n - q * self.edits)

    def matches(self, raw, raw_off, kept, data, off) -> dict[tuple[int, int], tuple[int, int, int]]:
        h = grams(data, self.q)
        place = np.flatnonzero(self.seen[_slot(h)])
        gram = np.minimum(np.searchsorted(self.keys, h[place]), len(self.keys) - 1)
        text = np.searchsorted(off, place, "right") - 1
        ok = (self.keys[gram] == h[place]) & (place + self.q <= off[text + 1])
        place, gram, text = place[ok], gram[ok], text[ok]
        if not len(place):
            return {}
        # each gram of a text once, with its places in order
        key = text * len(self.keys) + gram
        order = np.argsort(key, kind="stable")
        place = place[order]
        key, begin, times = np.unique(key[order], return_index=True, return_counts=True)
        text, gram = key // len(self.keys), key % len(self.keys)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        holders = self.first[gram + 1] - self.first[gram]
        whole = np.append(np.flatnonzero(np.diff(text)) + 1, len(text))  # texts stay whole
        per = np.diff(np.concatenate([[0], np.cumsum(holders)[whole - 1]]))
        for part in _blocked(per, HITS):
            rows = slice(whole[part.start - 1] if part.start else 0, whole[part.stop - 1])
            which, pair = _spread(self.first[gram[rows]], holders[rows])
            t, item = text[rows][which], self.who[pair]
            many = self.place[pair + 1] - self.place[pair]
            # a text with the grams of fewer places of an item than the bound can't hold it, wherever they lie
            both, number = np.unique(t * len(self.ids) + item, return_inverse=True)
            good = (np.bincount(number, many) >= self.bound[both % len(self.ids)])[number]
            t, item, pair, many, number = (x[good] for x in (t, item, pair, many, number))
            begins, counts = begin[rows][which][good], times[rows][which][good]
            self._exact(best, raw, raw_off, kept, off, place, t, item, pair, begins, counts)
            loose = self.edits[item] > 0
            order = np.flatnonzero(loose)[np.argsort(number[loose], kind="stable")]
            t, item, pair, many, number, begins, counts = (x[order] for x in (t, item, pair, many, number, begins, counts))
            if not len(t):
                continue
            ends = np.append(np.flatnonzero(np.diff(number)) + 1, len(number))
            hits = np.diff(np.concatenate([[0], np.cumsum(many * counts)[ends - 1]]))
            for few in _blocked(hits, HITS):
                own = slice(ends[few.start - 1] if few.start else 0, ends[few.stop - 1])
                if hits[few.start] > HITS:  # one text and item whose grams repeat so often that counting would not tell bands apart
                    k, w = int(item[own][0]), max(1, int(self.edits[item[own][0]]))
                    band = np.arange(-(int(self.length[k]) // w) - 2, (int(off[t[own][0] + 1] - off[t[own][0]])) // w + 1)
                    self._align(best, data, off, np.full(len(band), t[own][0]), np.full(len(band), k), band)
                    continue
                row, k = _spread(np.zeros(own.stop - own.start, np.int64), many[own] * counts[own])
                at = self.at[self.place[pair[own][row]] + k % many[own][row]]
                where = place[begins[own][row] + k // many[own][row]]
                self._align(best, data, off, *self._bands(t[own][row], item[own][row], at, where - off[t[own][row]] - at))
        return best

    def _bands(self, text, item, at, diagonal):
        """(text, item, band) of the overlapping bands whose hits reach the bound; every hit counts in two of them."""
        band = diagonal // np.maximum(1, self.edits[item])
        key_band = np.concatenate([band, band - 1])
        span = int(np.abs(key_band).max()) + 2
        key = (np.tile(text, 2) * len(self.ids) + np.tile(item, 2)) * (2 * span) + key_band + span
        key, which, n = np.unique(key, return_inverse=True, return_counts=True)
        bound = self.bound[key // (2 * span) % len(self.ids)]
        # a q-gram of the item counts once in a band, so the lemma's bound is not met by one repeated piece of it
        often = np.flatnonzero((n >= bound)[which])
        most = int(self.length.max())
        distinct = np.unique(which[often] * most + np.tile(at, 2)[often]) // most
        number, n = np.unique(distinct, return_counts=True)
        key = key[number[n >= bound[number]]]
        return key // (2 * span) // len(self.ids), key // (2 * span) % len(self.ids), key % (2 * span) - span

    def _align(self, best, data, off, text, item, band) -> None:
        """Aligns the regions in order.  Behind a place without edits no other of its text and item can be better."""
        done: dict[tuple[int, int], int] = {}
        i, widest = 0, 1 + 4 * int(self.edits[item].max()) if len(item) else 1
        lanes = max(1, min(LANES, CELLS // max(widest, int(self.length.max()))))
        while i < len(text):
            part = np.arange(i, min(i + lanes, len(text)))
            i += lanes
            if done:
                part = part[[done.get((t, k), b) + 2 >= b for t, k, b in zip(text[part].tolist(), item[part].tolist(), band[part].tolist(), strict=True)]]
            if not len(part):
                continue
            t, k, b = text[part], item[part], band[part]
            edits, width = self.edits[k], np.maximum(1, self.edits[k])
            low = off[t] + np.clip(b * width - edits, 0, off[t + 1] - off[t])
            high = np.maximum(low, np.minimum(off[t + 1], off[t] + (b + 2) * width + self.length[k] + edits))
            found = alignments([self.texts[x] for x in k], data, low, high, 2 * edits, off[t] + b * width + width - low)
            for x, y, z, e, o, (cost, first, past) in zip(t.tolist(), k.tolist(), b.tolist(), edits.tolist(), (low - off[t]).tolist(), found.tolist(), strict=True):
                if cost <= e:
                    now = (cost, o + first, o + past)
                    best[x, y] = min(best.get((x, y), now), now)
                    if not cost:
                        done.setdefault((x, y), z)

    def _exact(self, best, raw, raw_off, kept, off, place, text, item, pair, begins, counts) -> None:
        """The first whole occurrence, between word ends, of items that are too short for edits; tried wherever their first gram stands."""
        head = np.flatnonzero((self.edits[item] == 0) & (self.at[self.place[pair]] == 0))
        for t, i, a, n in zip(text[head].tolist(), item[head].tolist(), begins[head].tolist(), counts[head].tolist(), strict=True):
            size, letter = int(self.length[i]), place[a : a + n]
            letter = letter[letter + size <= off[t + 1]]
            first, last = kept[letter], kept[letter + size - 1]
            left = (first == raw_off[t]) | ~_LETTER[raw[first - 1]]
            right = (last + 1 == raw_off[t + 1]) | ~_LETTER[raw[np.minimum(last + 1, len(raw) - 1)]]
            for p in letter[left & right].tolist():
                if np.array_equal(_FOLD[raw[kept[p : p + size]]], self.texts[i]):
                    best[t, i] = (0, p - int(off[t]), p - int(off[t]) + size)
                    break


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 10) -> DataFrame:
    """Benchmark items that occur in texts with at most percent % of their letters edited.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored.  Returns one row for each
    document row and item: doc_id, item_id, edits, first and past (places among the text's letters and digits).
    Null and blank texts match nothing.  Items too short for an edit (9 letters or digits at 10 %) count where they stand
    between word ends; items without letters or digits match nothing.  Items with a null id are found like others.  Rows
    that repeat are returned as often as they come.  Empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for sent in _blocks(benchmark):

        def run(batches, sent=sent):
            index = Index(sent.value, percent)
            for batch in batches:
                for cut in slices(batch, "text", 2 << 20):
                    found = index.matches(cut.column(1))
                    if found:
                        t, i, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([cut.column(0).take(pa.array(t)), *(pa.array(x, pa.int64()) for x in (i, *rest))], ["doc_id", "item_id", "edits", "first", "past"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, edits long, first long, past long")
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame):
    """The items as broadcasts of about BLOCK_BYTES each."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 10) -> DataFrame:
    """The rows in whose text no item was found, with all their columns and without an exchange; a filter for each block of items."""
    for sent in _blocks(benchmark):

        def run(batches, sent=sent):
            index = Index(sent.value, percent)
            for batch in batches:
                for cut in slices(batch, "text", 2 << 20):
                    keep = np.ones(cut.num_rows, bool)
                    keep[[m[0] for m in index.matches(cut.column(cut.schema.get_field_index("text")))]] = False
                    yield cut.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
