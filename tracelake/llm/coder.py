"""Context-mixing range coder for ids, in blocks that are reset and checksummed one by one.

The probability of an id is a mixture of four predictions: the id that followed the previous two ids (order 2), the one that followed
the previous id (order 1), the adaptive counts of the block (order 0), and for ids that are new in the block the counts of the call.
The weights of the mixture are learnt in each block from how often such a prediction was right so far: those of orders 2 and 1 for each
level of confidence, that of order 0 after each kind of prediction.  Every pair of ids is a context of its own.  Order 0 counts the ids
that neither guess has told.  The mixture drives a 64-bit range coder that puts out 32-bit words.

All blocks of a call advance in step, one id at a time, as rows of numpy arrays; a block depends on the table of the call alone, never
on another block.  Inside a block ids are numbered as they come, so a new one needs no table of the block.

Coded: blocks u32, size of the table u32, table (zlib: distinct ids u32, their ids in ascending order as differences u32, their
shares u32), and for each block: ids u32, distinct ids u32, words u32, crc32 of the ids as little-endian u32; then the words of all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096  # ids of a block at most
SHORT = 1024  # and, where blocks are too few to fill LANES, at least
LANES = 2048  # blocks of SHORT ids that advance in step; fewer of longer ones
SCALE = 24  # bits of the mixture's total
LEVEL_BITS = 3
LEVELS = 1 << LEVEL_BITS  # of confidence
RATE = 4  # of learning: a weight moves by 1/16 of its error
_AIM = np.where(np.arange(4) == np.arange(3)[:, None], 65472, 64).astype(np.int32)  # of a weight after each kind of prediction
GAIN = 16  # of an id's order-0 count each time it comes, over 1 for each id known
FOLLOW = 32  # steps after which order 0 follows its counts
_U = np.uint64
_WORD = _U(32)
_LOW = _U(0xFFFFFFFF)
_HEAD = struct.Struct("<2I")
_BLOCK = np.dtype([("ids", "<u4"), ("distinct", "<u4"), ("words", "<u4"), ("crc", "<u4")])


def _shares(count: np.ndarray) -> np.ndarray:
    """Counts as shares, none of them 0, of a power of two at least 16 times their number."""
    total = 1 << max(12, (len(count) - 1).bit_length() + 4)
    share = 1 + count.astype(np.int64) * (total - len(count)) // max(1, int(count.sum()))
    share[share.argmax()] += total - share.sum()
    return share


class _Table:
    """The counts of the call, for ids that are new in a block."""

    def __init__(self, share: np.ndarray):
        self.total = int(share.sum())
        self.edge = np.concatenate([[0], np.cumsum(share)])
        self.symbol = np.repeat(np.arange(len(share), dtype=np.int32), share) if self.total <= 1 << 22 else None

    def find(self, value: np.ndarray) -> np.ndarray:
        return self.symbol[value] if self.symbol is not None else np.searchsorted(self.edge, value, "right") - 1


class _Model:
    """The predictions of all lanes; ids are numbered from 0 in each block, as they come.

    A prediction stands as guess * LEVELS + level, -1 where there is none.  Those of order 2 are in a table of open addresses with twice
    as many places as ids, above the number of their context.
    """

    def __init__(self, n: int, width: int, block: int):
        self.width, self.bits = width, (2 * block - 1).bit_length()
        self.lane = np.arange(n)
        self.row, self.edge_row, self.slots, self.level_row = self.lane * width, self.lane * (width + 1), self.lane << self.bits, self.lane * LEVELS
        self.one = np.full(n * width, -1, np.int32)
        self.two = np.full(n << self.bits, -1, np.int64)
        self.weight = np.full((3, n * LEVELS), 1 << 15, np.int32)
        self.count, self.edges = np.zeros((n, width), np.int32), np.zeros((n, width + 1), np.int32)
        self.flat_count, self.flat_edges = self.count.ravel(), self.edges.ravel()
        self.known, self.last, self.before, self.kind = (np.zeros(n, np.int64) for _ in range(4))
        self.step = 0

    def _place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts of order 2 stand, or would stand, and what is there."""
        mask, first = (1 << self.bits) - 1, self.slots[: len(key)]
        inside = (key * 0x9E3779B1 >> 12) & mask
        at = first + inside
        found = self.two[at]
        other = np.flatnonzero((found >> 32 != key) & (found >= 0))
        while len(other):
            inside[other] = (inside[other] + 1) & mask
            at[other] = first[other] + inside[other]
            there = self.two[at[other]]
            found[other] = there
            other = other[(there >= 0) & (there >> 32 != key[other])]
        return at, found

    def predict(self, k: int) -> np.ndarray:
        """The edges of order 2, order 1, order 0 and new ids in the mixture of the first k lanes."""
        if self.step % FOLLOW == 0:
            np.cumsum(self.count, 1, out=self.edges[:, 1:])
        self.step += 1
        last, key = self.last[:k], self.before[:k] * self.width + self.last[:k]
        self.at1, (self.at2, found) = self.row[:k] + last, self._place(key)
        one, two = self.one[self.at1], np.where(found < 0, -1, found & 0xFFFFFFFF)
        self.key, self.c1, self.c2 = key << 32, one >> LEVEL_BITS, two >> LEVEL_BITS
        self.w1, self.w2, self.w0 = (self.level_row[:k] + x for x in (one & LEVELS - 1, two & LEVELS - 1, self.kind[:k]))
        self.one_was, self.two_was = one, two
        self.has2, self.has1, self.has0 = self.c2 >= 0, (self.c1 >= 0) & (self.c1 != self.c2), self.known[:k] > 0
        self.p2, self.p1, self.p0 = (self.weight[i][w] for i, w in enumerate((self.w2, self.w1, self.w0)))
        edges = np.zeros((5, k), np.int64)
        edges[4] = whole = 1 << SCALE
        edges[1] = (self.p2.astype(np.int64) << SCALE - 16) * self.has2
        edges[2] = edges[1] + ((whole - edges[1]) * self.p1 >> 16) * self.has1
        edges[3] = edges[2] + (1 + ((whole - 2 - edges[2]) * self.p0 >> 16)) * self.has0
        return edges

    def told(self, x: np.ndarray) -> np.ndarray:
        """Which prediction tells the ids: 0 for order 2, 1 for order 1, 2 for order 0, 3 for new ones."""
        k = len(x)
        return np.where(x == self.c2, 0, np.where(x == self.c1, 1, 2 + (x >= self.known[:k])))

    def counted(self, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, total) of known ids at these lanes by order 0."""
        row = self.edge_row[at]
        low = self.flat_edges[row + x]
        return low + x, self.flat_edges[row + x + 1] - low + 1, self.flat_edges[row + self.width] + self.known[at]

    def total(self, at: np.ndarray) -> np.ndarray:
        return self.flat_edges[self.edge_row[at] + self.width] + self.known[at]

    def find(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The known ids whose spans in order 0 hold the values."""
        row, low = self.edge_row[at], np.zeros(len(at), np.int64)
        most = self.known[at] - 1
        for b in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            x = low + (1 << b)
            np.minimum(x, most, out=x)
            ok = self.flat_edges[row + x] + x <= value
            low = np.where(ok, x, low)
        return low

    @staticmethod
    def _after(was: np.ndarray, guess: np.ndarray, x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """What stands for a context that x has followed: a guess that was right is surer, a sure one that was wrong less so, another gives way."""
        level = was & (LEVELS - 1)
        right, kept = guess == x, (level > 1) & (guess >= 0)
        return np.where(right, was + (level < LEVELS - 1), np.where(kept, was - level + (level >> 1), fresh))

    def learn(self, told: np.ndarray, x: np.ndarray) -> None:
        k = len(x)
        missed2, missed1 = told != 0, told > 1
        for weight, at, p, on, right in ((self.weight[0], self.w2, self.p2, self.has2, 0), (self.weight[1], self.w1, self.p1, self.has1 & missed2, 1), (self.weight[2], self.w0, self.p0, self.has0 & missed1, 2)):
            p += (_AIM[right][told] - p >> RATE) * on
            weight[at] = p
        fresh = x * LEVELS
        self.one[self.at1] = self._after(self.one_was, self.c1, x, fresh)
        self.two[self.at2] = self._after(self.two_was, self.c2, x, fresh) + self.key
        at = np.flatnonzero(missed1)
        self.flat_count[self.row[at] + x[at]] += GAIN
        self.known[:k] += told == 3
        self.before[:k], self.last[:k], self.kind[:k] = self.last[:k], x, told


class _Coder:
    """The state of the range coders of all lanes."""

    def __init__(self, n: int):
        self.low, self.span, self.used = np.zeros(n, _U), np.full(n, 2**64 - 1, _U), np.zeros(n, np.int64)

    def narrow(self, at, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lanes that are through with a word, their words)."""
        lo = self.low[at] + unit * start.astype(_U)
        sp = unit * size.astype(_U)
        self.low[at], self.span[at] = lo, sp
        small = np.flatnonzero(sp < _U(2**32))
        lo, sp = lo[small], sp[small]
        across = (lo >> _WORD) != ((lo + sp - _U(1)) >> _WORD)
        sp = np.where(across, _U(2**32) - (lo & _LOW), sp)
        lanes = small if isinstance(at, slice) else at[small]
        self.low[lanes], self.span[lanes] = lo << _WORD, sp << _WORD
        return lanes, (lo >> _WORD).astype(np.uint32)


def _steps(length: np.ndarray) -> list[int]:
    """How many lanes are at work at each step; no lane is longer than the one before it."""
    return np.searchsorted(-length, -np.arange(length.max(initial=0)), "left").tolist()


def _code(rows: np.ndarray, local: np.ndarray, length: np.ndarray, width: int, table: _Table) -> list[np.ndarray]:
    """The words of each row of ids; local: the same ids as numbered in each row."""
    n, grid, symbols = len(rows), np.ascontiguousarray(local.T), np.ascontiguousarray(rows.T)
    model, coder, live = _Model(n, width, rows.shape[1]), _Coder(n), _steps(length)
    words = np.zeros((n, 2 * len(live) + 2), np.uint32)  # a word at most for each of two parts of an id

    def put(lanes: np.ndarray, out: np.ndarray) -> None:
        words[lanes, coder.used[lanes]] = out
        coder.used[lanes] += 1

    for t, k in enumerate(live):
        x, edges = grid[t, :k], model.predict(k)
        told = model.told(x)
        start = edges[told, model.lane[:k]]
        put(*coder.narrow(slice(0, k), start, edges[told + 1, model.lane[:k]] - start, coder.span[:k] >> _U(SCALE)))
        at = np.flatnonzero(told > 1)
        start, size, total = model.counted(at, np.minimum(x[at], width - 1))
        new = told[at] == 3
        s = symbols[t, at[new]]
        start[new], size[new], total[new] = table.edge[s], table.edge[s + 1] - table.edge[s], table.total
        put(*coder.narrow(at, start, size, coder.span[at] // total.astype(_U)))
        model.learn(told, x)
    used, lane = coder.used, model.lane
    words[lane, used] = (coder.low >> _WORD).astype(np.uint32)
    words[lane, used + 1] = (coder.low & _LOW).astype(np.uint32)
    return [words[i, : used[i] + 2] for i in range(n)]


def _decoded(streams: list[np.ndarray], length: np.ndarray, width: int, table: _Table) -> np.ndarray:
    """The ids of each lane as a row."""
    n, live = len(streams), _steps(length)
    model, coder = _Model(n, width, len(live)), _Coder(n)
    words = np.zeros((n, max(map(len, streams)) + 3), np.uint32)
    for i, s in enumerate(streams):
        words[i, : len(s)] = s
    code = words[:, 0].astype(_U) << _WORD | words[:, 1].astype(_U)
    coder.used += 2
    grid, symbols = np.zeros((len(live), n), np.int32), np.zeros((n, width), np.int32)

    def get(lanes: np.ndarray, _) -> None:
        code[lanes] = code[lanes] << _WORD | words[lanes, np.minimum(coder.used[lanes], words.shape[1] - 1)].astype(_U)
        coder.used[lanes] += 1

    for t, k in enumerate(live):
        edges, unit = model.predict(k), coder.span[:k] >> _U(SCALE)
        value = np.minimum((code[:k] - coder.low[:k]) // unit, _U(2**SCALE - 1)).astype(np.int64)
        told = (value >= edges[1]).astype(np.int64) + (value >= edges[2]) + (value >= edges[3])
        start = edges[told, model.lane[:k]]
        get(*coder.narrow(slice(0, k), start, edges[told + 1, model.lane[:k]] - start, unit))
        x = np.where(told == 0, model.c2, model.c1)
        at = np.flatnonzero(told > 1)
        new = told[at] == 3
        total = np.where(new, table.total, model.total(at)).astype(_U)
        unit = coder.span[at] // total
        value = np.minimum((code[at] - coder.low[at]) // unit, total - _U(1)).astype(np.int64)
        old, first = at[~new], at[new]
        s, y = table.find(value[new]), model.find(old, value[~new])
        start, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        start[new], size[new] = table.edge[s], table.edge[s + 1] - table.edge[s]
        start[~new], size[~new], _ = model.counted(old, y)
        get(*coder.narrow(at, start, size, unit))
        model.known[first] = np.minimum(model.known[first], width - 1)  # more are in damaged blocks alone
        x[old], x[first] = y, model.known[first]
        symbols[first, model.known[first]] = s
        grid[t, :k] = x
        model.learn(told, x)
    return np.take_along_axis(symbols, grid.T, 1)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, number of each id)."""
    if ids.max() >= 1 << 20:
        alphabet, local = np.unique(ids, return_inverse=True)
        return alphabet, local.astype(np.int32)
    alphabet = np.flatnonzero(np.bincount(ids))
    number = np.zeros(alphabet[-1] + 1, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    return alphabet.astype(np.uint32), number[ids]


def _local(rows: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids numbered in each row as they come, distinct ids of each row, how often each id is new in a row)."""
    out, distinct, place, back = np.zeros(rows.shape, np.int32), np.zeros(len(rows), np.int64), np.zeros(size, np.int32), np.arange(rows.shape[1], dtype=np.int32)
    new_ids = []
    for row, m, numbers in zip(rows, length.tolist(), out, strict=True):
        row, at = row[:m], back[:m]
        place[row[::-1]] = at[::-1]  # the last one written is the first in the row
        first = place[row]
        new = first == at
        numbers[:m] = (np.cumsum(new, dtype=np.int32) - 1)[first]
        new_ids.append(row[new])
    distinct[:] = [len(x) for x in new_ids]
    return out, distinct, np.bincount(np.concatenate(new_ids), minlength=size)


def encode(ids: np.ndarray) -> bytes:
    """Blocks of SHORT to BLOCK ids each, the last one shorter; no ids give no bytes."""
    if not len(ids):
        return b""
    ids = ids.astype(np.uint32, copy=False)
    alphabet, number = _numbered(ids)
    block = min(BLOCK, max(SHORT, -(-len(ids) // LANES)), len(ids))
    n, lanes = -(-len(ids) // block), max(1, LANES * SHORT // block)
    rows = np.zeros((n, block), np.int32)
    rows.ravel()[: len(ids)] = number
    length = np.full(n, block)
    length[-1] = len(ids) - (n - 1) * block
    local, distinct, count = _local(rows, length, len(alphabet))
    share = _shares(count)
    table, heads, coded = _Table(share), np.zeros(n, _BLOCK), []
    for i in range(0, n, lanes):
        own = slice(i, i + lanes)
        words = _code(rows[own], local[own], length[own], int(distinct[own].max()), table)
        heads["words"][own] = list(map(len, words))
        coded += [w.astype("<u4", copy=False).tobytes() for w in words]
    heads["ids"], heads["distinct"] = length, distinct
    heads["crc"] = [zlib.crc32(ids[j * block : (j + 1) * block].astype("<u4", copy=False)) for j in range(n)]
    tables = zlib.compress(struct.pack("<I", len(alphabet)) + b"".join(x.astype("<u4").tobytes() for x in (np.diff(alphabet, prepend=np.uint32(0)), share)), 1)
    return b"".join([_HEAD.pack(n, len(tables)), tables, heads.tobytes(), *coded])


def decode(data: bytes) -> np.ndarray:
    """The ids; raises ValueError where a block's checksum does not hold."""
    if not data:
        return np.zeros(0, np.uint32)
    n, size = _HEAD.unpack_from(data)
    try:
        tables = np.frombuffer(zlib.decompress(data[_HEAD.size : _HEAD.size + size]), "<u4")
    except zlib.error as e:
        raise ValueError("the table is damaged") from e
    k = int(tables[0])
    alphabet, table = np.cumsum(tables[1 : k + 1], dtype=np.int64).astype(np.uint32), _Table(tables[k + 1 :].astype(np.int64))
    heads, at = np.frombuffer(data, _BLOCK, n, _HEAD.size + size), _HEAD.size + size + n * _BLOCK.itemsize
    words = np.frombuffer(data, "<u4", (len(data) - at) // 4, at)
    length, edge = heads["ids"].astype(np.int64), np.concatenate([[0], np.cumsum(heads["words"], dtype=np.int64)])
    if edge[-1] != len(words) or (np.diff(length) > 0).any() or not 0 < length[-1] <= length[0] <= BLOCK or (heads["distinct"] > length).any() or not heads["distinct"].all():
        raise ValueError("the blocks' heads are damaged")
    streams = [words[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    out, lanes = [], max(1, LANES * SHORT // int(length[0]))
    for i in range(0, n, lanes):
        own = slice(i, i + lanes)
        for row, m, crc in zip(alphabet[_decoded(streams[own], length[own], int(heads["distinct"][own].max()), table)], length[own].tolist(), heads["crc"][own].tolist(), strict=True):
            ids = row[:m]
            if zlib.crc32(np.ascontiguousarray(ids.astype("<u4", copy=False))) != crc:
                raise ValueError("a block's checksum does not hold")
            out.append(ids)
    return np.concatenate(out)
