"""Operator 1: n-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct five-word shingles.  Sets are put into size bands
[l, l / threshold]; two sets that are similar enough are in one band or in neighbouring
ones, and differ in at most k = (1 - t) / (1 + t) * 2 * r elements, r the upper end of the
larger set's band.  For a band the shingle domain is cut into n1 > k / 2 partitions of
three parts each.  By the pigeonhole principle one partition holds at most one differing
element, so two of its three parts agree, and the signature of these two parts is shared:
each set has signatures for every subset of two parts, for its own band and the next one.

Shingles of passages that many documents share would put all of these into one run.  Leaving some elements out
of the domain keeps the guarantee, so popular shingles are left out first.

Subsets of parts that are empty in a set would collide for all sets.  With z spare
partitions, a set that has at most z partitions with an empty subset needs no signature
for them.  Other sets, such as short ones, have their rare shingles as partitions of one part as well, and those that
are mostly popular shingles have signatures over the whole domain.  So no link is lost.

Signatures travel packed, dealt by their high bits, with 32 more bits; that some runs meet by chance
adds pairs that the bound and the texts turn down.  Runs are then dealt by their leaders.  A run of one signature first gives pairs
of a leader with the others; pairs survive an exact bound (parity sketches: the
number of differing bits can't exceed the difference of the sets) and are verified on the
texts.  Runs that still hold several components, the leader's among them, then have all their pairs between
components compared by the same bound and verified on the texts within one task; in large runs only sets outside the largest component
are compared with the others.  Only links that join two components leave the task, so their number is below that of the sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, dropped, mix, shingles, slices, stored
from .components import components

BUCKET_SIGNATURES = 3_000_000
DEAL_ROWS = 500_000
DEAL_SHINGLES = 4_000_000  # of the sets whose texts meet in one task
CROWD = 64
PAIR = "a long, b long"
LEADERS = 2
FIRST = 3
SETS = "doc_id long, mark long, n_shingles long, node long, more long, sketch binary, often array<struct<f: long, n: long>>"
POPULAR = 0.0005  # share of the documents that makes a shingle a popular one
PACKED = "bucket int, sigs binary, nodes binary, times binary"


class Bands:
    """Size bands for a similarity of at least ``percent`` / 100, and each band's partitions."""

    def __init__(self, largest: int, percent: int):
        lows, n1, spare = [], [], []
        low = 1
        while low <= max(2, largest) * 2:
            high = low * 100 // percent
            k = 2 * high * (100 - percent) // (100 + percent)
            base = k // 2 + 1
            mean = base * 3 * np.exp(-2 / 3 * 0.9 * low / base)
            z = int(np.ceil(1.2 * mean + 2 * np.sqrt(mean))) if base >= 16 else 0
            lows.append(low)
            n1.append(base + z)
            spare.append(z)
            low = high + 1
        self.lows, self.n1, self.spare = map(np.array, (lows, n1, spare))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1


def set_ids(f: np.ndarray, sizes: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """An id of each set, of so many bits, and 32 more bits that tell apart sets whose ids are equal by chance; both are sums of
    the set's mixed elements."""
    end, out = np.cumsum(sizes), []
    for salt in (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)):
        total = np.zeros(len(f) + 1, U64)
        np.cumsum(mix(f ^ salt), out=total[1:])
        out.append(mix(total[end] - total[end - sizes] + sizes.astype(U64)))
    return out[0] >> U64(64 - bits), out[1] >> U64(32)


def told_apart(ids: np.ndarray, more: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The ids, those in shared with the further bits of their sets taken in."""
    return np.where(np.isin(ids, shared), ids ^ more << U64(31), ids)


def sketches(f: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity of the elements in each of 2^m >= size hash bins (64 at least).  Folding halves by exclusive or gives the shorter sketches."""
    bits = 2 ** np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(base[:-1], sizes) + (mix(f + U64(77)) & np.repeat(bits - 1, sizes).astype(U64)).astype(np.int64)
    odd = (np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[base[i] // 8 : base[i + 1] // 8] for i in range(len(sizes))]


def _scheme(f: np.ndarray, owner_of: np.ndarray, sizes: np.ndarray, bands: Bands, salt0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures over the elements f of the sets owner_of, banded by the sets' whole sizes: (signature, set, whether its
    set has more partitions with an empty subset than are spare, whether the subset is empty)."""
    out = []
    for step in (0, 1):
        band = bands.of(sizes) + step
        n1 = bands.n1[band]
        base = np.concatenate([[0], np.cumsum(3 * n1)])
        x = mix(f ^ U64(0xA5A5A5A5A5A5A5A5))
        part = ((x >> U64(32)) * n1[owner_of].astype(U64) >> U64(32)).astype(np.int64)
        third = ((x & U64(0xFFFFFFFF)) * U64(3) >> U64(32)).astype(np.int64)
        at = base[owner_of] + 3 * part + third
        v = mix(f ^ U64(0x5851F42D4C957F2D))
        total = np.bincount(at, (v & U64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(U64)
        total += np.bincount(at, (v >> U64(32)).astype(np.float64), base[-1]).astype(U64) << U64(32)
        total, have = total.reshape(-1, 3), np.bincount(at, minlength=base[-1]).reshape(-1, 3)
        sums, empty = total.sum(1, keepdims=True) - total, have.sum(1, keepdims=True) == have
        owner = np.repeat(np.arange(len(sizes)), n1)
        number = np.arange(len(owner)) - np.repeat(base[:-1] // 3, n1)
        short = (np.bincount(owner, empty.any(1), len(sizes)) > bands.spare[band])[owner]
        salt = (band[owner].astype(U64) << U64(40)) + (number.astype(U64) << U64(2)) + (U64(salt0) << U64(60))
        sig = mix(mix(salt[:, None] + np.arange(3, dtype=U64)) + sums)
        wide = lambda c: np.broadcast_to(c[:, None], sig.shape).ravel()
        out.append((sig.ravel(), wide(owner), wide(short), empty.ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def signatures(f: np.ndarray, sizes: np.ndarray, bands: Bands, popular: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) for the sets' own bands and the next ones.

    First without the popular elements: sets that differ in at most k elements differ in at most k of the others too.  A
    pair is found so if the spare partitions cover the empty subsets of one of the two.  Where they cover those of neither, two more
    partitionings serve.  A set may lack at most |A| - ceil(percent * |A| / 100) elements in a similar one; a set with more rare
    elements than that shares one of them, so each rare element is a partition of its own.  If neither has so many, both are
    mostly popular elements and have the signatures over the whole domain, with the empty ones where the spare partitions
    don't cover even these.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.searchsorted(popular, f)
    rare = popular[np.minimum(at, len(popular) - 1)] != f if len(popular) else np.ones(len(f), bool)
    sig, who, short, empty = _scheme(f[rare], owner[rare], sizes, bands, 0)
    out, names = [sig[~empty]], [who[~empty]]
    again = np.zeros(len(sizes), bool)
    again[who[short]] = True
    if again.any():
        one = rare & again[owner]
        out.append(mix(f[one] ^ U64(0x3C6EF372FE94F82B)))
        names.append(owner[one])
        again &= np.bincount(owner[rare], minlength=len(sizes)) <= sizes - -(-percent * sizes // 100)
    if again.any():
        k = np.flatnonzero(again)
        number = np.cumsum(again) - 1
        mine = again[owner]
        sig, who, short, empty = _scheme(f[mine], number[owner[mine]], sizes[k], bands, 1)
        keep = ~empty | short
        out.append(sig[keep])
        names.append(k[who[keep]])
    return np.concatenate(out), np.concatenate(names)


def _sets(width: int, id_bits: int):
    """A row a document, and one a batch with the shingles that came often in it."""
    kinds = [("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("more", pa.int64()), ("sketch", pa.binary()), ("often", pa.list_(pa.struct([("f", pa.int64()), ("n", pa.int64())])))]

    def made(*columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

    def run(batches):
        for batch in batches:
            held = []
            for part in slices(batch, "text"):
                f, _, sizes = shingles(part.column(1), width)
                held.append(f)
                ids, more = set_ids(f, sizes, id_bits)
                yield made(part.column(0), part.column(2), sizes, ids.view(np.int64), more.view(np.int64), sketches(f, sizes), [None] * part.num_rows)
            seen, n = np.unique(np.concatenate(held or [np.zeros(0, U64)]), return_counts=True)
            often = n >= max(3, POPULAR / 2 * batch.num_rows)  # a popular shingle is so in many batches
            if often.any():
                yield made([None], [None], [0], [0], [0], [b""], [[{"f": int(a), "n": int(b)} for a, b in zip(seen[often].view(np.int64), n[often], strict=True)]])

    return run


def _signed(width: int, percent: int, largest: int, bits: int, popular, id_bits: int, shared: np.ndarray):
    def run(batches):
        bands = Bands(largest, percent)
        for batch in batches:
            for part in slices(batch, "text"):
                f, d, sizes = shingles(part.column(1), width)
                ids = told_apart(*set_ids(f, sizes, id_bits), shared)
                one = np.zeros(len(ids), bool)
                one[np.unique(ids, return_index=True)[1]] = True
                one &= sizes > 0
                if not one.any():
                    continue
                sig, who = signatures(f[one[d]], sizes[one], bands, popular.value, percent)
                order = np.lexsort((who, sig >> U64(64 - bits)))
                sig, who = sig[order], who[order]
                rest = (sig << U64(bits) >> U64(32)).astype(np.uint32)
                cut = np.searchsorted(sig >> U64(64 - bits), np.arange(2**bits + 1, dtype=U64))
                full = np.flatnonzero(np.diff(cut))
                new = np.ones(len(who), bool)  # a set's signatures of one bucket lie together
                new[1:] = who[1:] != who[:-1]
                new[cut[full]] = True
                at = np.flatnonzero(new)
                node, times, edge = ids[one][who[at]], np.diff(at, append=len(who)).astype(np.uint32), np.searchsorted(at, cut)
                packed = [[x[e[b] : e[b + 1]].tobytes() for b in full] for x, e in ((rest, cut), (node, edge), (times, edge))]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], ["bucket", "sigs", "nodes", "times"])

    return run


def _runs(key, table):
    """Signatures that several sets of a bucket share: (sig, leader, node) for all but the leader.

    Leaders come first in one of LEADERS random orders, so a large group of near copies is compared with several of its members."""
    joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    sig = joined("sigs", np.uint32)
    node = np.repeat(joined("nodes", np.int64), joined("times", np.uint32))
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    same = np.zeros(len(sig) + 1, bool)
    same[1:-1] = sig[1:] == sig[:-1]
    some = same[1:] | same[:-1]
    sig, node = sig[some], node[some]
    turn = mix(node.view(U64) + (sig.astype(U64) & U64(LEADERS - 1)) * U64(0x632BE59BD9B4E019))
    order = np.lexsort((turn, sig))  # equal sets lie together
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    leader = node[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))] if len(sig) else node
    keep = np.ones(len(sig), bool)
    keep[1:] = new[1:] | (node[1:] != node[:-1])
    keep &= node != leader
    sig, leader, node = sig[keep], leader[keep], node[keep]
    if len(sig):  # of a bucket's runs of the same sets one is enough
        edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(edge, append=len(sig))
        made = mix(np.add.reduceat(mix(node.view(U64)), edge) + size.astype(U64)) + leader[edge].view(U64)
        once = np.zeros(len(edge), bool)
        once[np.unique(made, return_index=True)[1]] = True
        keep = np.repeat(once, size)
        sig, leader, node = sig[keep], leader[keep], node[keep]
    run = (U64(key[0].as_py()) << U64(32)) | sig.astype(U64)
    return pa.table({"sig": run.view(np.int64), "leader": leader, "node": node})


class _Sketches:
    """Sketches of some sets, as rows of 64-bit words for each width."""

    def __init__(self, sketches: list[bytes]):
        self.width = np.array([len(s) for s in sketches], np.int64)
        self.row = np.zeros(len(sketches), np.int64)
        self.rows = {}
        for w in np.unique(self.width).tolist():
            k = np.flatnonzero(self.width == w)
            self.row[k] = np.arange(len(k))
            self.rows[w] = np.frombuffer(b"".join(sketches[i] for i in k), U64).reshape(len(k), w // 8)

    def folded(self, k: np.ndarray, w: int, n: int) -> np.ndarray:
        """Words of sets of width w, folded to width n."""
        x = self.rows[w][self.row[k]]
        return np.bitwise_xor.reduce(x.reshape(len(k), w // n, n // 8), 1) if w > n else x

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of pairs, the longer sketch folded to the shorter's length."""
        out = np.empty(len(a), np.int64)
        wa, wb = self.width[a], self.width[b]
        for key in np.unique(wa * (1 << 32) + wb).tolist():
            x, y = key >> 32, key & ((1 << 32) - 1)
            n = min(x, y)
            k = np.flatnonzero((wa == x) & (wb == y))
            most = max(1, (1 << 22) // max(x, y))
            for i in range(0, len(k), most):
                part = k[i : i + most]
                out[part] = np.bitwise_count(self.folded(a[part], x, n) ^ self.folded(b[part], y, n)).sum(1, dtype=np.int64)
        return out


def _may_link(na, nb, differ, percent: int):
    """Whether sets of these sizes that differ in at least so many elements can reach the threshold."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * differ <= (100 - percent) * (na + nb))


def _verified(width: int, percent: int):
    def run(batches):
        for batch in batches:
            for t in slices(batch, "ta", 2 << 20):
                fa, da, na = shingles(t.column("ta"), width)
                fb, db, nb = shingles(t.column("tb"), width)
                f, d = np.concatenate([fa, fb]), np.concatenate([da, db])
                order = np.lexsort((f, d))
                f, d = f[order], d[order]
                both = np.bincount(d[1:][(f[1:] == f[:-1]) & (d[1:] == d[:-1])], minlength=len(na))
                yield t.filter(pa.array((both > 0) & (100 * both >= percent * (na + nb - both)))).select(["a", "b"])

    return run


def _led(percent: int):
    """Pairs of a leader with its nodes that the bound allows.  Gets the rows of one deal and, once each, the nodes in them."""

    def run(key, rows, nodes):
        nodes = nodes.take(pa.array(np.argsort(nodes.column("node").to_numpy())))
        node, n = nodes.column("node").to_numpy(), nodes.column("n").to_numpy()
        a, b = (np.searchsorted(node, rows.column(c).to_numpy()) for c in ("leader", "node"))
        ok = _may_link(n[a], n[b], 0, percent)
        a, b = a[ok], b[ok]
        ok = _may_link(n[a], n[b], _Sketches(nodes.column("sketch").to_pylist()).differ(a, b), percent)
        return pa.table({"a": node[np.minimum(a, b)[ok]], "b": node[np.maximum(a, b)[ok]]})

    return run


def _apart(width: int, percent: int, look: bool):
    """Compares sets of one run whose components differ.  Gets the runs of one deal and, once each, the nodes in them.

    With look, gives the nodes that have a pair the bound allows, so only their texts need to come.  Else gets these with their
    texts and gives links.  A link is given only where it joins two components that no link found before has joined, so
    there are fewer links than nodes, however many pairs a run has.
    """

    def run(key, runs, nodes):
        order = np.argsort(nodes.column("node").to_numpy())
        nodes = nodes.take(pa.array(order))
        node, n = (nodes.column(c).to_numpy() for c in ("node", "n"))
        comp = np.unique(nodes.column("comp").to_numpy(), return_inverse=True)[1]
        text, sets, out = None if look else nodes.column("text"), {}, []
        wanted = np.zeros(len(node), bool)
        sketches = _Sketches(nodes.column("sketch").to_pylist())
        top = np.arange(len(node))  # of components

        def find(c):
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        def now():
            """Component of each node after the links found so far."""
            while (top[top] != top).any():
                top[:] = top[top]
            return top[comp]

        def load(which):
            new = np.array([x for x in which.tolist() if x not in sets], np.int64)
            texts = pa.table({"at": new, "text": text.take(pa.array(new))}).combine_chunks().to_batches() if len(new) else []
            for batch in texts:
                for part in slices(batch, "text"):
                    f, _, sizes = shingles(part.column(1), width)
                    sets.update(zip(part.column(0).to_pylist(), np.split(f, np.cumsum(sizes)[:-1]), strict=True))

        def verify(a, b, differ):
            """Pairs that the bound allows, the most similar ones first."""
            if look:
                wanted[a] = wanted[b] = True
                return
            load(np.unique(np.concatenate([a, b])))
            order = np.argsort(differ, kind="stable")
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                cx, cy = find(comp[x]), find(comp[y])
                if cx == cy:
                    continue
                fx, fy = (sets[x], sets[y]) if n[x] <= n[y] else (sets[y], sets[x])
                both = int((fy[np.minimum(np.searchsorted(fy, fx), len(fy) - 1)] == fx).sum())
                if 100 * both >= percent * (len(fx) + len(fy) - both):
                    top[max(cx, cy)] = min(cx, cy)
                    out.append((node[x], node[y]))

        held, waiting = [], 0

        def settle():
            nonlocal waiting
            pairs = np.unique(np.concatenate(held))
            held.clear()
            waiting = 0
            a, b = pairs // len(node), pairs % len(node)
            of = now()
            ok = (of[a] != of[b]) & _may_link(n[a], n[b], 0, percent)
            a, b = a[ok], b[ok]
            differ = sketches.differ(a, b)
            ok = _may_link(n[a], n[b], differ, percent)
            verify(a[ok], b[ok], differ[ok])

        def take(a, b):
            nonlocal waiting
            ok = comp[a] != comp[b]
            held.append(np.minimum(a[ok], b[ok]) * len(node) + np.maximum(a[ok], b[ok]))
            waiting += int(ok.sum())
            if waiting > 500_000:
                settle()

        def crowd(all_):
            """A large run: those outside its largest component against all, as a matrix of words."""
            kinds, which, n_of = np.unique(now()[all_], return_inverse=True, return_counts=True)
            rest = all_[which != n_of.argmax()]
            for x in np.unique(sketches.width[rest]).tolist():
                a = rest[sketches.width[rest] == x]
                for y in np.unique(sketches.width[all_]).tolist():
                    b, w = all_[sketches.width[all_] == y], min(x, y)
                    right = sketches.folded(b, y, w)
                    most = max(1, (1 << 19) // max(1, right.size))
                    for k in range(0, len(a), most):
                        part, of = a[k : k + most], now()
                        differ = np.bitwise_count(sketches.folded(part, x, w)[:, None] ^ right[None]).sum(2, dtype=np.int64)
                        i, j = np.nonzero(_may_link(n[part][:, None], n[b][None], differ, percent) & (of[part][:, None] != of[b][None]))
                        if len(i):
                            verify(part[i], b[j], differ[i, j])

        sig, first = np.unique(runs.column("sig").to_numpy(), return_index=True)
        sig = np.concatenate([runs.column("sig").to_numpy(), sig])  # a run's leader is one of its sets
        of = np.concatenate([runs.column("node").to_numpy(), runs.column("leader").to_numpy()[first]])
        here = np.isin(of, node)
        sig, at = sig[here], np.searchsorted(node, of[here])
        order = np.lexsort((at, sig))
        sig, at = sig[order], at[order]
        edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, np.int64)
        start, size = edge[:-1], np.diff(edge)
        if len(start):
            # of runs of the same sets one is enough
            mark = np.add.reduceat(mix(node[at].view(U64)), start)
            once = np.zeros(len(size), bool)
            once[np.unique(mark + size.astype(U64), return_index=True)[1]] = True
            start, size = start[once], size[once]
        for m in np.unique(size[size <= CROWD]):
            starts = start[size == m]
            i, j = np.triu_indices(m, 1)
            most = max(1, 200_000 // max(1, len(i)))
            for k in range(0, len(starts), most):
                s = starts[k : k + most][:, None]
                take(at[s + i].ravel(), at[s + j].ravel())
        if held:
            settle()
        for s, m in zip(start[size > CROWD], size[size > CROWD], strict=True):
            crowd(at[s : s + m])
        if look:
            return pa.table({"deal": pa.array([key[0].as_py()] * int(wanted.sum()), pa.int64()), "node": node[wanted]})
        return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(y) for _, y in out], pa.int64())})

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, id_bits: int = 64) -> DataFrame:
    """Links texts whose shingle sets have a Jaccard similarity of at least percent / 100.

    docs needs doc_id (integer) and text; other columns are ignored.  Returns for every row:
    doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).
    Null and blank texts have no shingles and their own id as component.  Rows with a null
    doc_id link others but name no component.  Repeated rows are returned as often as they
    come.  An empty table gives an empty result.

    A set has an id of id_bits bits.  Ids that several sets have by chance (three of 64 bits are to be expected among 10^10
    sets) are found and lengthened, so these sets stay apart.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("mark", F.xxhash64("text"))
    both = stored(docs.mapInArrow(_sets(width, id_bits), SETS), "sets")
    sets = both.where("often is null").drop("often")
    source = F.min(F.struct("doc_id", "mark")).alias("source")  # one row that has the set
    further = (F.min("more").alias("more"), F.max("more").alias("most"))
    known_by = lambda of: stored(of.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), source, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), *further), "nodes")
    nodes = known_by(sets)
    shared = [r.node for r in nodes.where("more <> most").select("node").collect()]  # about (number of sets)^2 / 2^65
    if shared:
        dropped(nodes)
        sets = sets.withColumn("node", F.when(F.col("node").isin(shared), F.col("node").bitwiseXOR(F.shiftleft("more", 31))).otherwise(F.col("node")))
        nodes = known_by(sets)
    total, largest = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    # at most (shingles of a document on average) / POPULAR of them can be popular, whatever the number of documents
    often = both.where("often is not null").select(F.inline("often")).groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(POPULAR * sets.count())).select("f")
    popular = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.f for r in often.collect()], np.int64).view(U64)))
    bits = max(3, int(np.ceil(np.log2(max(1, 1.3 * total / BUCKET_SIGNATURES)))))
    runs = stored(docs.mapInArrow(_signed(width, percent, largest, bits, popular, id_bits, np.array(shared, np.int64).view(U64)), PACKED).groupBy("bucket").applyInArrow(_runs, "sig long, leader long, node long"), "runs", release=True)


    def ends(rows: DataFrame, *by: str) -> DataFrame:
        """Each node of the rows once, leaders among them; columns of their own, so that the rows can be cogrouped with them."""
        part = lambda c: rows.select(*(F.col(x).alias(x) for x in by), F.col(c).alias("node"))
        return part("node").union(part("leader")).distinct()

    # texts come by their rows, not by an id that may be null or stand for several texts
    sources = nodes.join(ends(runs), "node").select("node", F.col("source.doc_id").alias("_id"), F.col("source.mark").alias("_mark"))
    rows = docs.join(sources, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["mark"] == F.col("_mark")))
    texts = stored(rows.select("node", "text").dropDuplicates(["node"]), "texts", release=True)

    # first a set's pairs with FIRST of its leaders, one order of leaders for all sets: at most FIRST pairs a set
    ordered = F.array_sort(F.collect_set(F.struct(F.xxhash64("leader").alias("turn"), "leader")))
    led = runs.groupBy("node").agg(F.slice(ordered, 1, FIRST).alias("l")).select("node", F.explode("l.leader").alias("leader"))
    deals = max(8, -(-runs.count() // DEAL_ROWS))
    led = stored(led.select(F.pmod(F.xxhash64("node"), F.lit(deals)).alias("deal"), "leader", "node"), "led")
    near = led.groupBy("deal").cogroup(ends(led, "deal").join(nodes.select("node", "n", "sketch"), "node").groupBy("deal")).applyInArrow(_led(percent), PAIR)
    near = stored(near.distinct(), "near", release=True)
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    first = stored(near.join(text("a"), "a").join(text("b"), "b").mapInArrow(_verified(width, percent), PAIR), "links", release=True)
    dropped(led)
    dropped(near)
    comp = stored(components(first), "comp")

    # then all sets of the runs that still hold several components, whatever the first step took
    labels = nodes.select("node", "n", "sketch").join(comp, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    seen = runs.join(labels.drop("sketch"), "node")
    split = seen.groupBy("sig", "leader").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    split = split.join(labels.select(F.col("node").alias("leader"), F.col("comp").alias("own")), "leader").where("low <> high or low <> own")
    rest = stored(seen.join(split.select("sig"), "sig", "left_semi").select("sig", "leader", "node", "n"), "rest", release=True)
    dropped(runs)
    deals = max(8, -(-rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // DEAL_SHINGLES))
    # a leader's runs meet in one deal, so a pair that many of them hold comes once; only the few with very many rows are split
    large = rest.groupBy("leader").agg(F.ceil(F.sum("n") / DEAL_SHINGLES).alias("cuts")).where("cuts > 1")  # fewer than deals
    cut = F.pmod("sig", F.coalesce("cuts", F.lit(1)))
    dealt = rest.join(F.broadcast(large), "leader", "left").select("sig", "leader", "node", F.pmod(F.xxhash64("leader", cut), F.lit(deals)).alias("deal"))
    looked = dealt.groupBy("deal").cogroup(ends(dealt, "deal").join(labels, "node").groupBy("deal")).applyInArrow(_apart(width, percent, True), "deal long, node long")
    looked = stored(looked, "looked", release=True)
    inside = looked.join(labels, "node").join(texts, "node").groupBy("deal")
    across = dealt.groupBy("deal").cogroup(inside).applyInArrow(_apart(width, percent, False), PAIR)
    edges = stored(first.union(across), "edges", release=True)
    for step in (rest, looked, texts, first, comp):
        dropped(step)
    last = components(edges)
    dropped(edges)
    named = nodes.select("node", "rep").join(last, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(low, "label").select("node", "component_id")
    return sets.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
