"""Operator 13: repair of a conversation's turn structure by generalised LR parsing with edits.

The grammar over role initials is `conversation -> nothing | turns | s turns; turns -> pair | turns pair; pair -> u a`.
Its LR(0) tables are built once from these rules.  Each row is kept, given another role or deleted, and roles may be
inserted anywhere.  Every edit is tried at every stack top; the stacks share their lower part, and equal
tops are merged by the least (cost, audit).  What a row does to a top is parsed once for each symbol and top; rows then
step through these moves, so a long conversation costs no more a row than a short one.  The merge is exact: what may follow depends on the top alone (the states
after `u` go on alike whatever is below), and of two audits that have consumed the same rows at the same cost neither is the
beginning of the other, so the smaller stays the smaller whatever comes after.

A conversation may be longer than a task should hold.  Rows are range-sorted once and parsed in
chunks of a fixed number of rows.  A conversation inside one chunk is parsed at once; a piece that may go on in the
next chunk is parsed from every stack top it may begin with, and the pieces are composed in order.
The repaired text streams through one hash in order, so of a conversation's texts no task holds more than a batch.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

RULES = [("conversation", ()), ("conversation", ("turns",)), ("conversation", ("s", "turns")), ("turns", ("pair",)), ("turns", ("turns", "pair")), ("pair", ("u", "a"))]
CHUNK_BITS = 12  # rows of a chunk: 4096
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
GONE = "x"  # symbol of a row that has to be deleted
OTHER = "?"  # symbol of a row whose role the grammar doesn't have

# ---------------------------------------------------------------- tables


def _items(kernel: frozenset) -> frozenset:
    """Rules (number, dot) that a state may be in, with those that its next symbols bring."""
    out, todo = set(kernel), list(kernel)
    while todo:
        rule, dot = todo.pop()
        for k, (head, body) in enumerate(RULES):
            if dot < len(RULES[rule][1]) and RULES[rule][1][dot] == head and (k, 0) not in out:
                out.add((k, 0))
                todo.append((k, 0))
    return frozenset(out)


def _tables() -> tuple[dict, dict]:
    """(state, symbol) to the next state, and for each state the rules it may reduce by."""
    start = _items(frozenset((k, 0) for k, (head, _) in enumerate(RULES) if head == "conversation"))
    states, goto, k = [start], {}, 0
    while k < len(states):
        for symbol in sorted({RULES[r][1][d] for r, d in states[k] if d < len(RULES[r][1])}):
            to = _items(frozenset((r, d + 1) for r, d in states[k] if d < len(RULES[r][1]) and RULES[r][1][d] == symbol))
            if to not in states:
                states.append(to)
            goto[k, symbol] = states.index(to)
        k += 1
    return goto, {k: [RULES[r] for r, d in s if d == len(RULES[r][1])] for k, s in enumerate(states)}


GOTO, REDUCE = _tables()
ACCEPT = -1  # the state that a whole conversation leads to
GOTO[0, "conversation"], REDUCE[ACCEPT] = ACCEPT, []
ALIVE = sorted({s for s, symbol in GOTO if symbol in ("s", "u", "a")})  # tops that can read on


class Top:
    """A stack top: its state, the least (cost, audit) that leads to it, and the tops it stands on."""

    __slots__ = ("state", "best", "below")

    def __init__(self, state, best, below):
        self.state, self.best, self.below = state, best, below


def _put(tops: dict[int, Top], state: int, best: tuple, under: list[Top]) -> Top | None:
    """Adds a top or merges it with its equal; returns it where that changed something."""
    top = tops.get(state)
    if top is None:
        top = tops[state] = Top(state, best, list(under))
        return top
    new = [u for u in under if not any(u is b for b in top.below)]
    top.below += new
    if best < top.best:
        top.best = best
        return top
    return top if new else None


def _bases(top: Top, depth: int) -> list[Top]:
    level = [top]
    for _ in range(depth):
        level = list({id(b): b for t in level for b in t.below}.values())
    return level


def _settled(tops: dict[int, Top], insert: bool) -> dict[int, Top]:
    """All reductions, and with `insert` all insertions, until nothing changes."""
    todo = list(tops.values())
    while todo:
        top = todo.pop()
        after = [(GOTO[base.state, head], top.best, base) for head, body in REDUCE[top.state] for base in _bases(top, len(body)) if (base.state, head) in GOTO]
        if insert:
            cost, audit = top.best
            after += [(GOTO[top.state, s], (cost + INSERT, audit + "I"), top) for s in ROLES if (top.state, s) in GOTO]
        todo += [t for state, best, base in after if (t := _put(tops, state, best, [base])) is not None]
    return tops


def _entry(state: int) -> Top:
    """A top of that state on the shortest stack that leads to it."""
    paths, seen = [[0]], {0}
    while paths:
        path = paths.pop(0)
        if path[-1] == state:
            top = None
            for s in path:
                top = Top(s, (0, ""), [top] if top else [])
            return top
        for (s, _), to in sorted(GOTO.items(), key=str):
            if s == path[-1] and to not in seen:
                seen.add(to)
                paths.append([*path, to])
    raise ValueError(state)


def _read(c: str, entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) for each top that may be there after one row, begun at a top: insertions, then what is done with the row."""
    role, extra, after = (OTHER if c in "?!" else c.lower()), TRUNCATED * (c in "SUA!"), {}
    tops = _settled({entry: _entry(entry)}, True)
    for state in ALIVE:
        if (top := tops.get(state)) is None:
            continue
        cost, audit = top.best
        _put(after, state, (cost + DELETE, audit + "D"), top.below)
        if c == GONE:
            continue
        if (state, role) in GOTO:
            _put(after, GOTO[state, role], (cost + extra, audit + "K"), [top])
        for r in ROLES:
            if r != role and (state, r) in GOTO:
                _put(after, GOTO[state, r], (cost + REROLE + extra, audit + "R"), [top])
    return {s: t.best for s, t in _settled(after, False).items() if s in ALIVE}


@functools.cache
def _moves(c: str) -> dict[int, list[tuple[int, int, str]]]:
    """For each top, the tops that one row leads to: (top, cost, audit)."""
    return {entry: [(to, cost, audit) for to, (cost, audit) in _read(c, entry).items()] for entry in ALIVE}


@functools.lru_cache(1 << 14)
def _step(tops: tuple, c: str) -> tuple[tuple, int, tuple]:
    """(tops after a row, cost of the cheapest of them, for each the place of the one before and the row's part of the audit).

    A top is (state, cost above the cheapest, rank of its audit).  Parts end with what is done with a row, so no audit is the beginning
    of another one that has consumed the same rows, and the rank decides before the part.
    """
    best: dict[int, tuple] = {}
    for place, (state, cost, rank) in enumerate(tops):
        for to, more, part in _moves(c)[state]:
            key = (cost + more, rank, part, place)
            if to not in best or key < best[to]:
                best[to] = key
    least = min(k[0] for k in best.values())
    ranks = {k: i for i, k in enumerate(sorted({k[1:3] for k in best.values()}))}
    told = sorted(best.items())
    return tuple((s, k[0] - least, ranks[k[1:3]]) for s, k in told), least, tuple((k[3], k[2]) for _, k in told)


def parsed(symbols: str, entry: int = 0) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) for each top that may be there after these rows, begun at a top.

    A symbol is a role's initial, its capital where the row is truncated (? and ! for a role that the grammar lacks), or x for a
    row that has to go.  Each row is one step from a few tops to a few tops, so the time grows with the rows.
    """
    tops, spent, steps, out = ((entry, 0, 0),), 0, [], {}
    for c in symbols:
        tops, least, back = _step(tops, c)
        spent += least
        steps.append(back)
    for place, (state, cost, _) in enumerate(tops):
        parts = []
        for back in reversed(steps):
            place, part = back[place]  # noqa: PLW2901
            parts.append(part)
        out[state] = (spent + cost, "".join(reversed(parts)))
    return out


@functools.cache
def ending(entry: int) -> tuple[int, str]:
    """What it costs to end a conversation at a top, and the insertions that do it."""
    return _settled({entry: _entry(entry)}, True)[ACCEPT].best


def _ended(tops: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min((cost + ending(s)[0], audit + ending(s)[1]) for s, (cost, audit) in tops.items())


def repair(symbols: str) -> tuple[int, str]:
    """The cost and the audit (initials of keep, rerole, delete, insert) of the cheapest repair, ties by the least audit."""
    return _ended(parsed(symbols))


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's faults, decided by crc32 of conv_id:turn modulo 20: rows go, come twice, or change; nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    out = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_n"), fault.alias("_fault"))
    return out.where("_fault <> 0").select("conv_id", "turn", "role", "text", F.explode("_n").alias("_n")).drop("_n")


def _blank(text: str) -> Column:
    return F.rtrim(F.col(text), F.lit(BLANKS)) == ""


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in order, stored: pos orders all rows, by conversation, turn, role and text; chunk is pos without its last bits."""
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    slim = slim.withColumns({"digest": F.unhex(F.sha2("text", 256)), "blank": _blank("text"), "open_end": ~end.isin(".", "!", "?"), "_row": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "_row"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row").withColumn("pos", F.monotonically_increasing_id())
    return stored(ranged.withColumn("chunk", F.shiftright("pos", CHUNK_BITS)), "conversation-rows")


_PIECE = "conv_id long, chunk long, whole boolean, symbols int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, cost long, audit string, ways array<struct<entry:int,exit:int,cost:long,audit:string>>"
_PIECE_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("chunk", pa.int64()), ("whole", pa.bool_()), ("symbols", pa.int32()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("ways", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _piece(conv, chunk: int, rows: list[dict], whole: bool) -> dict:
    """Counts of a conversation's rows in a chunk, and its repair or, where it may begin or go on elsewhere, all ways through it."""
    out = {"conv_id": conv, "chunk": chunk, "whole": whole, "symbols": len(rows), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": rows[0]["initial"], "last": rows[-1]["initial"], "cost": 0, "audit": None, "ways": None}
    symbols = []
    for r in rows:
        fault = "blank" if r["blank"] else "duplicate" if not r["new"] else "truncated" if r["open_end"] else None
        if fault:
            out[fault] += 1
        c = r["initial"] if r["initial"] in ("s", "u", "a") else OTHER
        symbols.append(GONE if fault in ("blank", "duplicate") else c if not fault else {"s": "S", "u": "U", "a": "A", OTHER: "!"}[c])
    out["illegal"] = sum(_illegal(a["initial"], b["initial"]) for a, b in zip(rows, rows[1:], strict=False))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out |= {"low": turns[0], "high": turns[-1], "turns": len(set(turns))} if turns else {"low": None, "high": None, "turns": 0}
    if whole:
        out["cost"], out["audit"] = repair("".join(symbols))
    else:
        out["ways"] = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in ALIVE for x, (c, a) in parsed("".join(symbols), e).items()]
    return out


def _parse(batches):
    """Rows of chunks, in order of pos, each followed by a mark where it is the first of its role and text."""

    def pieces(chunk, rows):
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i]["conv_id"] != rows[i - 1]["conv_id"]), len(rows)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield _piece(rows[a]["conv_id"], chunk, rows[a:b], 0 < k < len(cuts) - 2)

    def chunks():
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["mark"]:
                    rows[-1]["new"] = True
                    continue
                if rows and rows[-1]["chunk"] != r["chunk"]:
                    yield from pieces(rows[0]["chunk"], rows)
                    rows = []
                rows.append(r | {"new": False})
        if rows:
            yield from pieces(rows[0]["chunk"], rows)

    yield from _batches(chunks(), _PIECE_ARROW)


def _batches(rows, schema: pa.Schema, most: int = 2000):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 1 + len(r.get("audit") or "") // 1000 + len(r.get("text") or "") // 1000 + 20 * len(r.get("ways") or ())
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _compose(batches):
    """Pieces of a conversation, in order, to the same pieces with the part of the best audit that is theirs."""

    def conversations():
        rows, tops, on = [], {}, False
        for batch in batches:
            for r in batch.to_pylist():
                if not on or r["conv_id"] != rows[-1]["conv_id"]:
                    yield from done(rows, tops)
                    rows, tops, on = [], {0: (0, 0, None)}, True
                # a top: cost, rank of its audit among the tops, and the chain of its parts
                best: dict[int, tuple] = {}
                for w in r.pop("ways"):
                    if w["entry"] in tops:
                        cost, rank, chain = tops[w["entry"]]
                        key = (cost + w["cost"], rank, w["audit"], w["entry"])
                        if w["exit"] not in best or key[:3] < best[w["exit"]][:3]:
                            best[w["exit"]] = key
                ranks = {k: i for i, k in enumerate(sorted({b[1:3] for b in best.values()}))}
                tops = {x: (b[0], ranks[b[1:3]], (tops[b[3]][2], b[2])) for x, b in best.items()}
                rows.append(r)
        yield from done(rows, tops)

    def done(rows, tops):
        if not rows:
            return
        cost, _, tail, state = min((c + ending(s)[0], rank, ending(s)[1], s) for s, (c, rank, _) in tops.items())
        chain, parts = tops[state][2], []
        while chain is not None:
            chain, part = chain
            parts.append(part)
        for k, (r, part) in enumerate(zip(rows, reversed(parts), strict=True)):
            last = k == len(rows) - 1
            yield r | {"cost": cost if last else 0, "audit": part + tail if last else part, "ways": None}

    yield from _batches(conversations(), _PIECE_ARROW)


def _edited(batches):
    """(piece or None, action, role, text) in order: each piece before the edits of its rows; conversations follow one another."""
    actions, need = iter(()), "user"
    conv, begun = None, False

    def said(role):
        return "assistant" if role[:1] == "u" else "user"

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                for _ in actions:  # insertions at the end of the piece before
                    yield None, "I", need, ""
                    need = said(need)
                if not begun or r["conv_id"] != conv:
                    conv, begun, need = r["conv_id"], True, "user"
                actions = iter(r["audit"])
                yield r, None, None, None
                continue
            for a in actions:
                role = r["role"] if a in "KD" else need
                yield None, a, role, "" if a == "I" else r["text"]
                need = need if a == "D" else said(role)
                if a != "I":
                    break
    for _ in actions:
        yield None, "I", need, ""
        need = said(need)


_REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ROWS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("action", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _report(batches):
    def conversations():
        now, sha, parts, before = None, None, [], None

        def whole():
            return {"conv_id": now["conv_id"], "gaps": 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"], **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(parts), "repaired_sha256": sha.hexdigest()}

        for piece, action, role, text in _edited(batches):
            if piece is None:
                if action != "D":
                    sha.update(("\n" * (said > 0) + f"{role}:{text}").encode())
                    said += 1
                continue
            if now is None or piece["conv_id"] != now["conv_id"]:
                if now:
                    yield whole()
                now, sha, parts, said = piece, hashlib.sha256(), [piece["audit"]], 0
            else:
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += piece[c]
                now["illegal"] += _illegal(before["last"], piece["first"])
                now["turns"] += piece["turns"] - (piece["low"] is not None and piece["low"] == now["high"])
                now["low"], now["high"] = now["low"] if now["low"] is not None else piece["low"], piece["high"] if piece["high"] is not None else now["high"]
                parts.append(piece["audit"])
            before = piece
        if now:
            yield whole()

    yield from _batches(conversations(), _REPORT)


def _rows(batches):
    def edits():
        conv, place = None, 0
        for piece, action, role, text in _edited(batches):
            if piece is not None:
                place = place if piece["conv_id"] == conv and place else 0
                conv = piece["conv_id"]
                continue
            yield {"conv_id": conv, "place": place, "action": action, "role": role, "text": text}
            place += 1

    yield from _batches(edits(), _ROWS)


def _streamed(rows: DataFrame, run, schema: str) -> DataFrame:
    """The pieces and their rows, conversation by conversation, through `run`."""
    placed = _placed(rows)
    first = placed.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos"))
    slim = placed.select("chunk", "pos", F.lit(False).alias("mark"), "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "open_end")
    marks = first.select(F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", F.lit(True).alias("mark"), *(F.lit(None).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("initial", "string"), ("blank", "boolean"), ("open_end", "boolean"))))
    pieces = stored(slim.unionByName(marks).repartition("chunk").sortWithinPartitions("pos", "mark").mapInArrow(_parse, _PIECE), "conversation-pieces")
    open_ones = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_compose, _PIECE)
    known = pieces.where("whole").unionByName(open_ones).select("conv_id", "chunk", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("pos"), "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "cost", "audit")
    texts = placed.select("conv_id", "chunk", F.lit(1).alias("kind"), "pos", "role", "text")
    return known.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "kind", "pos").mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """Every row of the repaired conversations and every row deleted: conv_id, place (from 0), action (K, R, D or I), role, text.

    rows needs conv_id, turn, role and text; other columns are ignored.  Rows stand by turn (nulls first), then role, then a hash of the text;
    repeated rows follow one another, all but the first as duplicates.  A null role or text is one space; null ids are one conversation.
    Empty and blank texts are deleted.  Roles are told by their first letter; one that is none of s, u, a can only be deleted or replaced.
    An empty table gives no rows.
    """
    return _streamed(rows, _rows, "conv_id long, place long, action string, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `rows`: its faults, the cheapest repair's cost and audit, and the hash of what it leaves.
    Rows are treated as by `repaired`."""
    return _streamed(rows, _report, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def with_lost(found: DataFrame, original: DataFrame) -> DataFrame:
    """`report` with a row for each conversation of the original rows, also for those that have lost all rows."""
    every = original.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    out = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
