"""Operator 11: secret scans through nested encodings.

Each text is the first layer of a worklist.  A layer is scanned by the three rules, then unwrapped: its URL and Unicode escapes
give one layer of the whole text, each base64 run that decodes to text gives one, and each compressed stream gives one.  New
layers go back on the list until nothing is left to unwrap; a layer that has been seen with the same place in the
document is not taken twice, so streams that unpack to themselves end.  Every character of a layer knows the code points
of the document that it came from, so a find in any layer is reported as a span of the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

KINDS = ("assign", "access", "hex")
# The three rules.  A match of `assign` needs 6 characters in group 2, `access` 20 in all, `hex` 24 in all.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run holds no longer one, so dropping it later is the same
HEX = re.compile(r"[0-9a-f]{24,}")

_HEX = "[0-9A-Fa-f]"
ESCAPE = re.compile(rf"(?:%{_HEX}{{2}})+|\\u\{{{_HEX}{{1,6}}\}}|\\u{_HEX}{{4}}|\\U{_HEX}{{8}}|\\x{_HEX}{{2}}|&#[0-9]{{1,7}};|&#[xX]{_HEX}{{1,6}};|[！-～]")
ESCAPE_LONGEST = 10  # characters of one escape
SINGLE_LEVELS = 16  # escapes within escapes that are rescanned level by level; deeper ones are resolved at once
#: Least base64 characters: 16 of them hold the 12 of the shortest find ("token=" and 6 characters).
BASE64 = (re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,}+\r?\n)++[A-Za-z0-9+/]++={0,2}"), re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
STREAM = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0E-\x1F\x7F]")
_BREAK = re.compile(rb"[^A-Za-z0-9+/_.=:\"' %\\&#;{}-]")
PIECE = 4 << 20  # bytes of an unpacked stream that make one layer; cut at a line's end or another byte that no find can hold


class Layer(NamedTuple):
    """Text, the first and end code point of the document for each of its characters, and how it was reached."""

    text: str
    low: np.ndarray
    high: np.ndarray
    path: tuple[str, ...]


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every find of the three rules, leftmost and without overlap within a kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return out + [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]


# ---------------------------------------------------------------- unwrapping


def _unescaped(unit: str) -> tuple[str, int]:
    """The text of one escape, and how many characters of it each escaped byte took (0: the whole)."""
    if unit[0] == "%":
        raw = bytes.fromhex(unit.replace("%", ""))
        try:
            return raw.decode(), 3
        except UnicodeDecodeError:
            return raw.decode("latin-1"), -3  # one character a byte
    if "！" <= unit <= "～":
        return chr(ord(unit) - 0xFEE0), 0
    digits = unit.strip("\\uUx{}&#X;")
    code = int(digits, 10 if unit[0] == "&" and unit[2] not in "xX" else 16) if digits else 0
    return (chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"), 0


def _escapes(layer: Layer) -> Layer | None:
    """The layer with every escape replaced once."""
    text, low, high, at = [], [], [], 0
    for m in ESCAPE.finditer(layer.text):
        a, b = m.span()
        text.append(layer.text[at:a])
        low.append(layer.low[at:a])
        high.append(layer.high[at:a])
        s, width = _unescaped(m.group())
        size = np.array([abs(width) * (len(c.encode()) if width > 0 else 1) if width else b - a for c in s])
        ends = a + np.cumsum(size)
        text.append(s)
        low.append(layer.low[ends - size])
        high.append(layer.high[ends - 1])
        at = b
    if not at:
        return None
    return Layer("".join([*text, layer.text[at:]]), np.concatenate([*low, layer.low[at:]]), np.concatenate([*high, layer.high[at:]]), (*layer.path, "escape"))


def _all_escapes(layer: Layer) -> Layer | None:
    """The layer with escapes resolved until none is left, in one walk: what an escape gives may end or begin another one."""
    if not ESCAPE.search(layer.text):
        return None
    text: list[str] = []
    low: list[int] = []
    high: list[int] = []
    at = near = 0
    while at < len(layer.text):
        if not near:  # up to the end of the next escape nothing can happen
            m = ESCAPE.search(layer.text, at)
            to = m.start() if m else len(layer.text)
            text += layer.text[at:to]
            low += layer.low[at:to].tolist()
            high += layer.high[at:to].tolist()
            at, near = to, ESCAPE_LONGEST
            continue
        text.append(layer.text[at])
        low.append(int(layer.low[at]))
        high.append(int(layer.high[at]))
        at, near = at + 1, near - 1
        while True:
            tail = "".join(text[-ESCAPE_LONGEST:])
            m = next((m for k in range(len(tail)) if (m := ESCAPE.fullmatch(tail, k)) and (tail[k] != "%" or len(tail) - k == 3)), None)
            if m is None:
                break
            n = len(m.group())
            s, _ = _unescaped(m.group())
            a, b = low[-n], high[-1]
            del text[-n:], low[-n:], high[-n:]
            text.append(s)
            low.append(a)
            high.append(b)
            near = ESCAPE_LONGEST
    return Layer("".join(text), np.array(low, np.int64), np.array(high, np.int64), (*layer.path, "escape"))


def _characters(raw: bytes, low: np.ndarray, high: np.ndarray, path: tuple[str, ...]) -> Layer:
    """A layer from bytes, with the places of its bytes; UTF-8, or else one character a byte."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return Layer(raw.decode("latin-1"), low, high, path)
    if len(text) < len(raw):
        size = np.array([len(c.encode()) for c in text])
        ends = np.cumsum(size)
        low, high = low[ends - size], high[ends - 1]
    return Layer(text, low, high, path)


def _decoded(run: str) -> tuple[bytes, int] | None:
    """What a base64 run stands for, and how many characters before it do not belong to it.  None if it is no text and no stream."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):  # letters that touch the run shift it by up to three
        some = body[skip:]
        some = some[: len(some) - (len(some) % 4 == 1)]
        if len(some) < 16:
            return None
        try:
            raw = base64.b64decode(some + "=" * (-len(some) % 4))
        except binascii.Error:
            continue
        if STREAM.match(raw[:10].decode("latin-1")):
            return raw, skip
        try:
            if not _CONTROL.search(raw.decode()):
                return raw, skip
        except UnicodeDecodeError:
            pass
    return None


def _base64(layer: Layer):
    """Layers of the runs that are base64; inside an accepted run no other is looked for."""
    taken: list[tuple[int, int]] = []
    for pattern in BASE64:
        runs = [m.span() for m in pattern.finditer(layer.text)]
        before = np.array(sorted(taken), np.int64).reshape(-1, 2)
        for a, b in runs:
            k = np.searchsorted(before[:, 0], b) - 1
            if k >= 0 and before[k, 1] > a:
                continue
            where = np.array([i for i in range(a, b) if layer.text[i] not in "\r\n="])
            got = _decoded("".join(layer.text[i] for i in where))
            if got is None:
                continue
            taken.append((a, b))
            raw, skip = got
            k = np.arange(len(raw))
            first = skip + 4 * (k // 3) + k % 3
            yield _characters(raw, layer.low[where[first]], layer.high[where[first + 1]], (*layer.path, "base64"))


def _unpacker(magic: str):
    return zlib.decompressobj(47) if magic[0] in "\x1fx" else bz2.BZ2Decompressor() if magic[0] == "B" else lzma.LZMADecompressor()


def _streams(layer: Layer):
    """Layers of the compressed streams, in pieces.  All characters of one stand for the whole stream."""
    at = 0
    while m := STREAM.search(layer.text, at):
        at = m.start()
        wide = re.compile(r"[^\x00-\xff]").search(layer.text, at)
        raw = layer.text[at : wide.start() if wide else len(layer.text)].encode("latin-1")
        unpack, held, used, fed = _unpacker(m.group()), b"", 0, 0
        try:
            while not unpack.eof:
                if isinstance(unpack, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                    feed = raw[fed:] if unpack.needs_input and fed < len(raw) else b""
                    fed += len(feed)
                    out = unpack.decompress(feed, PIECE)
                else:
                    feed = raw if not fed else unpack.unconsumed_tail
                    fed = len(raw)
                    out = unpack.decompress(feed, PIECE) if feed else b""
                if not out and not unpack.eof:
                    break
                held += out
                used = len(raw) - len(unpack.unused_data) if unpack.eof else len(raw)
                if len(held) >= PIECE and not unpack.eof:
                    cut = held.rfind(b"\n") + 1 or max((x.end() for x in _BREAK.finditer(held, len(held) - 4096)), default=0)
                    if cut:
                        yield _of_stream(held[:cut], layer, at, used)
                        held = held[cut:]
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            pass  # what came before the damage counts
        if held:
            yield _of_stream(held, layer, at, used)
        at += max(1, used if held else 1)


def _of_stream(raw: bytes, layer: Layer, a: int, used: int) -> Layer:
    low, high = layer.low[a], layer.high[a + used - 1]
    return _characters(raw, np.full(len(raw), low), np.full(len(raw), high), (*layer.path, "stream"))


def _unwrapped(layer: Layer):
    deep = layer.path[-SINGLE_LEVELS:] == ("escape",) * SINGLE_LEVELS
    got = (_all_escapes if deep else _escapes)(layer)
    if got is not None:
        yield got
    yield from _base64(layer)
    if layer.path:  # a text itself holds no compressed bytes
        yield from _streams(layer)


def found(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, in the text itself, layers) by start, then kind, then end.  Each span of a kind is listed once, with
    the way that was shortest to it."""
    out: dict[tuple[str, int, int], tuple[bool, str]] = {m: (True, "") for m in matches(text)}
    if ESCAPE.search(text) or any(p.search(text) for p in BASE64):
        places = np.arange(len(text), dtype=np.int64)
        todo, seen = [Layer(text, places, places + 1, ())], set()
        while todo:
            after = []
            for layer in todo:
                for new in _unwrapped(layer):
                    if not new.text:
                        continue
                    name = hashlib.blake2b(new.text.encode(errors="surrogatepass"), digest_size=16).digest(), int(new.low[0]), int(new.high[-1])
                    if name in seen:
                        continue
                    seen.add(name)
                    for kind, a, b in matches(new.text):
                        out.setdefault((kind, int(new.low[a]), int(new.high[b - 1])), (False, ">".join(new.path)))
                    after.append(new)
            todo = after
    rows = [(*k, *v) for k, v in out.items()]
    return sorted(rows, key=lambda r: (r[1], KINDS.index(r[0]), r[2]))


# ---------------------------------------------------------------- Spark

_FIND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("layers", pa.string())])


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, finds): the secrets of each document row, in its text or below any nesting of encodings.

    docs needs doc_id and text; other columns are ignored.  finds is an array of (kind, start, end, base, layers) by start, then kind as in KINDS:
    code points of the text, end exclusive; base tells finds of the text as it stands, layers how an encoded one was reached.  Null and empty texts have an empty array.  Repeated
    rows are returned as often as they come, null ids as they are; an empty table gives no rows.  No exchange: each
    text is worked on by itself, in slices of a few MB.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for cut in slices(batch, "text"):
                rows = [[dict(zip(("kind", "start", "end", "base", "layers"), f, strict=True)) for f in found(t.as_py() or "")] for t in cut.column(1)]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(rows, pa.list_(_FIND))], ["doc_id", "finds"])

    return docs.mapInArrow(run, "doc_id long, finds array<struct<kind:string,start:long,end:long,base:boolean,layers:string>>")


def listed(finds: Column) -> Column:
    """kind:start:end of finds, joined by commas."""
    return F.array_join(F.transform(finds, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """(doc_id, text): the texts with every find replaced by `mask`; finds that overlap are replaced as one.  Rows as by `scanned`; null stays null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def clean(text):
        parts, at = [], 0
        for _, a, b, _, _ in found(text):
            if a >= at:
                parts += [text[at:a], mask]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches):
        for batch in batches:
            for cut in slices(batch, "text"):
                rows = [None if (t := x.as_py()) is None else clean(t) for x in cut.column(1)]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    return docs.mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of finds of each kind in the text as it stands, their digest, and the spans of all finds."""
    of_text = F.filter("finds", lambda f: f["base"])
    count = lambda kind: F.size(F.filter(of_text, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned(docs).select("doc_id", *map(count, KINDS), F.sha2(listed(of_text).cast("binary"), 256).alias("base_sha256"), listed(F.col("finds")).alias("spans"))
