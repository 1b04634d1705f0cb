"""What the token operators know of a byte-level BPE tokenizer file (.json of the tokenizers library)."""

from __future__ import annotations

import gc
import json
import os
import re
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Fixed value: the split pattern of byte-level pre-tokenisation.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two characters that are no white space always starts a pre-token.
_GAP = re.compile(r"(?<=\S) (?=\S)")
_WIDE, _WIDE_BEFORE = re.compile(r" \s"), re.compile(r" (?<=\s )")
#: Characters whose kind (letter, digit or other) is the same in all Unicode tables, so the split here is the library's.
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]*").fullmatch
KEPT_UNITS = 200_000
JOINED = 500  # new units that the library encodes as one text


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(others)}


_BYTES = _byte_characters()


def _gathered(flat: np.ndarray, edge: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[edge[i]:edge[i + 1]] of each i in which, one after the other, and the ends of these."""
    start = edge[which]
    size = edge[which + 1] - start
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)], end


class Pieces:
    """Splits texts into pre-tokens and encodes them with the library, each distinct one once.

    Only files whose pre-tokeniser is byte level with its pattern and no added prefix space, and
    that have no normaliser, can be split like this; others raise ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level tokenizer files without a normaliser can be counted by pre-token")
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(BYTE_LEVEL).findall
        added = sorted((a["content"] for a in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.units: defaultdict[str, int] = defaultdict()  # number of each unit; its ids are kept[edge[number]:edge[number + 1]]
        self.kept, self.edge = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.tokenize = self.tokenizer.model.tokenize
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each id; a byte is one character there
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.joins = not any(re.search(r"\s", a) for a in added)

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string in it is one of its own, as is the library's default."""
        if self.added and self.added.search(text):
            return [t for i, part in enumerate(self.added.split(text)) for t in ([part] if i % 2 else self.split(part))]
        return self.split(text)

    def counts(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_units(self, units: list[str]) -> list[bytes]:
        """Ids of units that each begin with a space and start a pre-token, many of them as one text.

        The bytes that the ids stand for tell where each unit ends; where they don't meet the units' ends, each is encoded alone.
        """
        if not self.joins:
            return self._encoded(units)
        out: list[bytes] = []
        groups = [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            reach = np.cumsum(self.width[np.minimum(ids, len(self.width) - 1)])
            ends = np.cumsum([len(u.encode()) for u in group])
            cut = np.searchsorted(reach, ends) + 1
            if not len(ids) or cut[-1] != len(ids) or (reach[cut - 1] != ends).any():
                out += self._encoded(group)
                continue
            raw, cut = ids.astype("<u4").tobytes(), (4 * cut).tolist()
            out += [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        return out

    def _encoded_plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of them for each unit) of units of plain characters: each distinct pre-token goes to the library's model once.

        None if the bytes that the ids stand for are not those of the pre-tokens.
        """
        parts = list(map(self.split, units))
        known: defaultdict[str, int] = defaultdict(count().__next__)
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64)
        tokens = "\0".join(known).encode().decode("latin-1").translate(_BYTES).split(chr(_BYTES[0]))
        made = [[x.id for x in self.tokenize(t)] for t in tokens]
        edge = np.concatenate([[0], np.cumsum(list(map(len, made)))])
        flat = np.fromiter(chain.from_iterable(made), np.uint32, edge[-1])
        reach = np.concatenate([[0], np.cumsum(self.width[np.minimum(flat, len(self.width) - 1)])])
        if (np.diff(reach[edge]) != list(map(len, tokens))).any():
            return None
        ids, end = _gathered(flat, edge, which)
        end = end[np.cumsum(list(map(len, parts))) - 1]
        return ids, np.diff(end, prepend=0)

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of new units, in order, to those kept."""
        plain = np.fromiter((_PLAIN(x) is not None for x in new), bool, len(new))
        easy = self._encoded_plain([" " + x for x, ok in zip(new, plain, strict=True) if ok]) if plain.any() else None
        if easy is None:
            plain[:] = False
            easy = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        other = self._encoded_units([" " + x for x, ok in zip(new, plain, strict=True) if not ok])
        size = np.zeros(len(new), np.int64)
        size[plain], size[~plain] = easy[1], [len(x) // 4 for x in other]
        ids, of = np.zeros(size.sum(), np.uint32), np.repeat(plain, size)
        ids[of], ids[~of] = easy[0], np.frombuffer(b"".join(other), "<u4")
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(size)])
        self.kept = np.concatenate([self.kept, ids])

    def _cut(self, text: str) -> list[str] | None:
        if self.added and self.added.search(text):
            return None
        return _GAP.split(text) if _WIDE.search(text) or _WIDE_BEFORE.search(text) else text.split(" ")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        A text is cut at spaces where a pre-token always starts; each distinct unit is encoded once
        for the texts at hand, and up to KEPT_UNITS of them are remembered.
        """
        collects = gc.isenabled()
        gc.disable()  # there are many small lists and no cycles, so walks over them would free nothing
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        cut = list(map(self._cut, texts))
        heads = self._encoded([u.pop(0) if u else t for t, u in zip(texts, cut, strict=True)])
        known = len(self.units)
        self.units.default_factory = count(known).__next__
        self.edge = self.edge[: known + 1]
        self.kept = self.kept[: self.edge[-1]]
        which = np.fromiter(map(self.units.__getitem__, chain.from_iterable(u or () for u in cut)), np.int64)
        if len(self.units) > known:
            self._learn(list(islice(self.units, known, None)))
        ids, end = _gathered(self.kept, self.edge, which)
        for x in list(islice(self.units, KEPT_UNITS, None)):
            del self.units[x]
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        last = np.cumsum([len(u or ()) for u in cut])
        ends = (4 * np.concatenate([[0], end])[last]).tolist()
        return [b"".join((h, raw[a:b])) for h, a, b in zip(heads, [0, *ends[:-1]], ends, strict=True)]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One Pieces for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]
