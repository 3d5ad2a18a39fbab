"""Byte-level BPE vocabularies and the pre-tokens of whole batches of texts, found with NumPy.

The pre-token pattern is fixed by the vocabulary files: contractions, letters, numbers and other signs each with one
optional space before, and white space. Here it is computed from character classes: a pre-token starts where the class
changes, one space belongs to what follows it, and the last white space of a run stands apart from the rest of it.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import pre_tokenizers

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The contractions of the pre-token pattern.
CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")


@cache
def character_classes() -> np.ndarray:
    """Class of every code point, as the tokenizers library has it.

    Signs of which the regex module and Python's own tables disagree, which are those of the newest Unicode versions,
    are put to the library's pre-tokeniser.
    """
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    signs = "".join(map(chr, points))
    where = np.array(points)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, signs):
            out[where[m.start() : m.end()]] = kind
    major = {"L": LETTER, "N": NUMBER}
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for point, sign in zip(points, signs):
        if out[point] != SPACE and out[point] != major.get(unicodedata.category(sign)[0], OTHER):
            out[point] = next((kind for kind, of in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(of + sign)) == 1), SPACE)
    return out


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """Class of each byte of UTF-8; all bytes of a character have the character's class."""
    table = character_classes()
    out = table[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if not lead.size:
        return out
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    first, one, two, three = (padded[lead + k].astype(np.int64) for k in range(4))
    more = 1 + (first >= 0xE0) + (first >= 0xF0)
    point = np.where(
        more == 1, (first & 0x1F) << 6 | one & 0x3F,
        np.where(more == 2, (first & 0x0F) << 12 | (one & 0x3F) << 6 | two & 0x3F,
                 (first & 0x07) << 18 | (one & 0x3F) << 12 | (two & 0x3F) << 6 | three & 0x3F),
    )
    kinds = table[np.minimum(point, 0x10FFFF)]
    out[lead] = kinds
    for k in (1, 2, 3):
        at = lead[more >= k] + k
        inside = at < len(raw)
        out[at[inside]] = kinds[more >= k][inside]
    return out


def pretoken_starts(raw: np.ndarray, bounds: np.ndarray, special: bytes | None = None) -> np.ndarray:
    """Where the pre-tokens of the texts raw[bounds[i]:bounds[i + 1]] start, and the end of the last one.

    An occurrence of ``special`` is one pre-token, and the text before and after it is treated as if it stood alone.
    """
    n = len(raw)
    if not n:
        return np.zeros(1, np.int64)
    found = []
    if special:
        whole, owner = raw.tobytes(), bounds
        at = whole.find(special)
        while at >= 0:
            text = np.searchsorted(owner, at, "right")
            if at + len(special) <= owner[text]:
                found.append(at)
                at = whole.find(special, at + len(special))
            else:  # it lies across two texts
                at = whole.find(special, at + 1)
    found = np.array(found, np.int64)
    edges = bounds if not found.size else np.union1d(bounds, np.concatenate([found, found + len(special)]))
    kind = byte_classes(raw)
    start = np.zeros(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) & (raw[:-1] != 32)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
    for _ in range(3):
        last = np.where((raw[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    start |= edge
    quote = np.flatnonzero((raw == 39) & start[:n])
    if quote.size:
        limit = edges[np.searchsorted(edges, quote, "right")]
        free = np.ones(len(quote), bool)
        for text in CONTRACTIONS:
            fits = free & (quote + len(text) <= limit)
            for k in range(1, len(text)):
                fits[fits] = raw[quote[fits] + k] == text[k]
            free &= ~fits
            at = quote[fits]
            start[at + 1] = False
            start[at + len(text)] = True
        start |= edge
    if found.size:
        for at in found:
            start[at + 1 : at + len(special)] = False
    return np.flatnonzero(start)


def distinct_pieces(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Index into the list of distinct pieces for each piece raw[starts[i]:starts[i + 1]], and that list."""
    pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def byte_alphabet() -> dict[str, int]:
    """Byte of each sign that stands for a byte in the files.

    Printable signs of Latin-1 stand for themselves; the remaining bytes, in order, for the code points from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.token = {i: bytes(back[c] for c in text) for text, i in ids.items()}
        self.byte_id = {self.token[i][0]: i for i in self.token if len(self.token[i]) == 1}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        added = spec.get("added_tokens", [])
        if len(added) > 1 or any(a[k] for a in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("one plain added token at most is supported")
        self.special = added[0]["content"].encode() if added else None
        self.special_id = added[0]["id"] if added else None
        if added:
            self.token[self.special_id] = self.special
        self.size = max(self.token) + 1

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merging: the pair of lowest rank first, from the left."""
        import heapq

        ids = [self.byte_id[b] for b in piece]
        if len(ids) <= 40:
            while len(ids) > 1:
                best = min((self.merge.get(pair, (1 << 60, 0))[0], k) for k, pair in enumerate(zip(ids, ids[1:])))
                if best[0] == 1 << 60:
                    break
                k = best[1]
                ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
            return ids
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        waiting = [(self.merge[pair][0], k, pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in self.merge]
        heapq.heapify(waiting)
        while waiting:
            _, k, pair = heapq.heappop(waiting)
            right = after[k]
            if right < 0 or (ids[k], ids[right]) != pair:
                continue
            ids[k], ids[right], after[k] = self.merge[pair][1], -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (new := (ids[left], ids[after[left]])) in self.merge:
                    heapq.heappush(waiting, (self.merge[new][0], left, new))
        return [i for i in ids if i >= 0]

    def whole(self) -> list[int]:
        """Ids of the tokens whose own string encodes as that one token: each is put through the merges once."""
        return [i for i, text in self.token.items() if i != self.special_id and self.merged(text) == [i]]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
