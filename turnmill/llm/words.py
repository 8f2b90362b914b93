"""Words of texts and conversations, without case, punctuation, markup and the writing of the JSON."""

from __future__ import annotations

import html
import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")
_APOSTROPHES = str.maketrans("", "", "'’ʼ­​‌‍⁠﻿")


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits; tags, link targets, entities and apostrophes are no part."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    if text.isascii():
        text = text.replace("'", "")
    else:
        text = unicodedata.normalize("NFKC", text.translate(_APOSTROPHES))
    return _WORD.findall(text.lower())


def portions(sizes: Iterable[int | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ends of consecutive ranges whose sizes add up to at most ``most``, or that hold one element: what arrays are made of at a time."""
    start = total = n = 0
    for n, size in enumerate(sizes, 1):
        size = size or 0
        if n - 1 > start and total + size > most:
            yield start, n - 1
            start, total = n - 1, 0
        total += size
    if n > start:
        yield start, n


def turns(value: str | None) -> list[dict]:
    """The turns of a JSON array; empty where it is null, broken or no array. Elements that are no objects are dropped."""
    if not value:
        return []
    try:
        got = json.loads(value)
    except ValueError:
        return []
    return [t for t in got if isinstance(t, dict)] if isinstance(got, list) else []


def content(turn: dict) -> str:
    c = turn.get("content")
    return c if isinstance(c, str) else ""


class Hashes(dict):
    """32-bit hash of each word, remembered for the words of a task; forgets all when it grows too large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[w] = zlib.crc32(w.encode("utf-8", "replace"))
        return v


#: Code points that the table of letters and digits covers; beyond them none is assigned.
_PLANES = 0x33480
_REMOVED = np.array(sorted(_APOSTROPHES), np.uint32)
_PLACE = np.random.default_rng(31).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """1 for letters and digits, 2 for characters that are no part of a text, else 0."""
    t = np.fromiter((chr(i).isalnum() for i in range(_PLANES)), np.uint8, _PLANES)
    t[_REMOVED] = 2
    return t


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit hashes of the ``words`` of all texts of a batch, and the bounds of each text in them."""
    bare = []
    for t in texts:
        if "&" in t:
            t = html.unescape(t)
        if "<" in t:
            t = _TAG.sub(" ", t)
        if "](" in t:
            t = _LINK.sub("] ", t)
        bare.append(t)
    whole = "\n".join(bare)
    if not whole.isascii() and not unicodedata.is_normalized("NFKC", whole):
        bare = [t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t.translate(_APOSTROPHES)) for t in bare]
    # letter by letter, as a few become longer in lower case
    bare = [t.lower() for t in bare]
    points = np.frombuffer("\n".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in bare])
    kind = _kinds()[np.minimum(points, _PLANES - 1)]
    kept = kind != 2
    if not kept.all():
        gone = np.concatenate(([0], np.cumsum(~kept)))
        ends = ends - gone[np.minimum(ends, len(points))]
        points, kind = points[kept], kind[kept]
    at = np.flatnonzero(kind)
    if not len(at):
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.greater(at[1:] - at[:-1], 1, out=new[1:])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    part = (points[at].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * _PLACE[place & 4095]
    h = np.add.reduceat(part, first)
    h ^= h >> np.uint64(29)
    codes = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
    return codes, np.concatenate(([0], np.searchsorted(at[first], ends)))


@lru_cache(maxsize=1)
def _token_kinds() -> np.ndarray:
    t = np.zeros(_PLANES, np.uint8)
    syntax = set("\"'”’»«)(][}{*_`~|<>,;:/\\&“„–—-")
    stops = set(".!?…。！？؟")
    for i in range(_PLANES):
        c = chr(i)
        t[i] = 1 if c.isalnum() else 2 if c.isspace() else 4 if c in stops else 0 if c in syntax else 8
    return t


def token_kinds(points: np.ndarray) -> np.ndarray:
    """Per code point 1 for letters and digits, 2 for blanks, 4 for ends of sentences, 8 for ornaments such as emoji, else 0."""
    return _token_kinds()[np.minimum(points, _PLANES - 1)]
