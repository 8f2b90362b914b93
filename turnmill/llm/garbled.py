"""Text decoded with a wrong encoding: UTF-8 read as any of ``AS``, and Cyrillic encodings swapped; found by automatons."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Encodings as which UTF-8 bytes may have been read.
AS = ("cp1252", "latin1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2", "iso8859_15")
#: Characters that may have been garbled: code point ranges.
CHARACTERS = ((0xA0, 0x180), (0x370, 0x460), (0x5D0, 0x5EB), (0x620, 0x64B), (0x1EA0, 0x1EFA), (0x2010, 0x203B), (0x20A0, 0x20C0), (0x2100, 0x2140), (0x2190, 0x21A0), (0x2200, 0x2266), (0xFB01, 0xFB03), (0xFEFF, 0xFF00), (0xFFFD, 0xFFFE), (0x1F300, 0x1F700), (0x1F900, 0x1FA00))
#: Single-byte encodings of Cyrillic that are taken for one another, and those as which they are read.
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
CYRILLIC_AS = (*CYRILLIC, "cp1252", "latin1", "mac_roman", "cp437", "cp850")
#: Frequent letter pairs that swapped text must show at least.
HITS = 2
#: Frequent letter pairs of Russian (fixed values).
COMMON = "ст но то на ен ов ни ра во ко ал ли по ре ос пр ро ер ка ел ан ет ом те ва ин ел ле де ть ол ла не ор ат ес да от од ти за та ло го ве ри ит об ог ак тр ру об ки ки мы ас им че со до ме ит ож ия бы ск на ую ый ая ем ши зд уд ня"
#: Characters that may follow a letter in correct text; a sequence ending on one says little alone.
_FOLLOW = set("\xa0\xad»«…’”“‘–—™®°ªº¡¿‚„€£§·•|")
_CYRILLIC_LETTER = re.compile("[\u0400-\u04ff]")
_CYRILLIC_WORD = re.compile(r"[а-яё]+")
_SEGMENT = re.compile(r"[^\n.!?…]+")
_WORD = re.compile(r"[^\W\d_]+|[^\x00-\x7f\s]+")
_LOST = re.compile(r"(?<=\w)�|�(?=\w)|��+")
_C1 = re.compile(r"(?<=\w)[\x80-\x84\x86-\x9f]|[\x80-\x84\x86-\x9f](?=\w)")


def _read_as(b: bytes, wrong: str) -> str:
    """Bytes in a single-byte encoding; those that it leaves open become C1 controls, as lenient readers do."""
    try:
        return b.decode(wrong)
    except UnicodeDecodeError:
        return "".join(_one(x, wrong) for x in b)


@lru_cache(maxsize=8192)
def _one(x: int, wrong: str) -> str:
    try:
        return bytes([x]).decode(wrong)
    except UnicodeDecodeError:
        return chr(x)


@lru_cache(maxsize=1)
def sequences() -> dict[str, tuple[str, bool]]:
    """Garbled sequence -> (original character, whether it counts alone), for all pairs and for twice garbled."""
    out: dict[str, tuple[str, bool]] = {}
    for lo, hi in CHARACTERS:
        for c in map(chr, range(lo, hi)):
            raw = c.encode()
            for wrong in AS:
                g = _read_as(raw, wrong)
                strong = not (len(g) == 2 and (g[1] in _FOLLOW or (g[0] in "РС" and _CYRILLIC_WORD.fullmatch(g[1].lower()))))
                out.setdefault(g, (c, strong))
                twice = _read_as(g.encode(), wrong)
                out.setdefault(twice, (c, True))
    return out


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for g, (c, strong) in sequences().items():
        a.add_word(g, (len(g), c, strong))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _swaps():
    """Automaton of the frequent letter pairs of Russian as each pair of encodings garbles them."""
    import ahocorasick

    own: dict[str, list[tuple[str, str]]] = {}
    for right in CYRILLIC:
        for wrong in CYRILLIC_AS:
            if wrong != right:
                for b in set(COMMON.split()):
                    own.setdefault(_read_as(b.encode(right), wrong), []).append((right, wrong))
    a = ahocorasick.Automaton()
    for g, pairs in own.items():
        a.add_word(g, pairs)
    a.make_automaton()
    return a


def _common_pairs(words: list[str]) -> tuple[int, int]:
    """Letter pairs of Cyrillic words that are frequent ones, and all."""
    common = set(COMMON.split())
    n = hit = 0
    for w in words:
        n += len(w) - 1
        hit += sum(w[i : i + 2] in common for i in range(len(w) - 1))
    return hit, n


def _unswapped(w: str, right: str, wrong: str) -> str | None:
    try:
        got = w.encode(wrong).decode(right)
    except UnicodeError:
        return None
    return got if got.islower() or got.istitle() or len(got) == 1 or got[1:].islower() else None


def _best_swap(ws: list[re.Match]) -> list[tuple[re.Match, str]]:
    """The words of a sentence as the pair of encodings reads them that makes them clearly more like Russian, if any does."""
    votes: Counter = Counter(p for m in ws for _, pairs in _swaps().iter(m[0]) for p in pairs)
    hits, of = _common_pairs([m[0].lower() for m in ws if _CYRILLIC_WORD.fullmatch(m[0].lower())])
    asis = hits / of if of else 0.0
    best: tuple = ((0, 0.0), [])
    for (right, wrong), seen in votes.items():
        if seen < HITS:
            continue
        fixed = [(m, _unswapped(m[0], right, wrong)) for m in ws]
        good = [f.lower() for _, f in fixed if f and _CYRILLIC_WORD.fullmatch(f.lower())]
        letters = sum(map(len, good))
        if not letters or letters < 0.7 * sum(len(m[0]) for m in ws):
            continue
        hits, of = _common_pairs(good)
        share = hits / of if of else 0.0
        # few letters must nearly all be in frequent pairs, many a quarter of them
        sure = share >= 0.25 and hits >= 3 and letters >= 6 or share >= 0.6 and hits >= HITS and max(map(len, good)) > 3
        if sure and share - asis >= 0.15 and (letters, share) > best[0]:
            best = ((letters, share), [(m, f) for m, f in fixed if f])
    return best[1]


def restore_swapped(text: str) -> tuple[str, int]:
    """Cyrillic of one single-byte encoding read as another: the text restored, and its restored words.

    Judged sentence by sentence, so that correct text beside stays. A sentence is garbled if its words
    without any ASCII letter, read the other way, have clearly more frequent letter pairs of Russian.
    """
    fixes: list[tuple[int, int, str]] = []
    for seg in _SEGMENT.finditer(text):
        if seg[0].isascii():
            continue
        foreign = [m for m in _WORD.finditer(seg[0]) if not m[0].isascii()]
        # words in Cyrillic letters and others may be garbled in different ways, or only the ones
        for own in (True, False):
            fixes += [(seg.start() + m.start(), seg.start() + m.end(), f) for m, f in _best_swap([m for m in foreign if bool(_CYRILLIC_LETTER.search(m[0])) == own])]
    out, at = [], 0
    for a, b, f in sorted(fixes):
        out += [text[at:a], f]
        at = b
    n = len(fixes)
    return "".join([*out, text[at:]]), n


def _out_of_place(text: str, start: int, end: int) -> bool:
    """Whether a sequence that may follow a letter in correct text cannot do so here: a capital inside a lower-case word, or Â without a word."""
    if text[start] not in "ÂÃ":
        return False
    before, after = text[start - 1 : start], text[end : end + 1]
    return before.islower() or after.islower() and text[start] == "Ã" and text[end - 1] != "\xa0" or text[start] == "Â" and not before.isalpha() and (text[end - 1] in "°¿¡«»·€£§©®ªº" or text[end - 1] == "\xa0" and not after.isupper())


def inspect(text: str | None) -> tuple[bool, str | None, int]:
    """(affected, text with the matched spans restored, restored spans). Null and plain ASCII text is never affected."""
    if not text or text.isascii():
        return False, text, 0
    fixed, swapped = restore_swapped(text)
    strong = weak = at = 0
    parts: list[str] = []
    for end, (n, c, sure) in _automaton().iter_long(fixed):
        sure = sure or _out_of_place(fixed, end + 1 - n, end + 1)
        strong, weak = strong + sure, weak + (not sure)
        parts += [fixed[at : end + 1 - n], c]
        at = end + 1
    mended = strong > 0 or weak >= 3
    fixed = "".join([*parts, fixed[at:]]) if mended else fixed
    spans = (strong + weak) * mended
    for m in reversed(list(_C1.finditer(fixed))):
        fixed = fixed[: m.start()] + _one(ord(m[0]), "cp1252") + fixed[m.end() :]
        spans += 1
    return bool(spans or swapped or _LOST.search(text)), fixed, spans + swapped


def mark_garbled(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(``ident``, affected, restored, spans) of every row, repeated rows too; nothing is shuffled.

    ``restored`` has the matched spans replaced and all else untouched, so that correct text beside
    garbled text stays. Text lost to replacement characters is affected but cannot be restored. Null
    and empty texts are not affected.
    """
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField("affected", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("spans", T.IntegerType())])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [inspect(t) for t in b[text]]
            yield pd.DataFrame({ident: b[ident], "affected": [g[0] for g in got], "restored": [g[1] for g in got], "spans": [g[2] for g in got]}).astype({"spans": "int32"})

    return df.select(ident, text).mapInPandas(judge, schema)
