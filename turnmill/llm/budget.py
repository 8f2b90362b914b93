"""Estimated tokens per record and slice: count-only Viterbi over a double-array trie of a public vocabulary."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Added to a piece's rank in its log weight: pieces are listed by merge order, not by probability.
RANK_OFFSET = 100
#: Log weight of one fallback byte.
BYTE = -12.0
#: Segments remembered per task.
MEMO = 400_000
_SEGMENT = re.compile(r"▁*[^▁]+|▁+")


@dataclass
class Trie:
    """Pieces as a double array: child of state s by symbol c is ``base[s] + c`` if its ``check`` is s."""

    symbols: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, pieces: list[tuple[str, float]]) -> Trie:
        use: dict[str, int] = {}
        for p, _ in pieces:
            for c in p:
                use[c] = use.get(c, 0) + 1
        # frequent symbols get small numbers, which keeps the arrays dense
        symbols = {c: k + 1 for k, c in enumerate(sorted(use, key=lambda c: (-use[c], c)))}
        coded = sorted(([symbols[c] for c in p], w) for p, w in pieces)
        size = 4 * sum(len(p) for p, _ in coded) // 3 + 2 * len(symbols) + 64
        base, check, weight = [0] * size, [-1] * size, [math.nan] * size
        check[0] = 0
        # where the last node with as many children went; the search goes on from there
        hint: dict[int, int] = {}
        todo = [(0, 0, 0, len(coded))]
        while todo:
            state, depth, lo, hi = todo.pop()
            if len(coded[lo][0]) == depth:
                weight[state] = coded[lo][1]
                lo += 1
            if lo == hi:
                continue
            kids, i = [], lo
            while i < hi:
                c, j = coded[i][0][depth], i
                while j < hi and coded[j][0][depth] == c:
                    j += 1
                kids.append((c, i, j))
                i = j
            many = min(len(kids), 8)
            b = hint.get(many, 1)
            while True:
                if b + kids[-1][0] >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    weight += [math.nan] * size
                if all(check[b + c] < 0 for c, *_ in kids):
                    break
                b += 1
            hint[many] = b
            base[state] = b
            for c, i, j in kids:
                check[b + c] = state
                todo.append((b + c, depth + 1, i, j))
        end = max(k for k, c in enumerate(check) if c >= 0) + len(symbols) + 2
        cut = lambda a, x: np.array((a + [x] * len(symbols))[:end])
        return cls(symbols, cut(base, 0), cut(check, -1), cut(weight, math.nan))


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and log weights of a vocabulary file, without control and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    first = ids[0]
    return [(m.id_to_piece(i), -math.log(i - first + 1 + RANK_OFFSET)) for i in ids]


@lru_cache(maxsize=2)
def _trie(path: str) -> Trie:
    return Trie.build(read_pieces(path))


class Counter:
    """Counts the pieces of texts; the lengths of segments seen are kept."""

    def __init__(self, trie: Trie):
        self.symbols, self.base, self.check = trie.symbols, trie.base.tolist(), trie.check.tolist()
        self.weight = trie.weight.tolist()
        self.memo: dict[str, int] = {}

    def segment(self, s: str) -> int:
        """Pieces on the heaviest path; only its length is kept at each position."""
        n = len(s)
        low = float("-inf")
        best, count = [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        symbols, base, check, weight = self.symbols, self.base, self.check, self.weight
        codes = [symbols.get(c, 0) for c in s]
        for i in range(n):
            here, k, state, single = best[i], count[i] + 1, 0, False
            for j in range(i, n):
                c = codes[j]
                if not c:
                    break
                to = base[state] + c
                if check[to] != state or not base[state]:
                    break
                state = to
                w = weight[state]
                if w == w:
                    single |= j == i
                    if here + w > best[j + 1]:
                        best[j + 1], count[j + 1] = here + w, k
            if not single:
                size = len(s[i].encode("utf-8", "replace"))
                if here + BYTE * size > best[i + 1]:
                    best[i + 1], count[i + 1] = here + BYTE * size, count[i] + size
        return count[n]

    def text(self, t: str | None) -> int:
        """Estimated tokens of a text; none in null and empty texts."""
        if not t:
            return 0
        memo, total = self.memo, 0
        for s in _SEGMENT.findall("▁" + t.replace(" ", "▁")):
            n = memo.get(s)
            if n is None:
                n = self.segment(s)
                if len(s) <= 64:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[s] = n
            total += n
        return total


def token_counts(texts: Column, path: str) -> Column:
    """Estimated tokens of an array of texts (or of one text in an array), null texts counting nothing.

    No document-level limit: the work of a segment is its length times the longest piece. A null array is 0.
    """

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = Counter(_trie(path))
        for s in batches:
            yield pd.Series([0 if a is None else sum(map(c.text, a)) for a in s], dtype="int64")

    return count(texts)


def totals(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records, characters and estimated tokens per slice; a null key is a slice of its own."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
