"""Corpus encoding with a public byte-level BPE vocabulary, and tree concatenation for long unsplit text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pre-token of more bytes than this is encoded in pieces of at most so many and joined.
PIECE = 2_048
#: Texts of more characters are cut at pre-token ends into rows of about so many, so that tasks share them.
BLOCK = 1 << 16


@lru_cache(maxsize=4)
def _vocabulary(path: str):
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the encoding sees single pre-tokens or whole texts; the pattern is the same
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(PATTERN)


def join_encodings(left: list[int], right: list[int], encode, decode, window: int = 8) -> list[int]:
    """The encoding of the joined bytes, from those of both sides.

    A window of tokens around the join is encoded anew and grows until its first token is the left
    side's own and its last the right side's own (or it takes a whole side in). Then each pair of
    neighbours stands in a canonical encoding, hence the whole is canonical.
    """
    if not left or not right:
        return left + right
    while True:
        a, b = left[-window:], right[:window]
        mid = encode(decode(a) + decode(b))
        left_ok = len(a) == len(left) or mid[0] == a[0]
        right_ok = len(b) == len(right) or mid[-1] == b[-1]
        if left_ok and right_ok and (len(mid) > 1 or len(a) == len(left) or len(b) == len(right)):
            return left[: len(left) - len(a)] + mid + right[len(b) :]
        window *= 2


def encode_long(piece: bytes, encode, decode, most: int = PIECE) -> list[int]:
    """Encoding of one long pre-token: encode pieces, then join neighbours pairwise, level by level."""
    parts = [encode(piece[i : i + most]) for i in range(0, len(piece), most)]
    while len(parts) > 1:
        parts = [join_encodings(parts[i], parts[i + 1], encode, decode) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def encode_text(text: str, path: str, most: int = PIECE) -> list[int]:
    """Ids of one text without special tokens. Lone surrogates count as U+FFFD."""
    enc, pattern = _vocabulary(path)
    text = text.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in text) else text
    if len(text) <= most:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    # long pre-tokens are taken out; the stretches between them go through the library as they are
    for m in pattern.finditer(text):
        a, b = m.span()
        if b - a > most // 4:
            out += enc.encode_ordinary(text[at:a]) if at < a else []
            out += encode_long(text[a:b].encode(), enc._encode_single_piece, enc.decode_bytes, most)
            at = b
    return out + (enc.encode_ordinary(text[at:]) if at < len(text) else [])


def _cut(text: str, path: str, block: int) -> list[dict]:
    """Blocks of about ``block`` characters that end where a pre-token ends.

    A pre-token longer than ``block`` is cut inside; ``glued`` marks blocks that go on with it.
    """
    if len(text) <= block:
        return [{"part": text, "glued": False}]
    _, pattern = _vocabulary(path)
    out, start = [], 0
    for m in pattern.finditer(text):
        a, b = m.span()
        if b - a > block:
            if start < a:
                out.append({"part": text[start:a], "glued": False})
            out += [{"part": text[i : min(i + block, b)], "glued": i > a} for i in range(a, b, block)]
            start = b
        elif b - start >= block:
            out.append({"part": text[start:b], "glued": False})
            start = b
    return out + [{"part": text[start:], "glued": False}] * (start < len(text))


def _joined(parts: list, path: str) -> list[int]:
    enc, _ = _vocabulary(path)
    out: list[int] = []
    runs: list[list[list[int]]] = []
    for p in parts:
        runs[-1].append(list(p["ids"])) if p["glued"] else runs.append([list(p["ids"])])
    for run in runs:
        while len(run) > 1:
            run = [join_encodings(run[i], run[i + 1], enc._encode_single_piece, enc.decode_bytes) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
        out += run[0]
    return out


def encode_corpus(df: DataFrame, ident: str, text: str, path: str, block: int = BLOCK) -> DataFrame:
    """(``ident``, ids array<int>) of every row, repeated rows too.

    Null and empty texts have an empty list. Strings that look like special tokens are ordinary text.
    A text of more than ``block`` characters is cut at ends of pre-tokens into blocks that are spread
    over the tasks and put together by number; a pre-token longer than that is cut too, and one longer
    than ``PIECE`` is encoded in pieces. Whatever was cut inside a pre-token is joined by
    ``join_encodings``. Ordinary rows never shuffle.
    """
    one = T.ArrayType(T.IntegerType())

    @F.pandas_udf(one)
    def whole(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([[] if t is None else encode_text(t, path) for t in s], dtype=object)

    @F.pandas_udf("array<struct<part:string,glued:boolean>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _cut(t, path, block))

    @F.pandas_udf(one)
    def joined(s: pd.Series) -> pd.Series:
        return s.map(lambda parts: _joined(parts, path))

    own = df.select(F.col(ident).alias("__id"), F.col(text).alias("__text"))
    long = F.coalesce(F.length("__text") > block, F.lit(False))
    short = own.filter(~long).select(F.col("__id").alias(ident), whole("__text").alias("ids"))
    # a row is known by its id and text, which a task that runs again finds the same; copies are counted
    numbered = own.filter(long).withColumn("__row", F.xxhash64("__text"))
    blocks = numbered.select("__id", "__row", F.posexplode(cut("__text")).alias("no", "p")).repartition("__row", "no")
    coded = blocks.select("__id", "__row", "no", "p.glued", whole("p.part").alias("ids"))
    parts = coded.groupBy("__id", "__row").agg(F.sort_array(F.collect_set(F.struct("no", "glued", "ids"))).alias("parts"), F.count_if(F.col("no") == 0).alias("copies"))
    each = parts.select(F.col("__id").alias(ident), joined("parts").alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return short.unionByName(each.select(ident, "ids"))
