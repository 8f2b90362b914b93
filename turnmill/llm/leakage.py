"""Held-out passages inside a corpus: spaced-seed hashes of both sides joined, then overlaps that tolerate changed words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.overlap import HOT, HOTTEST, PARTS, class_hashes, key_filter, key_held, lists
from turnmill.llm.words import portions, word_codes
from turnmill.session import checkpointed

#: Token positions that a seed looks at (1) and ignores (0); the first is that of runs without a change.
MASKS = ("111111", "1110111", "11011011", "1101100111", "10110101011")
LEAST_WORDS = 20
#: What a changed word costs against one for an equal word, on one diagonal.
CHANGED = 1.5
#: Words in at most this share of the passages are telling; so many must agree, and this share of a span's.
TELLING, LEAST_TELLING, TELLING_SHARE = 0.03, 3, 0.5
#: Seeds that an overlap of ``LEAST_WORDS`` words has at least, whichever of them are changed one by one.
LEAST_SEEDS = 3
#: Or so many places of the span at which begin six equal words in a row that no other passage has.
UNIQUE = 10

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_BREAK = re.compile(r"\\[nrt]")
_MULT = np.random.default_rng(97).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain(text: str | None) -> str:
    """A text with its backslash escapes resolved; null is empty."""
    if not text or "\\" not in text:
        return text or ""
    return _BREAK.sub(" ", _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)).replace("\\", "")


def _seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of the mask's span; empty where there is none."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(0x9E37)
    h = np.full(n, len(mask) * 7919 + mask.count("1"), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h += c[i : i + n] * _MULT[i]
    return h ^ (h >> np.uint64(31))


def _best_span(equal: np.ndarray) -> tuple[int, int]:
    """Ends of the stretch with the highest sum of 1 per equal and -CHANGED per changed word."""
    s = np.concatenate(([0.0], np.cumsum(np.where(equal, 1.0, -CHANGED))))
    low = np.minimum.accumulate(s)
    end = int(np.argmax(s - low))
    return int(np.argmin(s[: end + 1])), end


def overlap_words(item: np.ndarray, telling: np.ndarray, unique: np.ndarray, doc: np.ndarray, diagonals: list[int]) -> int:
    """Words of ``item`` that stand in ``doc`` in their order around the seed hits; 0 where they tell nothing of this passage.

    A diagonal is the position in the document less that in the passage. The best stretch of each is
    taken; stretches that follow one another in both texts within three words are one overlap.
    """
    spans = []
    for d in sorted(set(diagonals)):
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        if hi - lo < 1:
            continue
        equal = item[lo:hi] == doc[lo + d : hi + d]
        a, b = _best_span(equal)
        if b > a:
            t = telling[lo + a : lo + b]
            runs = np.convolve(equal[a:b], np.ones(6, int), "valid") == 6 if b - a > 5 else np.empty(0, bool)
            own = int((runs & unique[lo + a : lo + a + len(runs)]).sum())
            spans.append((lo + a, lo + b, d, int(equal[a:b].sum()), int((t & equal[a:b]).sum()), int(t.sum()), own))
    spans.sort()
    best = 0
    for i, (_, end, d, n, t, of, own) in enumerate(spans):
        if n < 4:
            continue
        for a2, b2, d2, n2, t2, of2, own2 in spans[i + 1 :]:
            if d2 != d and 0 <= a2 - end + 2 <= 5 and abs(d2 - d) <= 3:
                end, d, n, t, of, own = b2, d2, n + n2, t + t2, of + of2, own + own2
        if n > best and (t >= LEAST_TELLING and t >= TELLING_SHARE * of or own >= UNIQUE):
            best = n
    return best


_SEEDS = [("seed", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]


def _coded(df: DataFrame, ident: str, text: str, least: int, known=None) -> DataFrame:
    """(id, cls, codes, seed, at) of texts with ``least`` words or more: word codes, a hash of these, seeds and their places.

    With ``known``, the broadcast filter, only of texts with a seed in it, and only such seeds.
    """
    long, whole = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", df.schema[ident].dataType), T.StructField("cls", T.LongType()), T.StructField("codes", whole), T.StructField("seed", long), T.StructField("at", whole)])
    gap = max(map(len, MASKS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in portions(pa.compute.utf8_length(batch.column(1)).to_pylist()):
                b = batch.slice(low, high - low)
                codes, bounds = word_codes([plain(t) for t in b.column(1).to_pylist()])
                rows = np.flatnonzero(np.diff(bounds) >= least)
                own = [codes[bounds[i] : bounds[i + 1]] for i in rows]
                if not own:
                    continue
                # all texts in one array, with a gap between them that no seed spans
                starts = np.cumsum([0] + [len(c) + gap for c in own[:-1]])
                sizes = np.array([len(c) for c in own])
                flat = np.zeros(starts[-1] + sizes[-1] + gap, np.uint32)
                for c, i in zip(own, starts, strict=True):
                    flat[i : i + len(c)] = c
                seeds, places, texts = [], [], []
                for m in MASKS:
                    h = _seeds(flat, m).view(np.int64)
                    text = np.searchsorted(starts, np.arange(len(h)), "right") - 1
                    at = np.arange(len(h)) - starts[text]
                    ok = at + len(m) <= sizes[text]
                    if known is not None:
                        ok[ok] = key_held(known.value, h[ok])
                    seeds.append(h[ok])
                    places.append(at[ok].astype(np.int32))
                    texts.append(text[ok])
                seeds, places, texts = (np.concatenate(x) for x in (seeds, places, texts))
                order = np.argsort(texts, kind="stable")
                ends = np.searchsorted(texts[order], np.arange(len(own) + 1))
                got = range(len(own)) if known is None else np.flatnonzero(np.diff(ends))
                cut = lambda x: [x[order[ends[i] : ends[i + 1]]] for i in got]  # noqa: B023, E731
                kept = [own[i] for i in got]
                if kept:
                    cls = class_hashes(np.concatenate(kept), np.concatenate(([0], np.cumsum([len(c) for c in kept]))))
                    columns = [b.column(0).take(pa.array(rows[got])), pa.array(cls), lists([c.view(np.int32) for c in kept], pa.list_(pa.int32())), *(lists(cut(x), t) for x, (_, t) in zip((seeds, places), _SEEDS, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return checkpointed(df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, schema))


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least: int = LEAST_WORDS) -> DataFrame:
    """(``doc_id``, ``item_id``, words): documents with at least ``least`` words of a passage in their order.

    Seeds of both sides are rows that are joined; a filter of bounded size keeps seeds of documents that no
    passage has from being written, and seeds that very many documents have are joined in parts. Each document is read once.
    Equality is that of ``words`` after ``plain``; single changed words are tolerated. A turn of phrase that many
    passages share is no leak: of the words in few passages enough must agree, or of the runs of six words that are in no other.
    Null and blank texts and passages of fewer words than ``least`` match nothing; repeated rows give one row;
    passages alike are counted once; empty tables give an empty one.
    """
    spark = docs.sparkSession
    held = _coded(items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{passage}`").alias("text")).distinct(), "id", "text", least)
    # equal passages are one
    own = checkpointed(held.select("cls", "codes", "seed", "at").dropDuplicates(["cls"]))
    total = own.count()
    # at most (words of a passage) / TELLING words can be in more than that share
    per_word = own.select(F.explode(F.array_distinct("codes")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    common = spark.sparkContext.broadcast(np.array([r["w"] for r in per_word.filter(F.col("n") > max(2, TELLING * total)).collect()], np.int32))
    each = own.select("cls", F.explode(F.arrays_zip("seed", "at")).alias("x")).select("x.seed", "cls", F.col("x.at").alias("p_at"))
    sized = each.groupBy("seed").agg(F.countDistinct("cls").alias("in"), F.count(F.lit(1)).alias("k"))
    # a run of words in more passages than a telling word may be in is a turn of phrase
    sized = checkpointed(sized.filter(F.col("in") <= max(2, TELLING * total)))
    each = each.join(sized.select("seed"), "seed", "left_semi")
    # places at which a run of six words begins that is in this passage only
    runs = F.expr(f"filter(arrays_zip(seed, at), (x, i) -> i < size(codes) - {len(MASKS[0]) - 1})")
    alone = own.select("cls", F.explode(runs).alias("x")).select("cls", "x.seed", "x.at").join(sized.filter(F.col("in") == 1), "seed").groupBy("cls").agg(F.collect_set("at").alias("alone"))
    known, _ = key_filter(sized.select(F.col("seed").alias("key")), sized.count())
    found = _coded(docs, doc_id, text, least, spark.sparkContext.broadcast(known))
    hits = found.select(F.col("cls").alias("d_cls"), F.explode(F.arrays_zip("seed", "at")).alias("x")).select("x.seed", "d_cls", F.col("x.at").alias("d_at"))
    # copies of a text are looked at once
    hits = hits.select("seed", "d_cls", "d_at").distinct()
    met = checkpointed(hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT))
    limit = max(HOT, (met.agg(F.sum("n")).first()[0] or 0) // HOTTEST)
    hot = F.broadcast(met.filter(F.col("n") > limit).select("seed", F.lit(PARTS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = hits.join(hot, "seed", "left").withColumn("part", F.pmod(F.xxhash64("d_cls"), parts)).drop("parts")
    right = each.join(hot, "seed", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    met = left.join(right, ["seed", "part"]).groupBy("d_cls", "cls", (F.col("d_at") - F.col("p_at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"))
    near = met.groupBy("d_cls", "cls").agg(F.collect_list("diagonal").alias("diagonals"), F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SEEDS).drop("n")
    texts = found.select(F.col("cls").alias("d_cls"), F.col("codes").alias("d_codes")).dropDuplicates(["d_cls"])
    passages = own.select("cls", "codes").join(alone, "cls", "left")
    pairs = near.join(texts, "d_cls").join(passages, "cls")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = []
            for p in b.itertuples(index=False):
                telling = ~np.isin(p.codes, common.value)
                if np.isin(p.codes, p.d_codes).sum() < least:
                    n.append(0)
                    continue
                unique = np.zeros(len(p.codes), bool)
                if p.alone is not None:
                    unique[np.asarray(p.alone, int)] = True
                n.append(overlap_words(p.codes, telling, unique, p.d_codes, list(p.diagonals)))
            n = np.array(n, np.int32)
            yield b[["d_cls", "cls"]].assign(words=n)[n >= least]

    same = checkpointed(pairs.mapInPandas(compared, "d_cls long, cls long, words int"))
    out = same.join(found.select(F.col("id").alias("doc"), F.col("cls").alias("d_cls")), "d_cls").join(held.select(F.col("id").alias("item"), "cls"), "cls")
    return out.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("words").alias("words"))
