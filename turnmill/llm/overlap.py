"""The same or nearly the same records in different splits: minwise hashes in bands, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.words import content, portions, turns, word_codes
from turnmill.session import checkpointed

#: Bands, the minwise hashes in each, and those in all, each of which is in two bands. Texts of which four fifths
#: stand in order have a Jaccard of two thirds or more over their counted words; of such pairs 0.3 % share no band.
BANDS, ROWS, HASHES = 160, 8, 640
#: Texts whose hashes are computed together.
CHUNK = 256
#: Longs of the one-bit minwise sketches, and bits in which those of a pair must agree to be compared word by word; of pairs
#: with a Jaccard of two thirds, whose bits agree with 0.83, 0.1 % have fewer.
SKETCH_LONGS, SKETCH_AGREE = 4, 195
#: Filters of the band keys of a side: bits a key, and bits in all at most. They only spare work.
KEY_BITS, FILTER_BITS = 32, 1 << 30
#: Training entries from which a bucket is hot, and the parts it is then worked in; at most ``HOTTEST`` buckets can be hot.
HOT, PARTS, HOTTEST = 2_000, 64, 1_000_000
#: Rows of the largest part of a class whose pairs are written by one task.
CLASS_ROWS = 20_000
#: Shares of the words of the longer text that must stand in the other in the same order.
SAME = 0.8

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 2**32, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = (_rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * 2 + 1).astype(np.uint64)
#: The hashes of each band: all of them in one order, then in another, and so on.
_BAND = np.concatenate([_rng.permutation(HASHES) for _ in range(-(-BANDS * ROWS // HASHES))])[: BANDS * ROWS].reshape(BANDS, ROWS)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def counted(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word with the number of its occurrence in its text: one-word shingles that keep their counts."""
    text = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.append(starts, len(codes))))
    key = text << np.uint64(32) | codes
    order = np.argsort(key, kind="stable")
    own = key[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    nth = np.empty(len(codes), np.uint32)
    nth[order] = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    return _scrambled(codes * np.uint32(0x9E3779B1) + nth * np.uint32(0x85EBCA6B))


def signatures(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x BANDS, int64) and sketches (rows x SKETCH_LONGS, int64) of non-empty word-code arrays."""
    starts = np.cumsum([0] + [len(c) for c in codes[:-1]])
    flat = counted(np.concatenate(codes), starts)
    least = np.empty((HASHES, len(codes)), np.uint32)
    for i in range(HASHES):
        least[i] = np.minimum.reduceat(flat * _A[i] + _B[i], starts)
    bands = np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        bands = (bands ^ (bands >> np.uint64(29))) + least[_BAND[:, j]] * _MIX[:, j, None]
    bands = (bands ^ (bands >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = ((_scrambled(least[: 64 * SKETCH_LONGS]) >> np.uint32(7)) & np.uint32(1)).astype(np.uint64).reshape(SKETCH_LONGS, 64, -1) << np.arange(64, dtype=np.uint64)[:, None]
    return np.ascontiguousarray(bands.T).view(np.int64), np.ascontiguousarray(bits.sum(1, dtype=np.uint64).T).view(np.int64)


def _before(bands: np.ndarray, none: int) -> np.ndarray:
    """Of each band key a byte of each of the four bands before it, ``none`` where there is none."""
    byte = (bands.view(np.uint64) >> np.uint64(32)).astype(np.uint8)
    out = np.full((*bands.shape, 4), none, np.uint8)
    for back in range(1, 5):
        out[:, back:, back - 1] = byte[:, :-back]
    # bytes can be alike by chance: now and then a common band counts whatever stands before it
    out[:, ::32] = none
    return out.reshape(len(bands), -1).view(np.int32)


def common_in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Prepared:
    """Every row with a split side and readable words by its class, and entries for each side of a class, one per task that met it."""

    #: tbl, id, split, source, is_train, cls
    rows: DataFrame
    #: tbl, is_train, cls, n, sketch, bands, before; only with the bands that an entry of the other side may have.
    entries: DataFrame
    #: tbl, cls, codes
    texts: DataFrame
    #: Bands of very many training entries.
    hot: list[int]


_ADDED = [("cls", pa.int64()), ("n", pa.int32()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())), ("before", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]
_KEPT = ("tbl", "id", "split", "source", "is_train")


def class_hashes(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each word sequence, which must not be empty."""
    n = np.diff(bounds)
    pos = (np.arange(len(codes)) - np.repeat(bounds[:-1], n) + 1).astype(np.uint64)
    each = (codes.astype(np.uint64) + np.uint64(0x9E3779B9)) * (pos * np.uint64(0xD6E8FEB86659FD93) ^ (pos << np.uint64(31)))
    return (np.add.reduceat(each, bounds[:-1]) & np.uint64(2**63 - 1)).astype(np.int64)


def lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    sizes = [0 if v is None else len(v) for v in values]
    flat = [v for v in values if v is not None]
    got = pa.array(np.concatenate(flat) if flat else [], kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), got, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))


def _probes(bands: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each band key the word of the filter and the four bits in it."""
    k = bands.view(np.uint64)
    mask = np.uint64(0)
    for shift in (40, 46, 52, 58):
        mask = mask | np.uint64(1) << (k >> np.uint64(shift) & np.uint64(63))
    return (k & np.uint64(words - 1)).astype(np.int64), mask


def key_held(words: np.ndarray, bands: np.ndarray) -> np.ndarray:
    at, mask = _probes(bands, len(words))
    return words[at] & mask == mask


def _entries(df: DataFrame, conversation: Column, known=None) -> DataFrame:
    """The rows of ``df`` that have words, with class and length, and an entry for the first of the copies in a task.

    With ``known``, the broadcast filter, an entry has only bands that the filter has, and ``before`` of those; without, all bands.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in (whole.slice(i, j - i) for whole in batches for i, j in portions(pa.compute.utf8_length(whole.column("__conversation")).to_pylist())):
            texts, sizes = [], []
            for v in b.column("__conversation").to_pylist():
                own = [content(t) for t in turns(v)]
                texts += own
                sizes.append(len(own))
            codes, bounds = word_codes(texts)
            bounds = bounds[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int64)
            rows = np.flatnonzero(np.diff(bounds))
            if not len(rows):
                continue
            bounds = np.append(bounds[rows], bounds[-1])
            each = np.split(codes, bounds[1:-1])
            cls = class_hashes(codes, bounds)
            kept = b.take(pa.array(rows)).select(_KEPT)
            fresh = []
            for j, key in enumerate(zip(kept.column("tbl").to_pylist(), cls.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(j)
            sketch, bands, before, own = ([None] * len(rows) for _ in range(4))
            # in parts whose arrays stay in the processor's cache
            for i in range(0, len(fresh), CHUNK):
                part = fresh[i : i + CHUNK]
                k, s = signatures([each[j] for j in part])
                if known is not None:
                    e, hit = _before(k, 0), key_held(known.value, k)
                for x, j in enumerate(part):
                    sketch[j], own[j] = s[x], each[j].view(np.int32)
                    if known is None:
                        bands[j] = k[x]
                    else:
                        bands[j], before[j] = k[x][hit[x]], e[x][hit[x]]
            added = [pa.array(cls), pa.array(np.diff(bounds), pa.int32()), *(lists(v, t) for v, (_, t) in zip((sketch, bands, before, own), _ADDED[2:], strict=True))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *added], [*_KEPT, *(k for k, _ in _ADDED)])

    long = T.ArrayType(T.LongType())
    schema = T.StructType([*(df.schema[c] for c in _KEPT), T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", long), T.StructField("bands", long), T.StructField("before", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.IntegerType()))])
    return checkpointed(df.select(*_KEPT, conversation.alias("__conversation")).mapInArrow(work, schema))


def key_filter(keys: DataFrame, n: int, many: int | None = None) -> tuple[np.ndarray, list[int]]:
    """The filter of ``n`` hashed ``key``: words of 64 bits, in one of which each key sets four; and the keys that more than ``many`` rows have.

    Put together by pieces in the tasks; the driver lays the pieces side by side.
    """
    bits = min(FILTER_BITS, max(1 << 20, 1 << (KEY_BITS * n).bit_length()))
    words, size = bits >> 6, 1 << 14

    def piece(own: pd.DataFrame) -> pd.DataFrame:
        k = own["key"].to_numpy(np.int64)
        at, mask = _probes(k, words)
        out = np.zeros(size, np.uint64)
        np.bitwise_or.at(out, at & (size - 1), mask)
        hot = []
        if many is not None and len(k) > many:
            each, times = np.unique(k, return_counts=True)
            hot = each[times > many].tolist()
        return pd.DataFrame({"piece": [int(at[0]) // size], "bits": [out.tobytes()], "hot": [hot]})

    low = F.col("key").bitwiseAND(F.lit(words - 1))
    out, hot = np.zeros(words, np.uint64), []
    for r in keys.groupBy(F.shiftright(low, 14)).applyInPandas(piece, "piece int, bits binary, hot array<long>").toLocalIterator():
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bits"], np.uint64)
        hot += r["hot"]
    return out, hot


def _bands_of(entries: DataFrame) -> tuple[DataFrame, int]:
    return entries.select(F.explode("bands").alias("key")), entries.agg(F.sum(F.size("bands"))).first()[0] or 0


def _only_known(entries: DataFrame, known) -> DataFrame:
    """``entries`` with those of all their bands that the broadcast filter ``known`` has, and ``before`` of those."""
    schema = T.StructType([*entries.schema, T.StructField("before", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.slice(at, CHUNK)
                k = pa.compute.list_flatten(part.column("bands")).to_numpy(zero_copy_only=False).reshape(len(part), BANDS)
                hit = key_held(known.value, k)
                ends = pa.array(np.concatenate(([0], np.cumsum(hit.sum(1)))), pa.int32())
                kept = [pa.ListArray.from_arrays(ends, pa.array(x[hit])) for x in (k, _before(k, 1))]
                rest = [c for c in part.schema.names if c != "bands"]
                got = dict(zip([*rest, "bands", "before"], [*(part.column(c) for c in rest), *kept], strict=True))
                yield pa.RecordBatch.from_arrays([got[f.name] for f in schema], [f.name for f in schema])

    return checkpointed(entries.mapInArrow(work, schema))


def prepare(df: DataFrame, conversation: Column) -> Prepared:
    """Rows and entries of ``df`` (tbl, id, split, source, is_train): first those of the evaluation side, then those of training.

    Null, broken and empty conversations, and those without a word, have no row. Each conversation is read
    once, whole; bands that no entry of the other side has are dropped as soon as that can be told.
    """
    columns = ["tbl", "is_train", "cls", "n", "sketch", "bands"]
    share = df.sparkSession.sparkContext.broadcast
    ev = _entries(df.filter(~F.col("is_train")), conversation)
    of_ev = ev.filter("bands is not null").select(columns)
    tr = _entries(df.filter("is_train"), conversation, share(key_filter(*_bands_of(of_ev))[0]))
    of_tr = tr.filter("size(bands) > 0").select(*columns, "before")
    keys, n = _bands_of(of_tr)
    known, hot = key_filter(keys, n, max(HOT, n // HOTTEST))
    entries = of_tr.unionByName(_only_known(of_ev, share(known)).filter("size(bands) > 0"))
    both = ev.unionByName(tr)
    return Prepared(both.select(*_KEPT, "cls"), entries, both.filter("size(bands) > 0").select("tbl", "cls", "codes"), hot)


def _candidates(prepared: Prepared, same: float) -> DataFrame:
    """(tbl, train_cls, eval_cls): pairs of different classes across splits with a common band, near lengths and like sketches.

    A pair comes from a band that it has in common, unless it has one of the four bands before in common too,
    told by a byte of each; every 32nd band counts in any case. A bucket with
    ``HOT`` training entries or more is worked in ``PARTS`` parts: each takes a part of its
    training entries and all its evaluation entries. Sketches are compared within that join, so
    that a hot bucket does not write out its pairs; for other buckets, which hold far more keys, they are
    compared when the pairs of classes are distinct.
    """
    entries = prepared.entries
    tr, ev = entries.filter("is_train"), entries.filter("not is_train")
    hot = prepared.hot and F.broadcast(entries.sparkSession.createDataFrame([(k,) for k in prepared.hot], "bands long"))

    def side(d: DataFrame, name: str, join_how: str, *more: str) -> DataFrame:
        x = d.select(F.explode(F.arrays_zip("bands", "before")).alias("x"), "tbl", *[F.col(c).alias(f"{name}_{c}") for c in ("cls", "n", *more)])
        x = x.select("x.bands", F.col("x.before").alias(f"{name}_before"), "*").drop("x")
        return x.join(hot, "bands", join_how) if hot else x

    first = ~F.expr(" or ".join(f"(shiftrightunsigned(train_before ^ eval_before, {8 * i}) & 255) = 0" for i in range(4)))
    near = (F.col("train_cls") != F.col("eval_cls")) & (F.least("train_n", "eval_n") >= F.greatest("train_n", "eval_n") * F.lit(same)) & first
    alike = sum(F.bit_count(F.bitwise_not(F.col("train_sketch")[i].bitwiseXOR(F.col("eval_sketch")[i]))) for i in range(SKETCH_LONGS)) >= SKETCH_AGREE
    pairs = side(tr, "train", "left_anti").join(side(ev, "eval", "left_anti"), ["bands", "tbl"]).filter(near).select("tbl", "train_cls", "eval_cls")
    # distinct where they are joined next
    pairs = pairs.repartition("tbl", "train_cls").distinct()
    for name, own in (("train", tr), ("eval", ev)):
        about = own.select("tbl", F.col("cls").alias(f"{name}_cls"), F.col("sketch").alias(f"{name}_sketch")).dropDuplicates(["tbl", f"{name}_cls"])
        pairs = pairs.join(about, ["tbl", f"{name}_cls"])
    pairs = pairs.filter(alike).select("tbl", "train_cls", "eval_cls")
    if hot:
        t = side(tr, "train", "left_semi", "sketch").withColumn("part", F.pmod(F.xxhash64("train_cls"), F.lit(PARTS)).cast("int"))
        e = side(ev, "eval", "left_semi", "sketch").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        pairs = pairs.unionByName(t.join(e, ["bands", "tbl", "part"]).filter(near & alike).select("tbl", "train_cls", "eval_cls")).distinct()
    return checkpointed(pairs)


def same_classes(prepared: Prepared, same: float = SAME) -> DataFrame:
    """(tbl, train_cls, eval_cls, share): classes of equal word sequences that are the same across splits.

    Copies bring one entry per task. Only train-against-evaluation pairs are made; those that a common band,
    length and sketch leave are compared word by word.
    """
    near = _candidates(prepared, same)
    wanted = checkpointed(near.select("tbl", F.explode(F.array("train_cls", "eval_cls")).alias("cls")).distinct())
    # a filter of bounded size spares the shuffle of all other texts
    known = wanted.sparkSession.sparkContext.broadcast(key_filter(wanted.select(F.col("cls").alias("key")), wanted.count())[0])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(key_held(known.value, b.column("cls").to_numpy())))

    held = prepared.texts.mapInArrow(kept, prepared.texts.schema)
    texts = checkpointed(held.join(wanted, ["tbl", "cls"], "left_semi").dropDuplicates(["tbl", "cls"]))
    a = texts.select("tbl", F.col("cls").alias("train_cls"), F.col("codes").alias("a"))
    b = texts.select("tbl", F.col("cls").alias("eval_cls"), F.col("codes").alias("b"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            share = np.array([common_in_order(x.tolist(), y.tolist()) / max(len(x), len(y)) for x, y in zip(p["a"], p["b"], strict=True)], float)
            yield p[["tbl", "train_cls", "eval_cls"]].assign(share=share)[share >= same - 1e-9]

    checked = near.join(a, ["tbl", "train_cls"]).join(b, ["tbl", "eval_cls"]).mapInPandas(compared, T.StructType([*near.select("tbl", "train_cls", "eval_cls").schema, T.StructField("share", T.DoubleType())]))
    equal = (
        prepared.rows.groupBy("tbl", "cls").agg(F.bool_or("is_train").alias("t"), F.bool_or(~F.col("is_train")).alias("e")).filter("t and e")
        .select("tbl", F.col("cls").alias("train_cls"), F.col("cls").alias("eval_cls"), F.lit(1.0).alias("share"))
    )
    return checked.unionByName(equal)


def cross_split_pairs(prepared: Prepared, classes: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b): all pairs of a training and an evaluation row of classes that are the same.

    The rows of a class go into lists of at most about ``CLASS_ROWS`` first, by a hash of their id. Pairs of lists
    are spread over all tasks before they are written out, so that those of a class with many rows lie in no one task.
    """
    wanted = classes.select("tbl", F.explode(F.array("train_cls", "eval_cls")).alias("cls")).distinct()
    rows = prepared.rows.select("tbl", "id", "is_train", "cls").join(wanted, ["tbl", "cls"], "left_semi")
    parts = max(1, prepared.rows.count() // CLASS_ROWS)
    lists = checkpointed(rows.groupBy("tbl", "is_train", "cls", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_set("id").alias("ids")))
    tr = lists.filter("is_train").select("tbl", F.col("cls").alias("train_cls"), F.col("ids").alias("t"))
    ev = lists.filter("not is_train").select("tbl", F.col("cls").alias("eval_cls"), F.col("ids").alias("e"))
    both = classes.select("tbl", "train_cls", "eval_cls").join(tr, ["tbl", "train_cls"]).join(ev, ["tbl", "eval_cls"]).select("tbl", "t", "e")
    spread = both.repartition(F.xxhash64("t", "e")).select("tbl", F.explode("t").alias("t"), "e").select("tbl", "t", F.explode("e").alias("e"))
    return spread.select("tbl", F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b")).distinct()


def overlap_report(prepared: Prepared, classes: DataFrame) -> DataFrame:
    """Per table, evaluation split and source: its rows, and those with the same conversation in training.

    Rows are counted by class first, so that the join sees each class once per split and source.
    """
    hit = classes.select("tbl", F.col("eval_cls").alias("cls")).distinct().withColumn("hit", F.lit(True))
    ev = prepared.rows.filter("not is_train").groupBy("tbl", "split", "source", "cls").agg(F.count(F.lit(1)).alias("n"))
    found = F.sum(F.when(F.coalesce("hit", F.lit(False)), F.col("n")).otherwise(F.lit(0)))
    return ev.join(hit, ["tbl", "cls"], "left").groupBy("tbl", "split", "source").agg(F.sum("n").alias("rows"), found.alias("overlapping"))


def set_bits(at: DataFrame, bits: int) -> np.ndarray:
    """Packed bits, a power of two from 2^20 on, of which those at the positions ``at`` are set, put together by pieces in the tasks."""

    def piece(pos: pd.DataFrame) -> pd.DataFrame:
        b = np.zeros(1 << 20, bool)
        b[pos["low"].to_numpy()] = True
        return pd.DataFrame({"piece": [pos["piece"].iat[0]], "bits": [np.packbits(b).tobytes()]})

    parts = at.select(F.shiftright("at", 20).cast("int").alias("piece"), F.col("at").bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("low")).groupBy("piece").applyInPandas(piece, "piece int, bits binary")
    out = np.zeros(bits >> 3, np.uint8)
    for r in parts.toLocalIterator():
        out[r["piece"] << 17 : (r["piece"] + 1) << 17] = np.frombuffer(r["bits"], np.uint8)
    return out
