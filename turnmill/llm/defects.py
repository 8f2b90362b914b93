"""Prompt and response pairs with a defective response: empty, refusal, copied, truncated, other language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.overlap import common_in_order, set_bits
from turnmill.llm.words import content, portions, token_kinds, turns, word_codes, words
from turnmill.session import checkpointed

#: Labelled texts per language that the language model is fitted on at most.
SAMPLE_PER_LANGUAGE = 1_500
#: Bits of the filter of the wanted endings.
FILTER_BITS = 1 << 27
ORDERS = (1, 2, 3)
#: Buckets of the hashed character n-grams.
BUCKETS = 1 << 16
#: Log odds per n-gram, and in all, from which question and answer count as being in different languages.
ODDS, SURE = 0.12, 40.0
#: An unpunctuated ending less likely than this is a truncation.
ENDING = 0.15
#: A refusal of so many words is one whatever stands beside it; in a longer one at most so many other words, or this share.
SHORT, BESIDE, BESIDE_SHARE = 25, 12, 1 / 3
#: End rate of a single word below which it ends nothing.
NEVER = 0.02
#: Weight of the shorter ending against the counts of the longer.
PRIOR = 8
#: Longer words that begin as the last word does, for each time that it stands elsewhere, from which it is a piece of one.
PIECES = 50
#: Words that the language scores of a task remember.
MEMO = 300_000

_INVISIBLE = re.compile("[\\s­ᅟᅠ᠎​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿\x00-\x1f\x7f-\x9f]+")
_REMOVED = re.compile(r"\W*(?:(?:comment |post |content |this |message )*(?:has been |was )?(?:removed|deleted|redacted|gel[öo]scht|entfernt|eliminado|borrado|supprimé|removido|apagado|удалено)(?: by (?:the )?(?:user|author|moderators?|mods?|reddit))?)\W*", re.I)
_HIDDEN = re.compile("[­ᅟᅠ᠎​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿\x00-\x08\x0e-\x1f\x7f-\x9f]")
#: Openings of refusals (fixed values), matched on words without apostrophes.
REFUSALS = re.compile(
    r"\b(?:as an? (?:ai|artificial)\b|as an? (?:large )?language model|i (?:cannot|cant|can not|am unable to|am not able to|wont be able to|will not be able to|must decline to|have to decline|refuse to) "
    r"(?:assist|help(?! but)|answer|comment|provide|respond|discuss|fulfill|comply|do that|continue)\b|i(?:d| would) (?:rather|prefer) not (?:to )?(?:get into|answer|discuss|say|engage|talk|comment|respond|help)|my guidelines (?:dont|do not)|(?:not something|nothing) im allowed to|"
    r"i(?:m| am) (?:sorry|afraid)[a-z ,]{0,12} i (?:cant|cannot|wont|am not able|am unable)[a-z ]{0,12}(?:help|assist|answer|provide|discuss|share)|sorry i (?:wont|cant|cannot) (?:be able to )?(?:help|assist|provide|answer|discuss|share|do that)|"
    r"i cant answer that|its against (?:my )?policy|outside of what i can (?:talk|speak|discuss)|i(?:m| am) not (?:allowed|permitted|able) to (?:answer|discuss|talk|help|respond)|"
    r"(?:no me está permitido|lo siento (?:pero )?no puedo (?:ayud|respond|contest)|no puedo (?:ayudarte|responder|contestar)|como modelo de lenguaje)|"
    r"(?:como modelo de linguagem|desculpe (?:mas )?não posso|não posso (?:ajudar|responder)|não (?:me é permitido|tenho permissão)|não estou autorizad)|"
    r"(?:als ki\b|als sprachmodell|als ki sprachmodell|dazu kann ich (?:leider )?keine|(?:es )?tut mir leid (?:aber )?(?:dabei|da|damit|das) kann ich|dabei kann ich nicht helfen|darf ich (?:diese frage )?nicht)|"
    r"(?:en tant que modèle|en tant qu ?ia|je ne suis pas autorisée?|désolée? (?:mais )?je ne (?:peux|puis)|je ne peux pas (?:vous |t)?(?:aider|répondre))|"
    r"(?:как языковая модель|извините но я не могу|простите но я не могу|я не могу (?:с этим помочь|ответить|помочь|обсуждать)|мне (?:нельзя|не разрешено|запрещено)))",
    re.I,
)
#: One of these stands in every text that ``REFUSALS`` matches (fixed values).
_TRIGGERS = (
    "cannot", "can not", "can't", "can’t", "cant ", "unable", "not able", "wont", "won't", "won’t", "will not", "decline", "refuse", "rather not", "prefer not", "guidelines", "allowed", "permitted", "sorry", "afraid", "against", "outside of what", "as an ai", "as a ai", "artificial", "language model",
    "permitido", "siento", "puedo", "modelo de l", "desculpe", "posso", "permissão", "autoriza", "als ki", "sprachmodell", "dazu kann", "tut mir leid", "dabei kann", "darf ich", "modèle", "en tant", "je ne ", "désolé", "языковая", "извините", "простите", "не могу", "нельзя", "разрешено", "запрещено",
)
_SENTENCE = re.compile(r"[.!?…\n]+")
_CONTRAST = re.compile(r"\b(?:but|however|although|instead|pero|aber|jedoch|mais|cependant|mas|porém|но|однако)\b")
_QUOTED = re.compile(r"(?m)^[ \t]*>.*$|```.*?```|“[^”]{15,}”|«[^»]{15,}»|\"[^\"\n]{15,}\"|„[^“”]{15,}[“”]", re.S)
_QUOTES = re.compile("[>`“«\"„]")
_QUOTED_LINE = re.compile(r"(?m)^[ \t]*>.*$")
_URL = re.compile(r"https?://\S+|www\.\S+")
_LETTERS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"(?:[.!?…。！？؟]+[\"'”’»«)\]*_`~]*|[)\]}>|`»”])$")
#: What may close a text beside words and signs of syntax; emoji above all.
_ORNAMENT = re.compile(r"[^\w\s.!?…。！？؟\"'”’»«)(\]\[}{*_`~|<>,;:/\\&“„–—-]")
_TOP = re.compile(r"https?://[^/\s]+\.(?:[a-z]{2}|com|org|net|edu|gov|info|dev|app|wiki|blog)(?=[/:?#]|$)", re.I)
_SARCASM = re.compile(r"/s\b")

_PLACE = np.random.default_rng(57).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD, _SILVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(word: str) -> np.ndarray:
    """Hashed character n-grams of a lower-case word with its ends."""
    a = np.frombuffer(f" {word} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        if len(a) >= n:
            h = np.zeros(len(a) - n + 1, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) + a[i : len(a) - n + 1 + i] * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            out.append((h + np.uint32(n * 7919)) & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    #: All texts (column text) whose endings count; they stay on the cluster.
    texts: DataFrame | None

    def ending(self, toks: list[str]) -> float:
        """Likelihood that a text ends after these words; reads all texts."""
        g = tails([" ".join(toks)])[0]
        rows = self.texts.sparkSession.createDataFrame([tuple(None if x is None else int(x) for x in g)], "g1 long, g2 long, g3 long")
        return with_ending(rows, self.texts).first()["p"]


class Scores:
    """Log likelihoods of texts by language: a sum over words, whose scores a task remembers."""

    def __init__(self, model: Model):
        self.weights = model.weights
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages) + 1))

    def _new(self, w: str) -> int:
        i = self.at[w] = len(self.at)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        g = grams(w)
        self.table[i, :-1], self.table[i, -1] = self.weights[:, g].sum(1), len(g)
        return i

    def text(self, t: str) -> np.ndarray:
        """The log likelihood of each language, and the n-grams."""
        at = self.at
        found = _LETTERS.findall(t.lower())
        if len(at) + len(found) > MEMO:
            at.clear()
        rows = [at[w] if w in at else self._new(w) for w in found]
        return self.table[rows].sum(0) if rows else np.zeros(self.table.shape[1])


def differ(answer: np.ndarray, question: np.ndarray) -> bool:
    """Whether two texts are in different languages, each clearly by its own likelihoods."""
    la, lq = int(np.argmax(answer[:-1])), int(np.argmax(question[:-1]))
    if la == lq:
        return False
    a, q = answer[la] - answer[lq], question[lq] - question[la]
    return a >= max(SURE, ODDS * answer[-1]) and q >= max(SURE, ODDS * question[-1])


@dataclass
class Tokens:
    """The tokens of all texts of a batch: hash, number of the text, whether something ends after it, and whether only blanks follow."""

    hash: np.ndarray
    text: np.ndarray
    end: np.ndarray
    last: np.ndarray
    #: Hashes of all shorter beginnings of the tokens.
    begun: np.ndarray


def _finished(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * _SILVER).view(np.int64)


def tokens(texts: list[str]) -> Tokens:
    """The tokens of texts.

    Tokens are runs of letters and digits with single apostrophes or hyphens inside, in lower case. After a
    token ends what is followed by a full stop or the like, a line break, the end of the text, or only ornaments up to there.
    """
    own = [(_SARCASM.sub(" sarcasmmark", t) if "/s" in t else t).lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in own])
    points = np.frombuffer("\n".join([*own, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    points = np.where(points == 0x2019, np.uint32(0x27), points)
    kind = token_kinds(points)
    word = kind & 1 == 1
    joint = (points == 0x27) | (points == 0x2D)
    joint[1:-1] &= word[:-2] & word[2:]
    if n:
        joint[[0, -1]] = False
    inside = word | joint
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return Tokens(*(np.empty(0, t) for t in (np.int64, np.int64, bool, bool, np.int64)))
    at = np.flatnonzero(inside)
    long = after - first
    start = np.cumsum(long) - long
    place = np.arange(len(at)) - np.repeat(start, long)
    run = np.cumsum((points[at].astype(np.uint64) + _GOLD) * _PLACE[place & 4095])
    run -= np.repeat(np.concatenate(([np.uint64(0)], run[start[1:] - 1])), long)
    h = _finished(run)
    whole = start + long - 1
    shorter = np.ones(len(h), bool)
    shorter[whole] = False
    ends = np.cumsum(sizes)
    text = np.searchsorted(ends, first, "right")
    # the next character that is no blank, and whether a line break comes before it; texts end on one
    blank = kind & 2 == 2
    solid = np.where(blank, n, np.arange(n))
    solid = np.append(np.minimum.accumulate(solid[::-1])[::-1], n)
    line = np.concatenate(([0], np.cumsum(points == 0x0A)))
    to = solid[after]
    stop = np.append((kind & 4 == 4), True)
    # behind the last character of a text that is neither blank nor ornament
    plain = ~blank & (kind & 8 == 0)
    last = np.maximum.accumulate(np.where(plain, np.arange(n), -1))
    closed = after > last[ends - 1][text]
    end = stop[to] | (line[to] > line[after]) | closed
    return Tokens(h[whole], text, end, to > ends[text] - 1, h[shorter])


def ngrams(t: Tokens) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three tokens: hash, and whether it lies within one text, of the run that ends at each token."""
    h, text = t.hash, t.text
    u = h.view(np.uint64)
    mix = lambda x: (x ^ (x >> np.uint64(31))) * _GOLD
    out = [(h, np.ones(len(h), bool))]
    two, three = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    two[1:] = mix(u[:-1] * _GOLD + u[1:])
    three[2:] = mix(u[:-2] * _SILVER + two[2:])
    for n, g in ((1, two), (2, three)):
        same = np.zeros(len(h), bool)
        same[n:] = text[n:] == text[: len(text) - n]
        out.append((g.view(np.int64), same))
    return out


def tails(texts: list[str]) -> list[list[np.int64 | None]]:
    """Hashes of the last token of each text, the last two and the last three; None where it has fewer."""
    t = tokens(texts)
    at = np.searchsorted(t.text, np.arange(len(texts)), "right") - 1
    runs = ngrams(t)
    return [[g[j] if j >= 0 and t.text[j] == i and ok[j] else None for g, ok in runs] for i, j in enumerate(at)]


#: Of each run of tokens: its number, ends after it, times that more follows, and longer words that begin so.
_COUNTS = ("k", "e", "m", "x")


def with_ending(rows: DataFrame, texts: DataFrame, own: int = 0) -> DataFrame:
    """``rows`` (g1, g2, g3: ``tails``) with p, the likelihood of an end there: three words, backed off to two and one.

    A last word that hardly ever ends anything decides alone: cut texts may end alike. Counted over all
    different texts: copies are no evidence of their own, nor is what occurs only once. ``own`` is 1 where the
    rows are ends of some of the texts, as no end is evidence for itself. A last word that hardly stands anywhere but at
    such ends, while ``PIECES`` times as many longer words begin so, is a piece of a word: there ends nothing, however
    many texts were cut at the same place. Only wanted endings
    are counted, by a filter of bounded size, and they are joined on the cluster.
    """
    wanted = rows.select(F.explode(F.array("g1", "g2", "g3")).alias("g")).filter("g is not null").distinct()
    known = rows.sparkSession.sparkContext.broadcast(set_bits(wanted.select(F.col("g").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at")), FILTER_BITS))

    def endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = known.value

        def wanted_only(g: np.ndarray) -> np.ndarray:
            k = g & np.int64(FILTER_BITS - 1)
            return (bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 == 1

        for texts in (b["text"].iloc[i:j].tolist() for b in batches for i, j in portions(b["text"].str.len())):
            t = tokens(texts)
            gs, flags = [], []
            for g, ok in ngrams(t):
                ok &= wanted_only(g)
                gs.append(g[ok])
                # counted once, ends, stands where more follows, longer words
                flags.append(np.stack([np.ones(ok.sum(), np.int64), t.end[ok], ~t.last[ok], np.zeros(ok.sum(), np.int64)]))
            begun = t.begun[wanted_only(t.begun)]
            gs.append(begun)
            flags.append(np.repeat(np.array([[0], [0], [0], [1]]), len(begun), 1))
            own, at = np.unique(np.concatenate(gs), return_inverse=True)
            flags = np.concatenate(flags, 1)
            yield pd.DataFrame({"g": own} | {c: np.bincount(at, flags[i], len(own)).astype(np.int64) for i, c in enumerate(_COUNTS)})

    each = texts.filter("text is not null").select("text").distinct().mapInPandas(endings, "g long, " + ", ".join(f"{c} long" for c in _COUNTS))
    counts = checkpointed(each.groupBy("g").agg(*[F.sum(c).alias(c) for c in _COUNTS]).filter("k + x > 1"))
    p = F.lit(0.03)
    for n in (1, 2, 3):
        rows = rows.join(counts.select(*[F.col(c).alias(f"{c}{n}") for c in ("g", *_COUNTS)]), f"g{n}", "left")
        e, k = (F.greatest(F.coalesce(f"{x}{n}", F.lit(0)) - own, F.lit(0)) for x in "ek")
        longer = (e + PRIOR * p) / (k + PRIOR)
        p = F.when(F.col(f"g{n}").isNull(), p).otherwise(longer)
        if n == 1:
            first = p
    piece = F.coalesce((F.col("x1") > 1) & (F.col("m1") * PIECES <= F.col("x1")), F.lit(False))
    return rows.withColumn("p", F.when(piece, F.lit(0.0)).when(first < NEVER, first).otherwise(p)).drop(*(f"{c}{n}" for c in ("g", *_COUNTS) for n in (1, 2, 3)))


def _thinned(df: DataFrame, key: Column, share: float | Column) -> DataFrame:
    """About ``share`` of the rows by the hash of ``key``; the same ones on every run."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(1 << 30) * share)


def fit(labelled: DataFrame, texts: DataFrame) -> Model:
    """The language model, from at most ``SAMPLE_PER_LANGUAGE`` different rows (text, lang) a language, and the texts of the endings.

    ``texts`` has an array ``texts`` per row. The labelled sample is drawn by hash: numbers of different texts
    come first, a hash threshold then thins the table while it is scanned to a few times the bound, and only
    that remainder is ranked. Counting is done in the tasks; what reaches the driver is bounded by the sample.
    Naive Bayes over character n-grams with equal priors is robust to the few per cent of wrong labels.
    """
    from pyspark.sql.window import Window

    named = labelled.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 4 * SAMPLE_PER_LANGUAGE / n))]), F.col("lang")), F.lit(0.0)) if sizes else F.lit(0.0)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    sample = _thinned(named, F.col("text"), share).select("lang", "text").distinct().withColumn("r", rank).filter(F.col("r") <= SAMPLE_PER_LANGUAGE).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, t in zip(b["lang"], b["text"], strict=True):
                seen.setdefault(lang, Counter()).update(_LETTERS.findall(t.lower()))
        tot = {}
        for lang, ws in seen.items():
            tot[lang] = np.zeros(BUCKETS, np.int64)
            for w, n in ws.items():
                np.add.at(tot[lang], grams(w), n)
        yield pd.DataFrame({"lang": list(tot), "n": [c.tolist() for c in tot.values()]})

    rows = sample.coalesce(8).mapInPandas(count, "lang string, n array<long>").toLocalIterator()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.array(r["n"], float)
    langs = sorted(k for k in counts if counts[k].sum() > 0)
    weights = np.stack([np.log((counts[k] + 0.5) / (counts[k].sum() + 0.5 * BUCKETS)) for k in langs]) if langs else np.zeros((0, BUCKETS))

    return Model(langs, weights.astype(np.float32), texts.select(F.explode("texts").alias("text")))


def refuses(answer: str) -> bool:
    """Whether an answer refuses and holds little else: words of sentences without a refusal, and after a contrast."""
    low = answer.lower()
    if not any(t in low for t in _TRIGGERS):
        return False
    own = _QUOTED_LINE.sub(" ", answer)
    w = words(own)
    found = REFUSALS.search(" ".join(w))
    if not found or len(w) <= SHORT:
        return found is not None
    beside, within = 0, False
    for s in _SENTENCE.split(own):
        sw = " ".join(words(s))
        if m := REFUSALS.search(sw):
            within = True
            but = _CONTRAST.search(sw, m.end())
            beside += len(sw[but.end() :].split()) if but else 0
        else:
            beside += len(sw.split())
    return (beside if within else len(w) - len(found[0].split())) <= max(BESIDE, BESIDE_SHARE * len(w))


def copies(q: np.ndarray, a: np.ndarray) -> bool:
    """Whether an answer (word codes) repeats the question; what else it has must be no substance: a lead-in, a masked word, a cut end."""
    if len(q) < 3 or len(a) < 3:
        return len(q) > 0 and np.array_equal(q, a)
    spare = max(3, 0.15 * len(q))
    if not 0.8 * len(q) <= len(a) <= len(q) + spare:
        return False
    q, a = q.tolist(), a.tolist()
    if len(set(a) - set(q)) > 0.34 * len(a) + 2:
        return False
    n = common_in_order(q, a)
    return n >= 0.8 * len(q) and len(a) - n <= spare


def defect(model: Model, question: str | None, answer: str | None, code=None) -> str | None:
    """The defect of one answer, or None."""
    got, end = judged(Scores(model), question, answer)
    return got if end is None else "truncated" if with_tail(model, end) < ENDING else None


def with_tail(model: Model, end: str) -> float:
    g = tails([end])[0]
    rows = model.texts.sparkSession.createDataFrame([tuple(None if x is None else int(x) for x in g)], "g1 long, g2 long, g3 long")
    return with_ending(rows, model.texts).first()["p"]


def judged(scores: Scores, question: str | None, answer: str | None, coded: tuple[np.ndarray, np.ndarray] | None = None, of: np.ndarray | None = None) -> tuple[str | None, str | None]:
    """The defect of one answer, or None; and its last words where these must decide whether it is truncated.

    ``coded`` has the word codes of question and answer, ``of`` the language scores of the question, where they are known.
    """
    if answer is None:
        return "empty", None
    shown = _INVISIBLE.sub(" ", answer).strip() if _HIDDEN.search(answer) else answer.strip()
    if not shown or _REMOVED.fullmatch(shown):
        return "empty", None
    if refuses(answer):
        return "refusal", None
    if question:
        if coded is None:
            codes, at = word_codes([question, answer])
            coded = codes[: at[1]], codes[at[1] :]
        if copies(*coded):
            return "copied_question", None
        if len(scores.table[0]) > 2:
            bare = _QUOTED.sub(" ", answer) if _QUOTES.search(answer) else answer
            own = scores.text(_URL.sub(" ", bare))
            if differ(own, scores.text(_URL.sub(" ", question)) if of is None else of):
                return "other_language", None
    end = answer.rstrip()
    while end and _ORNAMENT.match(end[-1]):
        end = end[:-1].rstrip()
    if end and not _END.search(end[-64:]) and not _END.search(end):
        line = end.rsplit("\n", 1)[-1].lstrip()
        left = end.rsplit("(", 1)
        opened = len(left) == 2 and ")" not in left[1] and not re.search(r"[.!?…]\s", left[1])
        if end[-1] in ",;:(-–—\\&«“„[{" or line[:1] in ("|", "{", "[") or end.count("```") % 2 or opened:
            return "truncated", None
        last = end.rsplit(None, 1)[-1]
        if (url := _URL.search(last)) and url.end() == len(last):
            return (None if _TOP.match(url[0]) else "truncated"), None
        return None, " ".join(end.rsplit(None, 4)[-4:])
    return None, None


def find_defects(pairs: DataFrame, model: Model, ident: str, fork: str, branches: dict[str, str]) -> DataFrame:
    """(``ident``, branch, defect) of every defective branch; at most one defect each.

    The question is the last turn of ``fork``, the answer the first turn of the branch. A null or unreadable
    branch, one without turns and one with nothing visible are empty. A pair without a question can only be
    empty, a refusal or truncated. The language model travels as a broadcast of bounded size; answers that their last words
    must decide about, which must be among the model's texts, are written to the shared folder and joined with the counts of endings.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(replace(model, texts=None))
    names = list(branches)
    ends = ["g1", "g2", "g3"]
    schema = T.StructType([T.StructField(ident, pairs.schema[ident].dataType), *(T.StructField(c, T.StringType()) for c in ("branch", "defect")), *(T.StructField(c, T.LongType()) for c in ends)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for b in (whole.slice(i, j - i) for whole in batches for i, j in portions(sum(len(x or "") for x in r) for r in zip(*(whole.column(k).to_pylist() for k in range(1, 2 + len(names))), strict=True))):
            forks, answers = b.column(1).to_pylist(), [b.column(2 + k).to_pylist() for k in range(len(names))]
            asked = [content(f[-1]) if (f := turns(v)) else None for v in forks]
            said = [[content(t[0]) if (t := turns(v)) else None for v in own] for own in answers]
            codes, at = word_codes([t or "" for part in (asked, *said) for t in part])
            coded, n = np.split(codes, at[1:-1]), len(asked)
            rows, kind, defects, last = [], [], [], []
            for i, q in enumerate(asked):
                of = scores.text(_URL.sub(" ", q)) if q else None
                for k, name in enumerate(names):
                    got, end = judged(scores, q, said[k][i], (coded[i], coded[(k + 1) * n + i]), of)
                    if got or end is not None:
                        rows.append(i)
                        kind.append(name)
                        defects.append(got)
                        last.append(end or "")
            g = [[None if x is None or d else int(x) for x in t] for t, d in zip(tails(last), defects, strict=True)]
            own = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(kind, pa.string()), pa.array(defects, pa.string()), *(pa.array([t[j] for t in g], pa.int64()) for j in range(3))]
            yield pa.RecordBatch.from_arrays(own, [ident, "branch", "defect", *ends])

    found = checkpointed(pairs.select(ident, fork, *branches.values()).mapInArrow(judge, schema))
    cut = with_ending(found.filter("defect is null").drop("defect"), model.texts, own=1).filter(F.col("p") < ENDING)
    return found.filter("defect is not null").drop(*ends).unionByName(cut.select(ident, "branch", F.lit("truncated").alias("defect")))
