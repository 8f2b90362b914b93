"""Abusive, hateful and sexual content by the nearest labelled examples: exact TF-IDF cosine, block-max pruned."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.phrases import examples as general_phrases
from turnmill.llm.words import content, turns

#: Labelled examples that are read at most; more raise an error.
MAX_EXAMPLES = 50_000
NEIGHBOURS = 5
#: Entries per block of the index.
BLOCK = 16
#: A record is affected from this score on.
AFFECTED = 0.5
#: Least share of the turns of a language that a word counts as being in, and that of a word that no entry has.
RAREST, UNKNOWN = 1e-4, 1e-3
#: Turns added to those of a language, so that few turns say little about its words.
MORE_TURNS = 100
#: Weight of a pair of words against the mean of both.
PAIR = 0.6
#: Cosine below which an example is no neighbour.
NEAR = 0.3
#: Words of the overlapping windows in which a longer sentence is looked up besides, and the steps between them.
WINDOWS = ((4, 1), (8, 4))
#: Words from which a sentence is long: its nearest entry must be as near as that of a window.
LONG = 8
#: Cosine from which the nearest example of a window counts: one word among others that ordinary examples have too is not enough.
NEAR_WINDOW = 0.5

#: Weight from which a word tells something, and a pair of words. A positive entry is a neighbour only if two such words
#: agree, or such a pair, or a listed term that no ordinary example has.
TELLING, TELLING_PAIR = 2.0, 1.5

_SENTENCE = re.compile(r"[.!?…\n]+(?:\s|$)|\n+")
_TOKEN = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_]+[*#%][^\W\d_*#%]*(?:[*#%][^\W\d_]*)*")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]{1,2}){3,}[^\W\d_](?![^\W_])")
_REPEAT = re.compile(r"(.)\1+")
_LEET = str.maketrans("013457", "oieast")
_SIGNS = re.compile(r"(?<=[^\W\d_])[@$]|[@$](?=[^\W\d_])")
#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKS = str.maketrans("аеорсухіјѕһԁԛԝουαετικνρχ", "aeopcyxijshdqwouaetiknpx")
_LATIN, _OTHER = re.compile(r"[a-z]"), re.compile(r"[Ͱ-ӿ]")
_GONE = re.compile("[\xad\u200b-\u200d\u2060\ufeff\u2019\u02bc]+")


def folded(word: str) -> str:
    """A lower-case word without disguises: look-alike letters, digits for letters, repeated letters."""
    if not word.isascii() and _OTHER.search(word):
        latin = word.translate(_LOOKS)
        if _LATIN.search(word) or not _OTHER.search(latin):
            word = latin
    if not word.isalpha() and not word.isdigit() and sum(map(str.isdigit, word)) <= len(word) / 2:
        word = word.translate(_LEET)
    return _REPEAT.sub(r"\1", word)


def plain(text: str) -> str:
    """Lower case without apostrophes, invisible characters and signs for letters."""
    text = text.replace("'", "")
    if not text.isascii():
        text = _GONE.sub("", text.replace("’", ""))
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text.lower()


def _together(text: str) -> str:
    return _SPACED.sub(lambda m: " " + re.sub(r"[ .\-_*]", "", m[0]) + " ", text)


def tokens(sentence: str) -> list[str]:
    """Folded words of a plain sentence; letters written apart are one word."""
    raw = _TOKEN.findall(sentence)
    if sum(len(w) == 1 for w in raw) > 3:
        raw = _TOKEN.findall(_together(sentence))
    return [folded(w) for w in raw]


def sentences(text: str) -> list[str]:
    return [x for x in _SENTENCE.split(plain(text)) if x and not x.isspace()]


def spans(n: int) -> list[tuple[int, int]]:
    """Ends of the windows of a sentence of ``n`` words, the last one at its end; none that is the whole sentence."""
    return [(min(i, n - size), min(i, n - size) + size) for size, step in WINDOWS if n > size for i in range(0, n - size + step, step)]


def clauses(toks: list[str]) -> list[list[str]]:
    """A sentence and its windows."""
    return [toks, *(toks[i:j] for i, j in spans(len(toks)))]


def _features(toks: list[str]) -> Counter:
    return Counter(toks) + Counter(f"{a} {b}" for a, b in zip(toks, toks[1:], strict=False))


@dataclass
class Index:
    """Entries (sentences of examples, and terms) by block, with the largest weight of each feature per block."""

    labels: list[str]
    ids: list
    #: By language, and under "" for texts of none of these: the weights of words and pairs.
    idf: dict[str, dict[str, float]]
    unseen: float
    postings: dict[str, tuple[list[int], list[float]]]
    #: Per feature the blocks that it is in, and its largest weight in each.
    block_max: dict[str, tuple[np.ndarray, np.ndarray]]
    reach: dict[str, float]
    words: dict[int, list[str]]
    pair_reach: dict[str, list[str]]
    scale: tuple[float, float] = (8.0, -4.0)
    positive: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    #: The features of each positive entry, and listed terms of one word.
    held: list[frozenset[str]] = field(default_factory=list)
    listed: frozenset[str] = frozenset()
    #: The same entries, and beside them the windows of sentences of label none; windows are looked up there.
    windows: Index | None = None

    @property
    def last_positive(self) -> int:
        """Positive entries stand first."""
        return max(0, int(self.positive.sum()) - 1)

    def unmask(self, text: str) -> str:
        """Words with masked letters as the indexed word of the same length that fits, if there is one."""

        def one(m: re.Match) -> str:
            rx = re.compile("".join("." if c in "*#%" else re.escape(c) for c in m[0]))
            return next((w for w in self.words.get(len(m[0]), ()) if rx.fullmatch(w)), m[0])

        return _MASKED.sub(one, text)

    def neighbours(self, toks: list[str], k: int = NEIGHBOURS, without=None, lang: str | None = "") -> list[tuple[float, int]]:
        """The ``k`` nearest entries with a cosine of ``NEAR`` or more, exactly.

        Nothing is looked up where even the sum of the largest weights of any positive entry stays below
        ``NEAR``. Else blocks are visited by their bound until no further one can hold a nearer entry.
        """
        q = _features(toks)
        norm = bound = 0.0
        weights = {}
        idf = self.idf.get(lang) or self.idf[""]
        for f, n in q.items():
            w = idf.get(f)
            if w is None:
                norm += (n * self.unseen) ** 2 if " " not in f else 0.0
                continue
            v = n * w
            norm += v * v
            weights[f] = v
            bound += v * self.reach.get(f, 0.0)
        norm = math.sqrt(norm)
        if not norm or bound < NEAR * norm:
            return []
        bounds = np.zeros(max(1, -(-len(self.ids) // BLOCK)))
        for f, v in weights.items():
            at, most = self.block_max[f]
            bounds[at] += v * most
        if bounds[: self.last_positive // BLOCK + 1].max() < NEAR * norm:
            return []
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds):
            least = best[-1][0] if len(best) == k else NEAR
            if bounds[b] < least * norm:
                break
            dots: dict[int, float] = defaultdict(float)
            lo, hi = b * BLOCK, (b + 1) * BLOCK
            for f, v in weights.items():
                e, w = self.postings[f]
                i, j = bisect_left(e, lo), bisect_left(e, hi)
                for x, y in zip(e[i:j], w[i:j], strict=True):
                    dots[x] += v * y
            best += [(d / norm, x) for x, d in dots.items() if d >= NEAR * norm and (without is None or self.ids[x] != without) and (x >= len(self.held) or self._agree(weights, x))]
            best = sorted(best, key=lambda t: (-t[0], t[1]))[:k]
        return best

    def _agree(self, weights: dict[str, float], x: int) -> bool:
        own = [f for f in self.held[x] if f in weights]
        return any(weights[f] >= TELLING_PAIR if " " in f else f in self.listed for f in own) or sum(weights[f] >= TELLING for f in own if " " not in f) > 1

    def vote(self, near: list[tuple[float, int]]) -> tuple[float, str, int]:
        """(score, label, entry) from neighbours weighted by closeness; 0, none where there is none."""
        if not near:
            return 0.0, "none", -1
        by: dict[str, float] = defaultdict(float)
        for s, x in near:
            by[self.labels[x]] += s**4
        total = sum(by.values())
        bad = {k: v for k, v in by.items() if k != "none"}
        if not bad:
            return 0.0, "none", -1
        label = max(bad, key=lambda k: (bad[k], k))
        # sharply closer neighbours decide; the nearest one's cosine tells how sure that is
        margin = (sum(bad.values()) / total) * min(1.0, max(s for s, x in near if self.positive[x]) / 0.5)
        a, b = self.scale
        return 1 / (1 + math.exp(-(a * margin + b))), label, next(x for s, x in near if self.labels[x] == label)

    def window_vote(self, toks: list[str], lang: str | None = "") -> tuple[float, str, int]:
        """The vote of a window, which needs a neighbour within ``NEAR_WINDOW``; the entry is that of this index."""
        near = self.windows.neighbours(toks, lang=lang) if self.windows else []
        if not near or near[0][0] < NEAR_WINDOW:
            return 0.0, "none", -1
        self.windows.scale = self.scale
        return self.windows.vote(near)

    def score(self, text: str, memo: dict, lang: str | None = "") -> tuple[float, str, int]:
        """Of the worst sentence of a text in a language. ``memo`` keeps the words of a task.

        A sentence is looked up whole and by windows, so that the words around a clause do not lower its
        cosine; each only if enough of its words and word pairs tell something and are in positive entries, and the largest
        weights that they have in any of these could reach the least cosine.
        """
        worst = (0.0, "none", -1)
        lang = lang if lang in self.idf else ""
        idf, memo = self.idf[lang], memo.setdefault(lang, {})
        text = plain(text)
        if "*" in text or "#" in text or "%" in text:
            text = self.unmask(text)
        for s in _SENTENCE.split(text):
            found = _TOKEN.findall(s)
            if not found:
                continue
            got = []
            for w in found:
                g = memo.get(w)
                if g is None:
                    if len(memo) > 300_000:
                        memo.clear()
                    g = memo[w] = self._about(w, idf)
                got.append(g)
            single = len(found) > 3 and sum(g[4] for g in got) > 3
            if single:
                ws = tokens(s)
                parts = clauses(ws)
            else:
                # what tells something: most sentences have too little of it
                if sum(g[5] for g in got) < 2 and not any(g[6] and h[2] in g[6] for g, h in zip(got, got[1:], strict=False)):
                    continue
                ws = [g[2] for g in got]
                near = [g[3].get(w) if g[3] else None for g, w in zip(got, ws[1:], strict=False)]
                bounds, squares, told = [0.0], [0.0], [0]
                for g, p in zip(got, [None, *near], strict=True):
                    bounds.append(bounds[-1] + g[1] + (p[0] if p else 0.0))
                    squares.append(squares[-1] + g[0])
                    told.append(told[-1] + g[5] + (p[1] if p else 0))
                least = NEAR if len(ws) <= LONG else NEAR_WINDOW
                parts = [ws] if bounds[-1] ** 2 >= least * least * squares[-1] else []
                for i, j in spans(len(ws)) if len(ws) > WINDOWS[0][0] else ():
                    if told[j] - told[i] > 1 and (bounds[j] - bounds[i]) ** 2 >= NEAR_WINDOW * NEAR_WINDOW * (squares[j] - squares[i]):
                        parts.append(ws[i:j])
            for part in parts:
                key = " ".join(part), len(part) < len(ws)
                vote = memo.get(key)
                if vote is None:
                    if key[1]:
                        vote = self.window_vote(part, lang)
                    else:
                        best = self.neighbours(part, lang=lang)
                        vote = self.vote(best) if best and best[0][0] >= (NEAR if len(ws) <= LONG else NEAR_WINDOW) else (0.0, "none", -1)
                    memo[key] = vote
                if vote[0] > worst[0]:
                    worst = vote
        return worst

    def _about(self, w: str, idf: dict[str, float]) -> tuple:
        """Of a word: square, bound, folded, the bound and 2 for telling of its pairs, whether it is one letter, 2 or 1 for telling, telling pairs."""
        f = folded(w)
        v = idf.get(f)
        reach = self.reach.get(f, 0.0)
        pairs = {}
        for x in self.pair_reach.get(f, ()):
            p = idf[f"{f} {x}"]
            pairs[x] = (p * self.reach[f"{f} {x}"], 2 if p >= TELLING_PAIR else 0)
        tells = 0 if v is None or not reach else 2 if f in self.listed else int(v >= TELLING)
        return (self.unseen**2 if v is None else v * v, 0.0 if v is None else v * reach, f, pairs, len(w) == 1, tells, {x for x, (_, t) in pairs.items() if t})


def build_index(examples: list[tuple], terms: list[tuple], general: Iterable[tuple[str, str, str]] | None = None, rates: dict[tuple[str, str], float] | None = None) -> Index:
    """Index of labelled examples (id, text, label[, lang]), of known terms (term, category[, lang]) and of general phrases (lang:frame, phrase, label).

    A positive example is mostly ordinary text around one sentence: the sentence whose words lean most to
    positive examples is its entry, its other sentences and all those of ordinary examples, with their windows,
    are entries of label none. ``rates`` has the shares of turns of a language that words are in, from ``word_rates``;
    without it the entries themselves are counted. An entry weighs its words as its own language does.
    The scores are calibrated on the examples, each judged without its own entries.
    """
    split = [(i, [t for s in sentences(x or "") if (t := tokens(s))], y, more[0] if more else "") for i, x, y, *more in examples]
    phrases = [(f, t, y, f.split(":")[0]) for f, x, y in (general_phrases() if general is None else general) if (t := tokens(plain(x)))]
    pos, neg = Counter(), Counter()
    for _, ss, y, _ in split:
        for w in {w for t in ss for w in t}:
            (neg if y == "none" else pos)[w] += 1
    n_pos, n_neg = max(1, sum(x[2] != "none" for x in split)), max(1, sum(x[2] == "none" for x in split))
    lean = lambda t: sum(math.log((pos[w] + 0.5) / (n_pos + 1)) - math.log((neg[w] + 0.5) / (n_neg + 1)) for w in t) / math.sqrt(len(t))
    entries: list[tuple[object, list[str], str, str]] = []
    windows: list[tuple[object, list[str], str, str]] = []
    for i, ss, y, lang in split:
        key = max(range(len(ss)), key=lambda k: lean(ss[k])) if ss and y != "none" else -1
        entries += [(i, t, y if k == key else "none", lang) for k, t in enumerate(ss)]
        windows += [(i, part, "none", lang) for k, t in enumerate(ss) if k != key for part in clauses(t)[1:]]
    entries += phrases
    windows += [(f, part, y, lang) for f, t, y, lang in phrases if y == "none" for part in clauses(t)[1:]]
    entries += [(None, t, c, more[0] if more else "") for x, c, *more in terms if x and (t := tokens(plain(x)))]
    entries.sort(key=lambda e: (e[2] == "none", e[2], " ".join(e[1]), e[3] or ""))
    if rates is None:
        rates = {(w, ""): k / len(entries) for w, k in Counter(w for e in entries for w in set(e[1])).items()}
    words = defaultdict(list)
    for w in sorted({w for t, *_ in terms for w in _TOKEN.findall(plain(t))} | {w for _, x, y, *_ in examples if y != "none" for s in sentences(x or "") for w in _TOKEN.findall(s) if pos[folded(w)] and not neg[folded(w)]}):
        words[len(w)].append(w)
    # windows of ordinary text compete for the words of positive entries; positive entries keep their numbers
    wanted = {w for e in entries if e[2] != "none" for w in e[1]}
    more = sorted((e for e in windows if not wanted.isdisjoint(e[1])), key=lambda e: " ".join(e[1]))
    idf = _weights({f for e in entries + more for f in _features(e[1])}, rates)
    listed = frozenset(w for x, *_ in terms if x and len(t := tokens(plain(x))) == 1 for w in t if not neg[w])
    idx = _indexed(entries, idf, dict(words), listed)
    idx.windows = _indexed(entries + more, idf, {}, listed)
    idx.scale = _calibrated(idx, split)
    return idx


def _weights(features: set[str], rates: dict[tuple[str, str], float]) -> dict[str, dict[str, float]]:
    """Per language, and for texts of none, the weights of words by their rates there, and of pairs by those of both words."""
    out: dict[str, dict[str, float]] = {}
    for lang in {x for _, x in rates} | {""}:
        own = out[lang] = {f: -math.log(min(0.9, max(RAREST, rates.get((f, lang), 0.0)))) for f in features if " " not in f}
        for f in features:
            if " " in f:
                first, second = f.split(" ")
                own[f] = PAIR * (own[first] + own[second]) / 2
    return out


def _indexed(entries: list[tuple[object, list[str], str, str]], idf: dict[str, dict[str, float]], words: dict[int, list[str]], listed: frozenset[str]) -> Index:
    raw = defaultdict(list)
    for x, (_, t, _, lang) in enumerate(entries):
        c, own = _features(t), idf.get(lang) or idf[""]
        norm = math.sqrt(sum((m * own[f]) ** 2 for f, m in c.items()))
        for f, m in c.items():
            raw[f].append((x, m * own[f] / norm))
    postings = {f: ([x for x, _ in v], [w for _, w in v]) for f, v in raw.items()}
    block_max = {}
    for f, (e, w) in postings.items():
        at, start = np.unique(np.array(e) // BLOCK, return_index=True)
        block_max[f] = (at, np.maximum.reduceat(w, start))
    positive = np.array([e[2] != "none" for e in entries], bool)
    reach = {f: max(y for x, y in zip(e, w, strict=True) if positive[x]) for f, (e, w) in postings.items() if positive[e[0]]}
    pair_reach: dict[str, list[str]] = defaultdict(list)
    for f in reach:
        if " " in f:
            first, second = f.split(" ")
            pair_reach[first].append(second)
    held = [frozenset(_features(e[1])) for e in entries if e[2] != "none"]
    return Index([e[2] for e in entries], [e[0] for e in entries], idf, -math.log(UNKNOWN), postings, block_max, reach, words, dict(pair_reach), positive=positive, held=held, listed=listed)


def _calibrated(idx: Index, split: list) -> tuple[float, float]:
    """Slope and offset of the score, by logistic regression on the examples judged without themselves."""
    xs, ys = [], []
    idx.scale = (1.0, 0.0)
    for i, ss, y, lang in split:
        p = max((idx.vote(idx.neighbours(t, without=i, lang=lang))[0] for t in ss), default=0.0)
        xs.append(math.log(p / (1 - p)) if p else 0.0)
        ys.append(float(y != "none"))
    if not xs or len(set(ys)) < 2:
        return 8.0, -4.0
    x, y = np.array(xs), np.array(ys)
    a, b = 8.0, -4.0
    for _ in range(400):
        g = 1 / (1 + np.exp(-(a * x + b))) - y
        a, b = a - 0.5 * float((g * x).mean()) * 10, b - 0.5 * float(g.mean()) * 10
    return a, b


def word_rates(df: DataFrame, conversation: str, lang: str, vocabulary: Iterable[str]) -> dict[tuple[str, str], float]:
    """Of each folded word of ``vocabulary`` and each language the share of its turns that the word is in; for "" the largest share.

    All turns are counted, in the tasks; what the driver gets is bounded by the vocabulary and the languages.
    """
    shared = df.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, memo = shared.value, {}
        n: Counter = Counter()
        for b in batches:
            for v, own in zip(b[conversation], b[lang], strict=True):
                for t in turns(v):
                    c = content(t)
                    if not c:
                        continue
                    n["", own] += 1
                    met = set()
                    for w in set(_TOKEN.findall(plain(c))):
                        f = memo.get(w)
                        if f is None:
                            if len(memo) > 300_000:
                                memo.clear()
                            f = folded(w)
                            f = memo[w] = f if f in known else ""
                        if f:
                            met.add(f)
                    for f in met:
                        n[f, own] += 1
        yield pd.DataFrame([(w, own, k) for (w, own), k in n.items()], columns=["word", "lang", "n"])

    got = df.select(conversation, lang).mapInPandas(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).collect()
    whole = {r["lang"]: r["n"] for r in got if not r["word"]}
    rates: dict[tuple[str, str], float] = {}
    for r in got:
        if r["word"]:
            share = r["n"] / (whole[r["lang"]] + MORE_TURNS)
            rates[r["word"], ""] = max(rates.get((r["word"], ""), 0.0), share)
            if r["lang"]:
                rates[r["word"], r["lang"]] = share
    return rates


def read_index(examples: DataFrame, ident: str, text: str, label: str, terms: DataFrame | None = None, term: str = "term", category: str = "category", corpus: DataFrame | None = None, conversation: str = "conversation", lang: str = "lang") -> Index:
    """The index of the labelled table, which must not exceed ``MAX_EXAMPLES`` rows, and of the terms, likewise.

    Words weigh by their rates in ``corpus`` (``conversation``, ``lang``), where one is given.
    """
    own_lang = lambda d: F.col(lang) if lang in d.columns else F.lit("")
    ex = examples.select(ident, text, label, own_lang(examples)).limit(MAX_EXAMPLES + 1).collect()
    ts = terms.select(term, category, own_lang(terms)).limit(MAX_EXAMPLES + 1).collect() if terms is not None else []
    if max(len(ex), len(ts)) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} labelled examples or terms")
    own = sorted(((r[0], r[1], r[2] or "none", r[3] or "") for r in ex if r[0] is not None), key=lambda e: (e[0], e[1] or "")), sorted((r[0], r[1], r[2] or "") for r in ts if r[0])
    if corpus is None:
        return build_index(*own)
    vocabulary = {w for x in [*(e[1] for e in own[0]), *(e[0] for e in own[1]), *(e[1] for e in general_phrases())] for s in sentences(x or "") for w in tokens(s)}
    return build_index(*own, rates=word_rates(corpus, conversation, lang, vocabulary))


def score_conversations(df: DataFrame, index: Index, ident: str, conversation: str, extra: tuple[str, ...] = (), lang: str | None = None) -> DataFrame:
    """(*extra, ``ident``, score, label, turn_no, example) of every row: its worst turn and the nearest example.

    Words weigh as in the language that ``lang`` declares, where it is one that the index knows.

    Rows with null, broken or empty arrays score 0. The index travels as a broadcast whose size the limit on
    examples bounds; each turn is read whole, nothing is shuffled, repeated rows give repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType(
        [*(df.schema[c] for c in (*extra, ident)), T.StructField("score", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("turn_no", T.LongType()), T.StructField("example", T.StringType())]
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx, memo = shared.value, {}
        for b in batches:
            out = []
            keys = b[[*extra, ident]].itertuples(index=False, name=None)
            for key, v, own in zip(keys, b[conversation], b["__lang"], strict=True):
                best, at = (0.0, "none", -1), -1
                for no, t in enumerate(turns(v)):
                    c = content(t)
                    if c and (got := idx.score(c, memo, own))[0] > best[0]:
                        best, at = got, no
                who = idx.ids[best[2]] if best[2] >= 0 else None
                out.append((*key, best[0], best[1], at if at >= 0 else None, None if who is None else str(who)))
            got = pd.DataFrame(out, columns=[*extra, ident, "score", "label", "turn_no", "example"])
            yield got.astype({"turn_no": "Int64"})

    return df.select(*extra, ident, conversation, (F.col(lang) if lang else F.lit("")).alias("__lang")).mapInPandas(judge, schema)
