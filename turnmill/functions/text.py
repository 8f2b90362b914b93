"""Style features of a text, built from regular expressions that run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists of the style features.
CONTRACTIONS = (
    "i'm i've i'd i'll you're you've you'd you'll he's she's it's we're we've we'd we'll they're they've they'd they'll isn't aren't wasn't weren't don't doesn't didn't won't "
    "wouldn't can't couldn't shouldn't mustn't hasn't haven't hadn't that's there's here's what's who's how's let's ain't gonna wanna gotta kinda sorta"
).split()
PRONOUNS = "i me my mine myself we us our ours ourselves you your yours yourself yourselves".split()
HEDGES = ["maybe", "perhaps", "probably", "possibly", "apparently", "basically", "actually", "honestly", "frankly", "literally", "kind of", "sort of", "i think", "i guess", "i feel like", "i mean", "not sure", "not certain", "in my opinion", "imo"]
INFORMAL = "lol lmao omg tbh imo imho idk smh fwiw iirc yeah yep yup nah nope haha heh hmm gonna wanna gotta kinda sorta ok okay cool dude bro man guys btw fyi tho tl;dr af".split()
PUNCTUATION = r"""[.,;:!?\-"'()\[\]{}]"""

FEATURES = ("sentence_length", "word_length", "contractions", "pronouns", "questions", "exclamations", "hedges", "informal", "punctuation")


def _factored(words: list[str]) -> str:
    """A pattern of the words in which common beginnings stand once, so that most positions fail at one letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(h) + (_factored(rest) if len(rest) > 1 else re.escape(rest[0])) for h, rest in heads.items()]
    # longer words first: a shorter one that also ends here is tried last
    return "(?:" + "|".join(sorted(parts, key=lambda x: not x)) + ")" if len(parts) > 1 else parts[0]


def _listed(words: list[str]) -> str:
    """Matches of whole words in lower-case text."""
    return r"(?U)\b" + _factored(words) + r"\b"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def sentences(c: Column) -> Column:
    """Parts of the trimmed text between blanks that follow ``.``, ``!`` or ``?``; no empty ones."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.filter(F.split(trimmed, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def words(c: Column) -> Column:
    """Runs of ASCII letters and straight apostrophes."""
    return F.regexp_extract_all(c, F.lit("([a-zA-Z']+)"), 1)


def counts(c: Column) -> dict[str, Column]:
    """The raw counts below the features; a null text counts as empty."""
    c = F.coalesce(c, F.lit(""))
    w, low = words(c), F.lower(c)
    blank = ~F.regexp_like(c, F.lit(r"(?U)\S"))
    # a sentence ends at blanks behind a mark, or at the end of the text
    ending = lambda mark: _count(c, rf"(?U){mark}(?=\s|\z)")
    return {
        "n_sentences": F.when(blank, F.lit(0)).otherwise(_count(c, r"(?U)[.!?]\s+(?=\S)") + 1),
        "n_words": F.size(w),
        "n_word_chars": F.length(F.array_join(w, "")),
        "n_contractions": F.when(low.contains("'"), _count(low, _listed([x for x in CONTRACTIONS if "'" in x]))).otherwise(F.lit(0)) + _count(low, _listed([x for x in CONTRACTIONS if "'" not in x])),
        "n_pronouns": _count(low, _listed(PRONOUNS)),
        "n_questions": ending(r"\?"),
        "n_exclamations": ending("!"),
        "n_hedges": _count(low, _listed(HEDGES)),
        "n_informal": _count(low, _listed(INFORMAL)),
        "n_punctuation": _count(c, PUNCTUATION),
        "n_chars": F.length(c),
    }


def features(n: dict[str, Column]) -> Column:
    """The nine features in their order from ``counts``. Divisors are at least 1, so empty text gives 1 and zeros."""
    one = F.lit(1)
    ns, nw, nc = (F.greatest(n[k], one).cast("double") for k in ("n_sentences", "n_words", "n_chars"))
    return F.array(
        nw / ns, n["n_word_chars"] / nw, n["n_contractions"] / nw, n["n_pronouns"] / nw, n["n_questions"] / ns,
        n["n_exclamations"] / ns, n["n_hedges"] / nw, n["n_informal"] / nw, n["n_punctuation"] / nc,
    )


def truncate_at_boundary(c: Column, n: Column) -> Column:
    """Texts longer than ``n`` end at the last ``.!?`` or line break in their second half, else after ``n`` characters."""
    h = F.floor(n / 2).cast("int")
    tail = F.regexp_extract(F.substring(c, h + 2, n - h), r"(?s)^(.*[.!?\n])", 1)
    cut = F.when(tail == "", F.substring(c, F.lit(1), n)).otherwise(F.concat(F.substring(c, F.lit(1), h + 1), tail))
    return F.when(F.length(c) > n, cut).otherwise(c)


def truncate_overlong(c: Column, target: Column) -> Column:
    """The text without white space at its ends, truncated where it is longer than 1.3 times a positive target."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when((target > 0) & (F.length(t) > (target * 1.3).cast("int")), truncate_at_boundary(t, target)).otherwise(t)


def shown(c: Column, n: int = 120) -> Column:
    """The text, or its first ``n`` characters and three dots."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
