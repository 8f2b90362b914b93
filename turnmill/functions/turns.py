"""Expressions over arrays of turns. A null array gives null unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.schemas import TURNS, WHOLE


def decode(json: Column | str, strict: bool = False) -> Column:
    """Turns of a JSON string. Broken JSON is null, or an error with ``strict``; unknown keys are left out, which ``decode_whole`` keeps."""
    return F.from_json(json, TURNS, {"mode": "FAILFAST"} if strict else {})


def decode_whole(json: Column | str) -> Column:
    """Turns of a JSON string with every key they have, as maps of variants; ``encode`` loses nothing of them."""
    return F.from_json(json, WHOLE)


def encode(whole: Column) -> Column:
    """JSON of turns from ``decode_whole``: equal in value, keys that were set anew stand last."""
    return F.to_json(whole)


def put(turn: Column, **values: Column) -> Column:
    """A turn from ``decode_whole`` with keys set; all other keys stay."""
    kept = F.map_filter(turn, lambda k, _: ~k.isin(*values))
    return F.map_concat(kept, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("variant"))]))


def text_of(turn: Column, key: str) -> Column:
    """The string at a key of a turn from ``decode_whole``; null where there is none."""
    return F.try_variant_get(turn[key], "$", "string")


def strip(turns: Column) -> Column:
    """Only role and content of each turn."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))


def chars(turns: Column) -> Column:
    """Characters of all contents; null contents count nothing, a null array is 0."""
    return F.coalesce(F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.length(t["content"]), F.lit(0))), F.lit(0).cast("long"))


def swap_role(role: Column) -> Column:
    return F.when(role == "user", "assistant").when(role == "assistant", "user").otherwise(role)


def swap_roles(turns: Column) -> Column:
    """User and assistant exchanged, other roles and all other fields kept."""
    return F.transform(turns, lambda t: t.withField("role", swap_role(t["role"])))


def last_role(turns: Column) -> Column:
    """Role of the last turn; ``?`` for empty and null arrays."""
    return F.coalesce(F.try_element_at(turns, F.lit(-1))["role"], F.lit("?"))


def ends_on_assistant(turns: Column) -> Column:
    return F.coalesce((F.size(turns) > 0) & (F.try_element_at(turns, F.lit(-1))["role"] == "assistant"), F.lit(False))


def adjacent_pairs(turns: Column) -> Column:
    """(user, assistant, turn_no) of each assistant turn that directly follows a user turn; turn_no from 0."""
    at = F.sequence(F.lit(1), F.size(turns) - 1)
    pairs = F.transform(at, lambda i: F.struct(turns[i - 1]["content"].alias("user"), turns[i]["content"].alias("assistant"), i.alias("turn_no"), (turns[i - 1]["role"] == "user").alias("u"), (turns[i]["role"] == "assistant").alias("a")))
    found = F.filter(pairs, lambda p: F.coalesce(p["u"] & p["a"], F.lit(False)))
    return F.when(F.size(turns) >= 2, F.transform(found, lambda p: F.struct(p["user"].alias("user"), p["assistant"].alias("assistant"), p["turn_no"].alias("turn_no"))))


def alternates(turns: Column) -> Column:
    """No two neighbours share a role; true for arrays of fewer than two turns."""
    a, b = F.slice(turns, 1, F.size(turns) - 1), F.slice(turns, 2, F.size(turns) - 1)
    same = F.exists(F.zip_with(a, b, lambda x, y: x["role"] == y["role"]), lambda x: x)
    return F.when(F.size(turns) >= 2, ~F.coalesce(same, F.lit(False))).otherwise(F.lit(True))


def embed_scores(whole: Column, scores: Column) -> Column:
    """``attunement_score`` of the turns whose number is a key of the map ``scores``, rounded to 6 digits; from ``decode_whole``."""
    return F.transform(whole, lambda t, i: F.when(F.map_contains_key(scores, i), put(t, attunement_score=F.bround(scores[i], 6))).otherwise(t))


def replace_texts(whole: Column, texts: Column) -> Column:
    """Contents of the turns whose number is a key of the map ``texts``, which become synthetic; from ``decode_whole``."""
    return F.transform(whole, lambda t, i: F.when(F.map_contains_key(texts, i), put(t, content=texts[i], synthetic=F.lit(True))).otherwise(t))


def synthetic_slots(turns: Column) -> Column:
    """Numbers of the synthetic turns."""
    marked = F.transform(turns, lambda t, i: F.struct(i.alias("i"), F.coalesce(t["synthetic"], F.lit(False)).alias("s")))
    return F.transform(F.filter(marked, lambda m: m["s"]), lambda m: m["i"])


def length_ratio(a: Column, b: Column) -> Column:
    """``abs(a - b) / max(a, b, 1)``."""
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def signed_ratio(a: Column, b: Column) -> Column:
    """``(a - b) / max(a, b)``, 0 lengths counting as 1."""
    return (a - b) / F.greatest(a, b, F.lit(1))
