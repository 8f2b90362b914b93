"""Explicit types of the logical entities; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

TURN = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("attunement_score", T.DoubleType()),
        T.StructField("synthetic", T.BooleanType()),
    ]
)
TURNS = T.ArrayType(TURN)
#: Turns with all their keys, whatever these are.
WHOLE = "array<map<string,variant>>"
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

#: The columns of a rewritten preference pair, in order.
PAIR_COLUMNS = (
    "fork chosen_branch rejected_branch source subreddit post_id post_url post_score fork_depth chosen_depth rejected_depth "
    "chosen_score rejected_score score_delta chosen_chars rejected_chars asst_replacements user_replacements length_matched"
).split()
_LONG = {"post_score", "fork_depth", "chosen_depth", "rejected_depth", "chosen_chars", "rejected_chars", "asst_replacements", "user_replacements"}
_DOUBLE = {"chosen_score", "rejected_score", "score_delta"}
PAIR = T.StructType(
    [T.StructField(c, T.LongType() if c in _LONG else T.DoubleType() if c in _DOUBLE else T.BooleanType() if c == "length_matched" else T.StringType()) for c in PAIR_COLUMNS]
)
