"""One spelling for communities, posts, sources and languages that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def community_key(c: Column | str) -> Column:
    """Lower case, without blanks, slashes and a leading ``r/``; null where nothing is left."""
    bare = F.lower(F.regexp_replace(_column(c), r"(?U)\s+", ""))
    return _filled(F.regexp_replace(F.regexp_replace(bare, r"^/*r/+", ""), "/+", ""))


def post_key(c: Column | str) -> Column:
    """Lower case, without blanks and a leading ``t3_``; null where nothing is left."""
    bare = F.lower(F.regexp_replace(_column(c), r"(?U)\s+", ""))
    return _filled(F.regexp_replace(bare, r"^t3_", ""))


def source_key(c: Column | str) -> Column:
    """Lower-case letters and digits only, so that ``Hacker News`` and ``hacker_news`` are one."""
    return _filled(F.regexp_replace(F.lower(_column(c)), r"(?U)[^\p{L}\p{N}]+", ""))


def language_key(c: Column | str) -> Column:
    """The primary subtag in lower case (``pt-PT`` and ``PT`` are ``pt``); null where blank."""
    return _filled(F.regexp_extract(F.lower(F.trim(_column(c))), r"^([a-z]{2,3})(?:[-_].*)?$", 1))
