"""Missing-value tokens of hand-entered tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing entry (trimmed, lower case).
MISSING_TOKENS = ("", "unknown", "nan", "none", "null", "n/a")
_LIST = re.compile(r"[;|]")


def strip(c: Column) -> Column:
    """Trim every Unicode white space at both ends (trim() only knows the blank)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


_TOKEN = "(?:" + "|".join(t for t in MISSING_TOKENS if t) + ")?+"
#: One pass without backtracking over a token, or a ;/| list of tokens.
_MISSING = rf"(?iU)\A\s*+{_TOKEN}\s*+(?:[;|]\s*+{_TOKEN}\s*+)*+\z"


def is_missing(c: Column) -> Column:
    """True for null, a missing token, or a ;/| list whose items are all missing."""
    return F.coalesce(c.rlike(_MISSING), F.lit(True))


def meaningful(c: Column) -> Column:
    """The stripped value, or null where it is missing. Case and inner text stay."""
    return F.when(~is_missing(c), strip(c))


def is_missing_text(v: str | None) -> bool:
    """is_missing for a Python string."""
    return v is None or v.strip().lower() in MISSING_TOKENS or all(p.strip().lower() in MISSING_TOKENS for p in _LIST.split(v))
