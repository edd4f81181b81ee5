"""JSON objects in model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREDICTION = "struct<prediction:map<string,string>,confidence:string,justification:array<string>>"


def strip_fences(c: Column) -> Column:
    """Text without a surrounding ``` block."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def parse_object(c: Column, schema: str = PREDICTION) -> Column:
    """The JSON object of a text: the whole text, else from its first { to its last }; null where there is none."""
    s = strip_fences(c)
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    whole = F.when(s.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(s).isNotNull(), F.from_json(s, schema))
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), F.from_json(inner, schema)))
