"""Grounding of extracted values in their text, and scores of records by their grounded fields."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the fields, and the dashes that count as a hyphen.
CRITICAL = {"material": 3.0, "precursors": 3.0, "synthesis_method": 2.5, "process_conditions.temperature": 2.0}
IMPORTANT = {"process_conditions.duration": 1.5, "process_conditions.atmosphere": 1.0, "process_conditions.annealing": 1.0, "substrate": 1.0, "characterization.bandgap": 1.0}
MINOR = {"characterization.xrd": 0.5, "characterization.sem": 0.5, "characterization.film_thickness": 0.5, "device_performance.pce": 0.5, "device_performance.voc": 0.3, "device_performance.jsc": 0.3, "device_performance.ff": 0.3, "key_findings": 0.5}
WEIGHTS = {**CRITICAL, **IMPORTANT, **MINOR}
MIN_SOURCE, SPAN_SCORE, PROBE_SCORE = 20, 82.0, 72.0
_DASHES = str.maketrans({c: "-" for c in "–—−‐"})


def plain(s: str) -> str:
    """Compatibility characters folded, dashes as hyphens."""
    return unicodedata.normalize("NFKC", s).translate(_DASHES)


def plain_text(c: Column) -> Column:
    """plain() as a column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(plain, na_action="ignore")

    return run(c)


def indel_ratio(a: str, b: str) -> float:
    """200 * (longest common subsequence) / (sum of lengths), bit-parallel."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str, known: dict[str, float] | None = None) -> float:
    """The best indel ratio of the shorter text with a window of its length (or less, at the ends) in the longer.

    `known` keeps the ratios of windows, for calls with the same short text and overlapping long ones.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    n, letters = len(a), set(a)
    known = {} if known is None else known
    best = 0.0
    for k in range(-n + 1, len(b)):
        window = b[max(0, k) : k + n]
        if window and (window[-1] in letters or window[0] in letters):
            if (r := known.get(window)) is None:
                r = known[window] = indel_ratio(a, window)
            best = max(best, r)
    return best


def stretches(n: int, length: int) -> list[tuple[int, int]]:
    """Where a source of n characters may stand in a text: stretches a fifth longer than it, a fifth of it apart."""
    fifth = n // 5
    return [(at, min(at + n + fifth, length)) for at in range(0, max(1, length - n + 1), max(1, fifth))]


def find_span(source: str | None, text: str | None, least: float = SPAN_SCORE) -> tuple[int, int] | None:
    """The span of a source in the folded, lower-case text: where it stands exactly, else the earliest of the
    stretches that are most like it, if that is like enough. A source under MIN_SOURCE characters has none."""
    raw = (source or "").strip()
    if text is None or len(raw) < MIN_SOURCE:
        return None
    needle, hay = plain(raw).lower(), plain(text).lower()
    before, met, _ = hay.partition(needle)
    if met:
        return len(before), len(before) + len(needle)
    places, known = stretches(len(needle), len(hay)), {}
    likeness = [partial_ratio(needle, hay[x:y], known) for x, y in places]
    top = max(likeness)
    return places[likeness.index(top)] if top > 0 and top >= least else None


def ground(df: DataFrame, source: str, text: str) -> DataFrame:
    """Adds grounded ('true', 'false', 'table' or null) and norm_start, norm_end of each source in its text.

    Exact hits of plain text are found in the JVM; only the other rows reach Python.
    """

    @F.pandas_udf("struct<norm_start:int,norm_end:int>")
    def fuzzy(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sources, texts in batches:
            spans = [find_span(s, t) if isinstance(s, str) and isinstance(t, str) else None for s, t in zip(sources, texts)]
            yield pd.DataFrame({"norm_start": pd.array([x[0] if x else None for x in spans], "Int32"), "norm_end": pd.array([x[1] if x else None for x in spans], "Int32")})

    s = F.trim(F.col(source))
    ascii_only = F.col(text).rlike(r"^\p{ASCII}*$") & s.rlike(r"^\p{ASCII}*$")
    at = F.when(ascii_only, F.instr(F.lower(F.col(text)), F.lower(s)) - 1)
    kind = F.when(F.coalesce(s, F.lit("")) == "", "empty").when(s.startswith("Table"), "table").when(F.length(s) < MIN_SOURCE, "short").when(at >= 0, "exact").otherwise("search")
    marked = df.withColumns({"_kind": kind, "_at": at})
    quick = marked.where("_kind <> 'search'").withColumns({
        "grounded": F.when(F.col("_kind") == "empty", "false").when(F.col("_kind") == "table", "table").when(F.col("_kind") == "exact", "true"),
        "norm_start": F.when(F.col("_kind") == "exact", F.col("_at")).cast("int"),
        "norm_end": F.when(F.col("_kind") == "exact", F.col("_at") + F.length(s)).cast("int"),
    })
    slow = marked.where("_kind = 'search'").withColumn("_span", fuzzy(F.col(source), F.col(text))).withColumns({
        "grounded": F.when(F.col("_span.norm_start").isNotNull(), "true").otherwise("false"), "norm_start": F.col("_span.norm_start"), "norm_end": F.col("_span.norm_end")
    }).drop("_span")
    return quick.unionByName(slow).drop("_kind", "_at")


def leaves(records: DataFrame, *keep: str | Column, each_precursor: bool = False) -> DataFrame:
    """(keep..., path, value) of the weighted fields of normalised records; precursors as the number of them or, with
    each_precursor, as a row each with its name, else its concentration."""
    rows = F.array(*(F.struct(F.lit(p).alias("path"), (F.nullif(F.size("precursors"), F.lit(0)).cast("string") if p == "precursors" else F.col(p)).alias("value")) for p in WEIGHTS if p != "precursors" or not each_precursor))
    if each_precursor:
        own = F.transform(F.coalesce("precursors", F.array()), lambda p: F.struct(F.lit("precursors").alias("path"), F.coalesce(p["name"], p["concentration"]).alias("value")))
        rows = F.concat(rows, own)
    out = records.select(*keep, F.explode(rows).alias("x"))
    return out.select(*(c for c in out.columns if c != "x"), "x.path", "x.value")


def _weight(path: Column) -> Column:
    return F.element_at(F.create_map(*(x for p, w in WEIGHTS.items() for x in (F.lit(p), F.lit(w)))), path)


def record_scores(leaf: DataFrame, id_column: str, synthesis: str | None = None) -> DataFrame:
    """Scores from (id, path, value, grounded) with a row a precursor: completeness of the needed fields and the
    critical ones missing, precision of grounding, and the weighted score (half weight where not grounded).

    Precision is over given values that can be told; each given precursor counts as one, and only as grounded where its
    source stands in the text. Completeness is null and nothing missing where the column `synthesis` isn't true. One
    aggregation.
    """
    given = F.coalesce(~F.col("value").isin("", "[]"), F.lit(False))
    sure = F.coalesce(F.col("grounded").isin("true", "table"), F.lit(False))
    one = F.col("path") == "precursors"
    told = given & (one | F.col("grounded").isNotNull())
    good = given & F.when(one, F.coalesce(F.col("grounded") == "true", F.lit(False))).otherwise(sure)
    needed = [p for p in (*CRITICAL, *IMPORTANT) if p != "precursors"]
    any_given, any_sure = F.coalesce(F.max(given & one), F.lit(False)), F.coalesce(F.max(sure & one), F.lit(False))
    present = F.count_if(given & F.col("path").isin(needed)) + any_given.cast("int")
    earned = F.sum(F.when(given & ~one, _weight(F.col("path")) * F.when(sure, 1.0).otherwise(0.5)).otherwise(0.0)) + F.when(any_given, WEIGHTS["precursors"] * F.when(any_sure, 1.0).otherwise(0.5)).otherwise(0.0)
    order = F.array(*map(F.lit, CRITICAL))
    counts = F.coalesce(F.max(F.col(synthesis)), F.lit(False)) if synthesis else F.lit(True)
    lacking = F.array_join(F.filter(order, lambda p: ~F.array_contains(F.collect_set(F.when(given, F.col("path"))), p)), ",")
    return leaf.groupBy(id_column).agg(
        F.when(counts, present / (len(needed) + 1)).alias("completeness"),
        F.when(counts, lacking).otherwise("").alias("missing_critical"),
        F.coalesce(F.try_divide(F.count_if(good).cast("double"), F.count_if(told)), F.lit(0.0)).alias("grounding_precision"),
        (earned / sum(WEIGHTS.values())).alias("weighted_score"),
    )


def grounding_score(leaf: DataFrame, *by: str) -> DataFrame:
    """grounded / (given - unverifiable), 0 where nothing can be verified."""
    given, unsure = F.count_if(F.col("value").isNotNull()), F.count_if(F.col("value").isNotNull() & F.col("grounded").isNull())
    true = F.count_if(F.col("grounded") == "true")
    return leaf.groupBy(*by).agg(true.alias("grounded_fields"), given.alias("total_fields"), F.coalesce(F.try_divide(true.cast("double"), given - unsure), F.lit(0.0)).alias("grounding_score"))
