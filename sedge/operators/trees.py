"""Records as JSON trees whose leaves are {value, source, ...}: rows of their leaves, grounding, counts, setting, and
extraction in several runs.

Trees have any shape, so they are walked in Arrow batches; whatever is done by leaf is done on rows of leaves.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.operators.grounding import MIN_SOURCE, WEIGHTS, find_span
from sedge.operators.voting import majority

LEAVES = "array<struct<path:string,value:string,source:string,source_doc:string,grounded:string>>"
COUNTS = "struct<non_null:int,grounded:int,unverifiable:int>"
RUNS_FAILED = "all_consistency_runs_failed"
#: The leaves that runs vote on; precursors are taken from the run with the longest list.
VOTED = tuple(p for p in WEIGHTS if p != "precursors")


def _load(text: str | None):
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return None


def walk(tree, leaf_key: str = "source") -> Iterator[tuple[str, dict]]:
    """(dotted path, node) of every node that has the key; below it nothing is looked at. List items have their index."""
    todo = [("", tree)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict) and leaf_key in node:
            yield path, node
            continue
        items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
        todo += reversed([(f"{path}.{k}" if path else str(k), v) for k, v in items])


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _mapped(function: Callable, returns: str, *columns: Column) -> Column:
    """A function of Python values as a column, null where it gives None."""

    @F.pandas_udf(returns)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*(None if x is pd.NA or x is None or x != x else x for x in row)) for row in zip(*series)], dtype=object)

    @F.pandas_udf(returns)
    def frames(*series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(*(None if x is pd.NA or x is None or x != x else x for x in row)) for row in zip(*series)])

    return (frames if returns.startswith("struct") else run)(*columns)


def leaf_rows(record: Column) -> Column:
    """The leaves of a JSON record, in order; none where it isn't JSON."""

    def leaves(text):
        return [{"path": p, "value": _text(n.get("value")), "source": _text(n.get("source")), "source_doc": _text(n.get("source_doc")), "grounded": _text(n.get("grounded"))} for p, n in walk(_load(text))]

    return _mapped(leaves, LEAVES, record)


def ground_tree(record: Column, text: Column) -> Column:
    """The record with `grounded` on each leaf and `span` where its source stands in the text.

    A source from a table is "table", one under MIN_SOURCE characters null as it can't be told, an empty one false.
    """

    def run(raw, said):
        tree = _load(raw)
        if tree is None:
            return None
        for _, node in walk(tree):
            source = str(node["source"] or "").strip()
            if not source:
                node["grounded"] = False
            elif source.startswith("Table"):
                node["grounded"] = "table"
            elif len(source) < MIN_SOURCE:
                node["grounded"] = None
            else:
                span = find_span(source, said or "")
                node["grounded"] = span is not None
                if span:
                    node["span"] = {"start": span[0], "end": span[1]}
        return json.dumps(tree, ensure_ascii=False)

    return _mapped(run, "string", record, text)


def tree_counts(record: Column) -> Column:
    """struct(non_null, grounded, unverifiable) over the leaves of a grounded record.

    A leaf without a value, as precursors are, never counts as given but counts as unverifiable where it isn't grounded.
    """

    def counts(raw):
        nodes = [n for _, n in walk(_load(raw))]
        given = [n for n in nodes if n.get("value") not in (None, [], "")]
        return {"non_null": len(given), "grounded": sum(n.get("grounded") in (True, "table") for n in given), "unverifiable": sum(n.get("grounded") is None for n in nodes)}

    return _mapped(counts, COUNTS, record)


def tree_score(counts: Column) -> Column:
    """grounded / (given - unverifiable) with three digits, 0 where the denominator is; it may be negative."""
    n = counts["non_null"] - counts["unverifiable"]
    return F.when(n != 0, F.round(counts["grounded"].cast("double") / n, 3)).otherwise(0.0)


def grounded_leaves(record: Column) -> Column:
    """struct(grounded, total): nodes that are marked, and those of them that are true; nothing below a marked node."""

    def counts(raw):
        marked = [n for _, n in walk(_load(raw), "grounded")]
        return {"grounded": sum(n["grounded"] is True for n in marked), "total": len(marked)}

    return _mapped(counts, "struct<grounded:int,total:int>", record)


def get_leaf(record: Column, path: str) -> Column:
    """The JSON of the {value, ...} node at a dotted path, null where there is none."""
    node = F.try_variant_get(F.try_parse_json(record), f"$.{path}", "variant")
    return F.when(F.try_variant_get(F.try_parse_json(record), f"$.{path}.value", "variant").isNotNull(), F.to_json(node))


def set_leaves(record: Column, leaves: Column) -> Column:
    """The record with the nodes of (path, json) written at their dotted paths; nodes on the way are made."""

    def run(raw, pairs):
        tree = _load(raw)
        tree = tree if isinstance(tree, dict) else {}
        for pair in pairs if pairs is not None else ():
            *way, last = pair["path"].split(".")
            node = tree
            for k in way:
                if not isinstance(node.get(k), dict):
                    node[k] = {}
                node = node[k]
            node[last] = _load(pair["json"])
        return json.dumps(tree, ensure_ascii=False)

    @F.pandas_udf("string")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([run(x, y) for x, y in zip(a, b)], dtype=object)

    return udf(record, leaves)


def extraction_runs(documents: DataFrame, doc: str, text: str, extractor: Callable[[str, float], tuple[dict, str]], n: int = 2, temperature: float = 0.3) -> DataFrame:
    """(doc, run, record, model): n runs of an extractor of (text, temperature) a document, the first at temperature 0.
    A run that fails has a null record."""
    kind = dict(documents.dtypes)[doc]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, said in zip(pdf[doc], pdf[text]):
                for i in range(n):
                    try:
                        record, model = extractor(said, temperature if i else 0.0)
                        rows.append((key, i, json.dumps(record, ensure_ascii=False), model))
                    except Exception:  # one failed run doesn't end the others
                        rows.append((key, i, None, None))
            yield pd.DataFrame(rows, columns=[doc, "run", "record", "model"])

    return documents.select(doc, text).mapInPandas(run, f"`{doc}` {kind}, run int, record string, model string")


def merge_runs(runs: DataFrame, doc: str) -> DataFrame:
    """(doc, record, model): the first run that worked with the leaves that most runs agree on and the longest list of
    precursors; an error where all failed. The model is that of the first run."""
    good = runs.where("record IS NOT NULL")
    first = runs.groupBy(doc).agg(F.min_by("record", "run").alias("_any"), F.min_by("model", "run").alias("model"), F.min_by("record", F.when(F.col("record").isNotNull(), F.col("run"))).alias("record"), F.count("record").alias("_n"))
    each = good.select(doc, "run", "record", F.explode(F.array(*map(F.lit, VOTED))).alias("path"))
    node = F.coalesce(*(F.when(F.col("path") == p, get_leaf(F.col("record"), p)) for p in VOTED))
    each = each.withColumn("json", node).withColumn("value", F.get_json_object("json", "$.value"))
    won = majority(each.where("json IS NOT NULL"), [doc, "path"])
    won = each.join(won.select(doc, "path", F.col("value").alias("_value")), [doc, "path"]).where(F.col("value") == F.col("_value")).groupBy(doc, "path").agg(F.min_by("json", "run").alias("json"))
    items = F.get_json_object("record", "$.precursors")
    lists = good.select(doc, "run", items.alias("json"), F.coalesce(F.json_array_length(items), F.lit(0)).alias("_n"))
    longest = lists.groupBy(doc).agg(F.max_by("json", F.struct("_n", -F.col("run"))).alias("json")).where("json IS NOT NULL").select(doc, F.lit("precursors").alias("path"), "json")
    changes = won.unionByName(longest).groupBy(doc).agg(F.collect_list(F.struct("path", "json")).alias("_changes"))  # at most a record's leaves
    out = first.join(changes, doc, "left")
    merged = F.when(F.col("_n") == 0, F.lit(json.dumps({"error": RUNS_FAILED}))).when(F.col("_n") == 1, F.col("record")).otherwise(set_leaves(F.col("record"), F.col("_changes")))
    return out.select(doc, merged.alias("record"), F.coalesce("model", F.lit("unknown")).alias("model"))
