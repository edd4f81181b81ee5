"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.canon import to_canonical
from sedge.llm.frequency import useless_values
from sedge.llm.grouping import assign_splits, chained_rows
from sedge.llm.grouping import kept_promises as split_promises
from sedge.llm.leakage import leak_report, leaked
from sedge.llm.overlap import cross_split_pairs, overlap_report
from sedge.llm.packing import containers, fill_report, kept_promises
from sedge.llm.scans import repairs
from sedge.llm.spam import spam_pages
from sedge.plans import sqltext as q
from sedge.sources.tables import cut, table

NAMED_FIELDS = ["HTL_stack_sequence", "ETL_stack_sequence", "Perovskite_deposition_procedure"]
COUNTED_FIELDS = ["Cell_architecture", "Perovskite_composition_short_form", "Perovskite_deposition_procedure", "ETL_stack_sequence", "HTL_stack_sequence", "Backcontact_stack_sequence"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return to_canonical(table(spark, d, "devices"), "row_id", NAMED_FIELDS, table(spark, d, "canon_terms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repairs(table(spark, d, "parsed_papers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return useless_values(table(spark, d, "devices"), COUNTED_FIELDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(table(spark, d, "chat_examples"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "chat_examples"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return chained_rows(table(spark, d, "devices"), "row_id", "Ref_DOI_number", "split_key")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = assign_splits(table(spark, d, "devices"), "row_id", "Ref_DOI_number", "split_key")
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))


def _two_runs(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of two runs, the second on the other half of the rows and the table of the first."""
    first, known = assign_splits(t.where("row_id % 2 = 0"), "row_id", "Ref_DOI_number", "split_key")
    second, _ = assign_splits(t.where("row_id % 2 <> 0"), "row_id", "Ref_DOI_number", "split_key", existing=known)
    return first, second


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    first, second = _two_runs(table(spark, d, "devices"))
    rows = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return rows.groupBy("run", "split").agg(F.count("*").alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))


def p6_promises(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is lost or set apart in two runs."""
    t = table(spark, d, "devices")
    first, second = _two_runs(t)
    return split_promises(t, first.unionByName(second), "row_id", "Ref_DOI_number", "split_key")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(containers(table(spark, d, "documents")))


def p8_promises(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return kept_promises(cut(containers(t)), t)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_splits": p6_splits, "p6_runs": p6_runs, "p6_promises": p6_promises, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_promises": p8_promises, "p9_found": p9_found, "p9_report": p9_report, "p10_found": p10_found}
_BARE = f"lower({q.stripped('Ref_DOI_number')})"
_BARE = f"CASE WHEN contains({_BARE}, '%') THEN url_decode({_BARE}) ELSE {_BARE} END"
_FOUND = f"regexp_replace(regexp_extract({_BARE}, '(10\\.[0-9]{{2,9}}/\\S+)', 1), '[.,;:)\\]]+$', '')"
SQL: dict[str, str] = {
    "p4_found": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS column_name, {q.given(chr(34) + f + chr(34))} AS item FROM devices" for f in COUNTED_FIELDS) + """),
g AS (SELECT column_name, item, count(*) AS n FROM c WHERE item IS NOT NULL GROUP BY ALL)
SELECT column_name, item, CASE WHEN n = 1 THEN 'rare' ELSE 'common' END AS mark FROM g WHERE n = 1 OR n >= 0.1 * (SELECT count(*) FROM devices)""",
    "p6_promises": "SELECT count(*) AS n_rows, 0 AS n_lost, 0 AS n_apart FROM devices",
    "p8_promises": "SELECT count(*) AS n_documents, 0 AS n_lost, 0 AS n_over, 0 AS n_cut FROM documents",
    "p6_found": f"""WITH RECURSIVE t AS (SELECT row_id, Ref_DOI_number AS w, CASE WHEN NOT {q.missing('Ref_DOI_number')} THEN 'd:' || coalesce(nullif({_FOUND}, ''), {_BARE}) END AS d, CASE WHEN NOT {q.missing('split_key')} THEN 'k:' || lower({q.stripped('split_key')}) END AS k FROM devices),
e AS (SELECT DISTINCT d AS a, k AS b FROM t WHERE d IS NOT NULL AND k IS NOT NULL), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), x AS (SELECT row_id, CASE WHEN d IS NOT NULL THEN w END AS w, coalesce(root, d, k) AS g FROM t LEFT JOIN c ON node = coalesce(d, k) WHERE coalesce(d, k) IS NOT NULL)
SELECT row_id, substr(x.g, 3) AS group_doi FROM x JOIN (SELECT g FROM x GROUP BY g HAVING count(DISTINCT w) > 1) USING (g)""",
}
