"""Queries of the dataset, retrieval and evaluation operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.jsons import parse_object
from sedge.functions.missing import MISSING_TOKENS, meaningful
from sedge.functions.numbers import parse_float
from sedge.functions.splits import split_name, stable_bucket
from sedge.operators import attention as att
from sedge.operators import evaluation as ev
from sedge.operators import dataset, grounding, ingest, models, profile, prompts, records, retrieval, review, sequences, targets, trees, voting
from sedge.plans import sqltext as q
from sedge.sources import files
from sedge.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The string columns of a device row, in file order.
DEVICE_COLUMNS = [
    "Ref_ID", "Ref_DOI_number", "Ref_lead_author", "Ref_journal", "source", "Cell_architecture", "Cell_stack_sequence", "Cell_area_measured", "Perovskite_composition_short_form", "Perovskite_composition_long_form", "Perovskite_composition_a_ions", "Perovskite_composition_a_ions_coefficients",
    "Perovskite_band_gap", "Perovskite_thickness", "Perovskite_deposition_procedure", "Perovskite_deposition_solvents", "Perovskite_deposition_thermal_annealing_temperature", "Perovskite_deposition_thermal_annealing_time", "ETL_stack_sequence", "HTL_stack_sequence", "Backcontact_stack_sequence",
    "Backcontact_thickness_list", "JV_light_intensity", "JV_default_PCE", "JV_default_Voc", "JV_default_Jsc", "JV_default_FF", "split_key",
]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- splits ---------------------------------------------------------------------------------------------------------


@query(f"SELECT {q.split('source')} AS split, lang, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def split_by_source(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("source IS NOT NULL")
    return t.groupBy(split_name(F.col("source"), 0.8, 0.1, 17).alias("split"), "lang").agg(F.count("*").alias("n"))


@query(f"SELECT o_custkey, round({q.bucket('CAST(o_custkey AS VARCHAR)', 5)}, 9) AS bucket, CASE WHEN {q.bucket('CAST(o_custkey AS VARCHAR)', 5)} < 0.5 THEN 'train' WHEN {q.bucket('CAST(o_custkey AS VARCHAR)', 5)} < 0.75 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY ALL")
def split_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each key's bucket and split under another seed and other ratios, over rows that repeat keys."""
    key = F.col("o_custkey").cast("string")
    return table(spark, d, "orders").groupBy("o_custkey", F.round(stable_bucket(key, 5), 9).alias("bucket"), split_name(key, 0.5, 0.25, 5).alias("split")).agg(F.count("*").alias("n"))


@query(f"""WITH v AS ({q.VALID}), k AS (SELECT {q.given('Ref_DOI_number')} AS key FROM v)
SELECT {q.split('key')} AS split, count(*) AS n_written FROM k WHERE key IS NOT NULL GROUP BY ALL""")
def dataset_splits(spark: SparkSession, d: str) -> DataFrame:
    v = dataset.marked(table(spark, d, "devices"), dataset.Config()).where("_split IS NOT NULL")
    return v.groupBy(F.col("_split").alias("split")).agg(F.count("*").alias("n_written"))


@query(f"""WITH v AS (SELECT coalesce({q.given('split_key')}, {q.given('Ref_DOI_number')}) AS key, coalesce({q.limits()} AND {q.ERROR} <= 5.0, false) AS good FROM ({q.TARGETS})), s AS (SELECT CASE WHEN good AND key IS NOT NULL THEN {q.split('key')} END AS split FROM v)
SELECT count(*) AS rows_read, count_if(split IS NULL) AS rows_skipped, count(split) AS rows_written, count_if(split = 'train') AS train, count_if(split = 'validation') AS validation, count_if(split = 'test') AS test FROM s""")
def build_summary(spark: SparkSession, d: str) -> DataFrame:
    return dataset.summary(table(spark, d, "devices"), dataset.Config(split_key="split_key"))


# --- profile and rare features --------------------------------------------------------------------------------------

_CELLS = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS column_name, {q.given(chr(34) + c + chr(34))} AS value FROM devices" for c in DEVICE_COLUMNS) + ") WHERE value IS NOT NULL"


@query(f"SELECT column_name, CAST(sum(n) AS BIGINT) AS nonempty, count(*) AS n_distinct FROM (SELECT column_name, value, count(*) AS n FROM ({_CELLS}) GROUP BY ALL) GROUP BY column_name")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.nonempty_counts(profile.value_counts(table(spark, d, "devices"), DEVICE_COLUMNS))


@query(f"SELECT column_name, value, count(*) AS value_count FROM ({_CELLS}) WHERE column_name IN ('Cell_architecture', 'source', 'JV_light_intensity', 'Perovskite_deposition_solvents') GROUP BY ALL")
def column_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(table(spark, d, "devices"), ["Cell_architecture", "source", "JV_light_intensity", "Perovskite_deposition_solvents"])


_USED = ("Cell_architecture", "Cell_stack_sequence", "Perovskite_composition_long_form")
_RARE = [c for c in DEVICE_COLUMNS if not profile.leaks(c) and c not in _USED]
_RARE_SQL = f"""WITH c AS ({_CELLS}), m AS (SELECT * FROM c WHERE column_name IN ({', '.join(f"'{c}'" for c in _RARE)})), v AS (SELECT column_name, value, count(*) AS vc FROM m GROUP BY ALL), n AS (SELECT column_name, sum(vc) AS ne FROM v GROUP BY ALL),
f AS (SELECT row_id, column_name, value, CAST(row_number() OVER (PARTITION BY row_id ORDER BY ne, vc, column_name) AS INTEGER) AS position FROM m JOIN v USING (column_name, value) JOIN n USING (column_name), (SELECT count(*) AS t FROM devices)
WHERE lower(value) NOT IN ('false', '0', '0.0') AND (ne / t < 0.2 OR vc / t < 0.02 OR lower(value) = 'true' OR regexp_matches(lower(column_name), '{'|'.join(profile.RARE_KEYWORDS)}')))"""


@query(f"{_RARE_SQL} SELECT row_id, position, column_name, value FROM f WHERE position <= 60")
def rare_features(spark: SparkSession, d: str) -> DataFrame:
    return profile.rare_features(table(spark, d, "devices"), "row_id", DEVICE_COLUMNS, _USED)


# --- prompts --------------------------------------------------------------------------------------------------------


def _lines(columns) -> str:
    return ", ".join(f"'- {prompts.label(c)}: ' || ({q.given(chr(34) + c + chr(34))})" for c in columns)


_PRIMARY = [c for c in prompts.PRIMARY_COLUMNS if c in DEVICE_COLUMNS]
_SECONDARY = [c for c in prompts.SECONDARY_COLUMNS if c in DEVICE_COLUMNS]
_CORE = f"concat_ws(chr(10), '{prompts.HEADER}', '', 'Core device recipe:', {_lines(_PRIMARY)})"


@query(f"SELECT row_id, {_CORE} AS prompt FROM devices")
def prompt_core(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "devices")
    return t.select("row_id", prompts.core_prompt(t).alias("prompt"))


@query(f"SELECT row_id, concat_ws(chr(10), {_CORE}, '', 'Secondary process and measurement details:', {_lines(_SECONDARY)}) AS prompt FROM devices")
def prompt_core_secondary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "devices")
    return t.select("row_id", prompts.core_secondary_prompt(t).alias("prompt"))


_FEATURES = f"{_RARE_SQL}, g AS (SELECT row_id, string_agg('- ' || lower(replace(column_name, '_', ' ')) || ': ' || value, chr(10) ORDER BY position) AS lines FROM f WHERE position <= 60 GROUP BY row_id)"


@query(f"{_FEATURES} SELECT row_id, {_CORE} || coalesce(chr(10) || chr(10) || 'Activated rare or special features:' || chr(10) || lines, '') AS prompt FROM devices LEFT JOIN g USING (row_id)")
def prompt_core_rare(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "devices")
    t = prompts.with_rare_features(t, "row_id", profile.rare_features(t, "row_id", DEVICE_COLUMNS, _USED))
    return t.select("row_id", prompts.core_rare_prompt(t).alias("prompt"))


def _sections() -> str:
    parts = []
    for title, prefixes in prompts.SECTIONS.items():
        columns = [c for c in DEVICE_COLUMNS if c.startswith(prefixes) and not profile.leaks(c) and (c in prompts.PRIMARY_COLUMNS or c in prompts.SECONDARY_COLUMNS)]
        if columns:
            parts.append(f"chr(10) || '{title}:' || chr(10) || nullif(concat_ws(chr(10), {_lines(columns)}), '')")
    return ", ".join(parts)


_UNPLACED = f"{_RARE_SQL}, g AS (SELECT row_id, string_agg('- ' || lower(replace(column_name, '_', ' ')) || ': ' || value, chr(10) ORDER BY position) AS lines FROM f WHERE position <= 60 AND column_name = 'split_key' OR position <= 60 AND column_name = 'source' GROUP BY row_id)"


@query(f"{_UNPLACED} SELECT row_id, concat_ws(chr(10), '{prompts.HEADER}', {_sections()}, chr(10) || 'Other activated features:' || chr(10) || lines) AS prompt FROM devices LEFT JOIN g USING (row_id)")
def prompt_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "devices")
    t = prompts.with_rare_features(t, "row_id", profile.rare_features(t, "row_id", DEVICE_COLUMNS, _USED))
    return t.select("row_id", prompts.hierarchical_prompt(t).alias("prompt"))


_SAID = "to_json({'prediction': {%s}})" % ", ".join([f"'{f}_bin': {q.binned(f, f)}" for f in targets.FIELDS] + [f"'{f}': round({f}, 4)" for f in targets.FIELDS])


@query(f"""SELECT row_id, {q.split('key')} AS split, key AS split_key, '{dataset.SYSTEM}' AS system, {_CORE} AS user, {_SAID} AS assistant FROM (SELECT *, {q.given('Ref_DOI_number')} AS key FROM ({q.VALID})) WHERE key IS NOT NULL""")
def chat_dataset(spark: SparkSession, d: str) -> DataFrame:
    e = dataset.examples(table(spark, d, "devices"), "row_id", dataset.Config(representation="core", schema="performance_only"))
    return e.select("row_id", "split", "metadata.split_key", *(F.element_at("messages", i).getField("content").alias(n) for i, n in enumerate(("system", "user", "assistant"), 1)))


# --- targets --------------------------------------------------------------------------------------------------------


@query(f"SELECT row_id, pce, voc, jsc, ff FROM ({q.VALID})")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return targets.valid_rows(table(spark, d, "devices")).select("row_id", *targets.FIELDS)


@query(f"SELECT row_id, {', '.join(f'{q.binned(f, f)} AS {f}_bin' for f in targets.FIELDS)} FROM ({q.TARGETS})")
def target_bins(spark: SparkSession, d: str) -> DataFrame:
    t = targets.with_targets(table(spark, d, "devices"))
    return t.select("row_id", *(targets.make_bin(f, F.col(f)).alias(f"{f}_bin") for f in targets.FIELDS))


_LACKING = " + ".join(f"""(coalesce(lower({q.stripped(chr(34) + c + chr(34))}), '') IN ({', '.join(repr(t) for t in MISSING_TOKENS)}))::INT""" for c in targets.PROCESS_COLUMNS)


@query(f"SELECT row_id, CASE WHEN {q.ERROR} <= 0.5 AND {_LACKING} <= 2 THEN 'high' WHEN {q.ERROR} <= 2 AND {_LACKING} <= 4 THEN 'medium' ELSE 'low' END AS confidence FROM ({q.VALID})")
def target_confidence(spark: SparkSession, d: str) -> DataFrame:
    v = targets.valid_rows(table(spark, d, "devices"))
    return v.select("row_id", targets.confidence(targets.consistency_error(*(F.col(f) for f in targets.FIELDS))).alias("confidence"))


def _said(c: str) -> str:
    return f"nullif({q.stripped(chr(34) + c + chr(34))}, '')"


@query(f"""SELECT row_id, array_to_string(list_filter(['The device architecture is ' || {_said('Cell_architecture')} || '.', 'The absorber composition is recorded as ' || coalesce({_said('Perovskite_composition_long_form')}, {_said('Perovskite_composition_short_form')}) || '.',
CASE WHEN {_said('Cell_stack_sequence')} IS NOT NULL THEN 'The layer stack provides device context for transport and contact layers.' END, 'The perovskite deposition procedure is ' || {_said('Perovskite_deposition_procedure')} || '.',
CASE WHEN coalesce({_said('Perovskite_deposition_thermal_annealing_temperature')}, {_said('Perovskite_deposition_thermal_annealing_time')}) IS NOT NULL THEN 'Annealing conditions are present in the input recipe.' END], lambda x: x IS NOT NULL), ' ') AS sentences FROM ({q.VALID})""")
def target_justification(spark: SparkSession, d: str) -> DataFrame:
    v = targets.valid_rows(table(spark, d, "devices"))
    said = targets.justification(targets.consistency_error(*(F.col(f) for f in targets.FIELDS)))
    # the sentence with the formatted number is tested apart, as SQL formats it otherwise
    return v.select("row_id", F.array_join(F.filter(said, lambda x: ~x.startswith("The predicted metrics")), " ").alias("sentences"))


# --- evaluation -----------------------------------------------------------------------------------------------------


def paired(spark: SparkSession, d: str) -> DataFrame:
    """Recorded targets with a plain rule's predictions: consistency for PCE, lines in the band gap for Voc and Jsc."""
    t = targets.with_targets(table(spark, d, "devices")).withColumn("gap", parse_float(F.col("Perovskite_band_gap")))
    rule = {"pce": F.col("voc") * F.col("jsc") * F.col("ff"), "voc": F.col("gap") * 0.6, "jsc": 30 - 5 * F.col("gap"), "ff": F.when(F.col("pce").isNotNull(), 0.7)}
    return t.select("row_id", *(F.col(f).alias(f"t_{f}") for f in targets.FIELDS), *(c.alias(f"p_{f}") for f, c in rule.items()))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


_BOTH = "truth IS NOT NULL AND pred IS NOT NULL"
_METRICS = f"count_if({_BOTH}) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(sqrt(avg((pred - truth) ^ 2)), 6) AS rmse, round(1 - sum((pred - truth) ^ 2) / nullif(regr_sxx(pred, truth), 0), 6) AS r2"


@query(f"SELECT field, {_METRICS} FROM ({q.LONG}) GROUP BY field")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.regression_metrics(ev.pairs(paired(spark, d))), "mae", "rmse", "r2")


@query(f"SELECT field, count_if({_BOTH}) AS n, round(count_if({_BOTH} AND {q.binned_by_field('truth')} = {q.binned_by_field('pred')}) / nullif(count_if({_BOTH}), 0), 6) AS accuracy FROM ({q.LONG}) GROUP BY field")
def bin_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.bin_accuracy(ev.pairs(paired(spark, d))), "accuracy")


_RATES = {"prediction_validity_rate": "pred IS NOT NULL", "truth_validity_rate": "truth IS NOT NULL", "comparable_rate": _BOTH, "missing_rate": "pred IS NULL"}


@query(f"SELECT field, count(pred) AS predicted_count, count(truth) AS truth_count, count_if({_BOTH}) AS comparable_count, {', '.join(f'round(count_if({c}) / count(*), 6) AS {n}' for n, c in _RATES.items())} FROM ({q.LONG}) GROUP BY field")
def field_validity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.field_validity(ev.pairs(paired(spark, d))), *_RATES)


_LABELS = " UNION ALL ".join(f"SELECT '{f}' AS field, unnest([{', '.join(repr(x) for x in targets.bin_labels(f))}]) AS bin" for f in targets.FIELDS)


@query(f"""WITH l AS ({_LABELS}), c AS (SELECT field, {q.binned_by_field('truth')} AS truth_bin, {q.binned_by_field('pred')} AS pred_bin, count(*) AS n FROM ({q.LONG}) WHERE {_BOTH} GROUP BY ALL)
SELECT a.field, a.bin AS truth_bin, b.bin AS pred_bin, coalesce(n, 0) AS n FROM l a JOIN l b ON a.field = b.field LEFT JOIN c ON c.field = a.field AND truth_bin = a.bin AND pred_bin = b.bin""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion_matrix(ev.pairs(paired(spark, d)))


@query(f"""WITH g AS (SELECT unnest(['low_pce_lt_5', 'mid_pce_5_to_15', 'high_pce_gte_15']) AS subgroup), f AS (SELECT unnest([{', '.join(repr(f) for f in targets.FIELDS)}]) AS field),
m AS (SELECT CASE WHEN t_pce < 5 THEN 'low_pce_lt_5' WHEN t_pce < 15 THEN 'mid_pce_5_to_15' ELSE 'high_pce_gte_15' END AS subgroup, field, {_METRICS} FROM ({q.LONG}) WHERE t_pce IS NOT NULL GROUP BY ALL)
SELECT subgroup, field, coalesce(n, 0) AS n, mae, rmse, r2 FROM g CROSS JOIN f LEFT JOIN m USING (subgroup, field)""")
def subgroup_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.subgroup_metrics(paired(spark, d)), "mae", "rmse", "r2")


@query(f"SELECT count(e) AS n, round(avg(e), 6) AS mae, round(max(e), 6) AS max_error FROM (SELECT abs(p_pce - p_voc * p_jsc * p_ff) AS e FROM ({q.PAIRED}))")
def physical_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.consistency_metrics(paired(spark, d)), "mae", "max_error")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """The checks of the assistants' answers in the chat examples."""
    t = table(spark, d, "chat_examples").select("example_id", sequences.first_of(F.col("messages"), "assistant").alias("prediction_text"), F.lit(None).cast("string").alias("ground_truth_text"))
    return ev.parsed_predictions(t, "example_id").select("example_id", "check")


_ANSWER = "SELECT example_id, (list_filter(messages, lambda m: m.role = 'assistant')[1].content)::JSON AS j FROM chat_examples"
_PARSED = "SELECT example_id, json_type(j -> 'prediction') = 'OBJECT' AS ok, " + ", ".join(f"{q.number(f'''(j -> 'prediction' ->> '{f}')''')} AS {f}, j -> 'prediction' ->> '{f}_bin' AS {f}_bin" for f in targets.FIELDS) + f" FROM ({_ANSWER})"
_BAD = {
    "range_violations": ", ".join(f"CASE WHEN {f} < {targets.LIMITS[f][0]} OR {f} > {targets.LIMITS[f][1]} THEN '{f}' END" for f in targets.FIELDS),
    "invalid_bin_labels": ", ".join(f"CASE WHEN {f}_bin NOT IN ({', '.join(repr(x) for x in targets.bin_labels(f))}) THEN '{f}_bin' END" for f in targets.FIELDS),
    "bin_mismatches": ", ".join(f"CASE WHEN {f}_bin IN ({', '.join(repr(x) for x in targets.bin_labels(f))}) AND {f}_bin <> {q.binned(f, f)} THEN '{f}_bin' END" for f in targets.FIELDS),
    "missing_fields": ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in targets.FIELDS),
}
_CHECKS = f"SELECT example_id, ok, {', '.join(f'list_filter([{x}], lambda v: v IS NOT NULL) AS {n}' for n, x in _BAD.items())}, {q.ERROR} AS error FROM ({_PARSED})"


@query(f"""SELECT example_id, len(range_violations) > 0 OR len(invalid_bin_labels) > 0 OR len(bin_mismatches) > 0 OR coalesce(error > 5, false) AS physically_inconsistent, len(missing_fields) = 0 AS schema_valid, round(error, 6) AS error,
{', '.join(f"array_to_string({n}, ',') AS {n}" for n in _BAD)} FROM ({_CHECKS})""")
def verify_predictions(spark: SparkSession, d: str) -> DataFrame:
    c = _checked(spark, d).select("example_id", "check.*")
    return c.select("example_id", "physically_inconsistent", "schema_valid", F.round("pce_consistency_error", 6).alias("error"), *(F.array_join(F.transform(n, lambda x: x["field"]), ",").alias(n) for n in ev.VIOLATIONS), F.array_join("missing_fields", ",").alias("missing_fields"))


_EACH = " UNION ALL ".join(f"SELECT '{v}' AS kind, unnest({v}) AS field FROM c" for v in ev.VIOLATIONS)


@query(f"WITH c AS ({_CHECKS}) SELECT kind, field, count(*) AS n FROM ({_EACH}) GROUP BY ALL")
def violation_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.violation_counts(_checked(spark, d))


@query(" UNION ALL ".join(f"SELECT row_id, '{f}' AS field, {f} AS value, {targets.LIMITS[f][0]} AS low, {targets.LIMITS[f][1]} AS high FROM ({q.TARGETS}) WHERE {f} < {targets.LIMITS[f][0]} OR {f} > {targets.LIMITS[f][1]}" for f in targets.FIELDS))
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    t = targets.with_targets(table(spark, d, "devices"))
    none = {f: F.lit(None).cast("string") for f in targets.FIELDS}
    check = ev.verification({f: F.col(f) for f in targets.FIELDS}, none, {f: F.lit(False) for f in targets.FIELDS}, F.lit(True))
    return ev.violations(t.select("row_id", check.alias("check")), "range_violations", "row_id")


_WRONG = "len(range_violations) > 0 OR len(invalid_bin_labels) > 0 OR len(bin_mismatches) > 0 OR coalesce(error > 5, false)"
_SUMMARY = f"SELECT count(*) AS n, count_if({_WRONG}) AS n_inconsistent, count_if(len(missing_fields) = 0) AS n_schema_valid, round(count_if({_WRONG}) / count(*), 6) AS inconsistent_rate, round(count_if(len(missing_fields) = 0) / count(*), 6) AS schema_valid_rate FROM ({_CHECKS})"


@query(_SUMMARY)
def verification_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.verification_summary(_checked(spark, d)), "inconsistent_rate", "schema_valid_rate")


@query(f"SELECT 'checks.' || metric AS metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({_SUMMARY})) ON COLUMNS(*) INTO NAME metric VALUE value)")
def flat_metrics(spark: SparkSession, d: str) -> DataFrame:
    row = _rounded(ev.verification_summary(_checked(spark, d)), "inconsistent_rate", "schema_valid_rate")
    return ev.flatten_metrics(row.select(F.struct("*").alias("checks")))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prediction records of the held-out examples: as prediction the answer of the first training example of their paper."""
    t = table(spark, d, "chat_examples").select("example_id", "split", F.col("metadata.split_key").alias("k"), sequences.first_of(F.col("messages"), "assistant").alias("answer"))
    known = t.where("split = 'train' AND k IS NOT NULL").groupBy("k").agg(F.min_by("answer", "example_id").alias("prediction_text"))
    return t.where("split <> 'train'").join(known, "k", "left").select("example_id", F.col("answer").alias("ground_truth_text"), "prediction_text")


_PREDICTED = f"""t AS (SELECT example_id, split, metadata.split_key AS k, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS answer FROM chat_examples), b AS (SELECT k, arg_min(answer, example_id) AS prediction FROM t WHERE split = 'train' AND k IS NOT NULL GROUP BY k),
j AS (SELECT example_id, answer::JSON AS tj, prediction::JSON AS pj FROM t LEFT JOIN b USING (k) WHERE split <> 'train'),
r AS (SELECT example_id, tj IS NOT NULL AS t_json, pj IS NOT NULL AS p_json, coalesce(json_type(pj -> 'prediction') = 'OBJECT', false) AS ok, {', '.join(f"{q.number(f"({x}j -> 'prediction' ->> '{f}')")} AS {x}_{f}" for x in "tp" for f in targets.FIELDS)}, {', '.join(f"pj -> 'prediction' ->> '{f}_bin' AS {f}_bin" for f in targets.FIELDS)} FROM j),
v AS (SELECT *, CASE WHEN ok THEN abs(p_pce - p_voc * p_jsc * p_ff) END AS error FROM r)"""


def _document_sql() -> str:
    """The document's metrics as columns of one row, turned into rows."""
    both = {f: f"t_{f} IS NOT NULL AND p_{f} IS NOT NULL" for f in targets.FIELDS}
    groups = dict(zip(ev.SUBGROUPS, ("t_pce < 5", "t_pce >= 5 AND t_pce < 15", "t_pce >= 15")))
    labels = {f: ", ".join(map(repr, targets.bin_labels(f))) for f in targets.FIELDS}
    n, out, few = "count(*)", {}, {}

    def rate(part: str, whole: str = n) -> str:
        return f"count_if({part}) / nullif({whole}, 0)"

    def errors(at: str, f: str, where: str = "true") -> None:
        w = f"FILTER (WHERE {both[f]} AND {where})"
        out[f"{at}.field_metrics.{f}.count"] = f"count(*) {w}"
        out[f"{at}.field_metrics.{f}.mae"] = f"avg(abs(p_{f} - t_{f})) {w}"
        out[f"{at}.field_metrics.{f}.rmse"] = f"sqrt(avg((p_{f} - t_{f}) ^ 2) {w})"
        out[f"{at}.field_metrics.{f}.r2"] = f"CASE WHEN min(t_{f}) {w} < max(t_{f}) {w} THEN 1 - sum((p_{f} - t_{f}) ^ 2) {w} / (var_pop(t_{f}) {w} * count(*) {w}) END"
        same = f"{q.binned(f, f't_{f}')} = {q.binned(f, f'p_{f}')}"
        out[f"{at}.bin_accuracy.{f}.count"] = f"count(*) {w}"
        out[f"{at}.bin_accuracy.{f}.accuracy"] = f"count_if({same}) {w} / nullif(count(*) {w}, 0)"

    out |= {"rows": n, "json_validity_rate": rate("p_json"), "ground_truth_validity_rate": rate("t_json")}
    for f in targets.FIELDS:
        for name, part in (("predicted_count", f"p_{f} IS NOT NULL"), ("truth_count", f"t_{f} IS NOT NULL"), ("comparable_count", both[f])):
            out[f"field_validity.{f}.{name}"] = f"count_if({part})"
        for name, part in (("prediction_validity_rate", f"p_{f} IS NOT NULL"), ("truth_validity_rate", f"t_{f} IS NOT NULL"), ("comparable_rate", both[f])):
            out[f"field_validity.{f}.{name}"] = rate(part)
        out[f"missing_prediction_rate.{f}"] = rate(f"p_{f} IS NULL")
        errors("", f)
        for a in targets.bin_labels(f):
            for b in targets.bin_labels(f):
                out[f"bin_confusion.{f}.{a}.{b}"] = f"count_if({q.binned(f, f't_{f}')} = '{a}' AND {q.binned(f, f'p_{f}')} = '{b}')"
        for g, where in groups.items():
            errors(f"pce_subgroups.{g}", f, where)
        few[f"range_violations.{f}"] = f"ok AND (p_{f} < {targets.LIMITS[f][0]} OR p_{f} > {targets.LIMITS[f][1]})"
        few[f"invalid_bin_labels.{f}_bin"] = f"ok AND {f}_bin NOT IN ({labels[f]})"
        few[f"bin_mismatches.{f}_bin"] = f"ok AND {f}_bin IN ({labels[f]}) AND {f}_bin <> {q.binned(f, f'p_{f}')}"
    for g, where in groups.items():
        out[f"pce_subgroups.{g}.rows"] = f"count_if({where})"
    wrong = " OR ".join(f"coalesce({x}, false)" for x in (*few.values(), "error > 5"))
    at = "physics_verification"
    out |= {f"{at}.physically_inconsistent_count": f"count_if(NOT ok OR {wrong})", f"{at}.physically_inconsistent_rate": rate(f"NOT ok OR {wrong}")}
    invalid = " OR ".join(f"p_{f} IS NULL" for f in targets.FIELDS)
    out |= {f"{at}.schema_invalid_count": f"count_if(NOT ok OR {invalid})", f"{at}.schema_invalid_rate": rate(f"NOT ok OR {invalid}")}
    for name, x in (("count", "count(error)"), ("mae", "avg(error)"), ("max", "max(error)")):
        out[f"{at}.pce_consistency_{name}"] = out[f"physical_consistency.{name}"] = x
    columns = ", ".join(f'round(CAST({x} AS DOUBLE), 6) AS "{k.lstrip(".")}"' for k, x in out.items())
    counts = ", ".join(f'CAST(nullif(count_if({x}), 0) AS DOUBLE) AS "{at}.{k}"' for k, x in few.items())
    names = ", ".join(f'"{k.lstrip(".")}"' for k in out)
    return f"""WITH {_PREDICTED} SELECT metric, value FROM (SELECT {columns} FROM v) UNPIVOT INCLUDE NULLS (value FOR metric IN ({names}))
UNION ALL SELECT metric, value FROM (UNPIVOT (SELECT {counts} FROM v) ON COLUMNS(*) INTO NAME metric VALUE value)"""


@query(_document_sql())
def metrics_document(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.metrics_table(spark, ev.compute_metrics(_predictions(spark, d))), "value")


_OWN_LABELS = " UNION ALL ".join(f"""SELECT example_id, '{f}_bin' AS field, {f}_bin AS value, {q.binned(f, f't_{f}')} AS expected FROM v WHERE {f}_bin IN ({', '.join(map(repr, targets.bin_labels(f)))}) AND {f}_bin <> {q.binned(f, f't_{f}')}""" for f in targets.FIELDS)


@query(f"WITH {_PREDICTED} {_OWN_LABELS}")
def bin_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the baseline that don't fit the recorded numbers."""
    rows = _predictions(spark, d).select("example_id", parse_object(F.col("ground_truth_text"))["prediction"].alias("t"), parse_object(F.col("prediction_text"))["prediction"].alias("p"))
    values = {f: parse_float(F.try_element_at("t", F.lit(f))) for f in targets.FIELDS}
    labels = {f: F.try_element_at("p", F.lit(f"{f}_bin")) for f in targets.FIELDS}
    check = ev.verification(values, labels, {f: labels[f].isNotNull() for f in targets.FIELDS}, F.lit(True))
    return ev.violations(rows.select("example_id", check.alias("check")), "bin_mismatches", "example_id")


@query("SELECT example_id, '<|system|>' || chr(10) || messages[1].content || chr(10) || '<|user|>' || chr(10) || messages[2].content || chr(10) || '<|assistant|>' || chr(10) AS prompt, messages[3].content AS answer FROM chat_examples")
def chat_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_examples").select("example_id", sequences.sft_prompt(F.col("messages")).alias("prompt"), sequences.first_of(F.col("messages"), "assistant").alias("answer"))


_TEXT = "CASE WHEN event_id % 4 = 0 THEN 'So: ' || props || ' as asked.' WHEN event_id % 4 = 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN event_id % 4 = 2 THEN '[' || event_id || ']' ELSE props END"


@query("SELECT event_id, CASE WHEN event_id % 4 <> 2 THEN (props::JSON ->> 'k')::BIGINT END AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """The objects of answers that are plain, fenced, within prose or no object."""
    return table(spark, d, "events").select("event_id", parse_object(F.expr(_TEXT.replace("chr(10)", "char(10)")), "struct<k:bigint>")["k"].alias("k"))


# --- retrieval and grounding ----------------------------------------------------------------------------------------


_TRIM = f"trim({{0}}, {q._BLANKS})"
_BM25 = f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''), b AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS block, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM d),
s AS (SELECT doc_id, i, CASE WHEN length({_TRIM.format('block')}) > 3000 THEN string_split({_TRIM.format('block')}, chr(10)) ELSE [{_TRIM.format('block')}] END AS parts FROM b), u AS (SELECT doc_id, i, unnest(parts) AS part, unnest(range(len(parts))) AS j FROM s),
p AS (SELECT doc_id, i, {_TRIM.format('part')} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos FROM u WHERE length({_TRIM.format('part')}) >= 80),
w AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM p), tf AS (SELECT doc_id, pos, term, count(*) AS f FROM w GROUP BY ALL), dl AS (SELECT doc_id, pos, count(*) AS dl FROM w GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY ALL), av AS (SELECT doc_id, sum(dl) / n AS av FROM dl JOIN n USING (doc_id) GROUP BY doc_id, n), df AS (SELECT doc_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN n USING (doc_id) GROUP BY doc_id, term, n),
m AS (SELECT doc_id, 0.25 * avg(idf) AS floor FROM df GROUP BY ALL), qy AS (SELECT unnest(string_split(lower('{retrieval.QUERY}'), ' ')) AS term),
sc AS (SELECT doc_id, pos, sum(CASE WHEN idf >= 0 THEN idf ELSE floor END * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / av))) AS s FROM qy JOIN tf USING (term) JOIN df USING (doc_id, term) JOIN m USING (doc_id) JOIN dl USING (doc_id, pos) JOIN av USING (doc_id) GROUP BY ALL),
r AS (SELECT p.doc_id, i, p.pos, t, row_number() OVER (PARTITION BY p.doc_id ORDER BY round(coalesce(s, 0), 9) DESC, p.pos) AS rank FROM p LEFT JOIN sc ON sc.doc_id = p.doc_id AND sc.pos = p.pos),
c AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i, rank ROWS UNBOUNDED PRECEDING) AS c FROM r WHERE rank <= 14),
k AS (SELECT *, CASE WHEN c <= 10000 THEN t WHEN c - length(t) <= 10000 AND 10000 - (c - length(t)) > 200 THEN substr(t, 1, (10000 - (c - length(t)))::BIGINT) END AS piece FROM c),
g AS (SELECT doc_id, count(piece) AS n_paragraphs, string_agg(piece, chr(10) || chr(10) ORDER BY i, rank) AS context FROM k GROUP BY ALL)
SELECT doc_id, coalesce(n_paragraphs, 0)::INTEGER AS n_paragraphs, coalesce(context, substr(documents.text, 1, 10000), '') AS context FROM documents LEFT JOIN g USING (doc_id)"""


@query(_BM25)
def bm25_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_context(table(spark, d, "documents"), "doc_id", "text")


_LEAVES = " UNION ALL ".join(f"SELECT record_id, '{p}' AS path, {'nullif(len(precursors), 0)::VARCHAR' if p == 'precursors' else p} AS value, {'NULL' if p == 'precursors' else p} AS source, key_findings AS f FROM extractions" for p in grounding.WEIGHTS)
_LEAF = f"SELECT record_id, path, value, CASE WHEN value IS NULL THEN 'false' WHEN path LIKE 'characterization.%' THEN 'table' WHEN contains(lower(f), lower(value)) THEN 'true' WHEN length(value) < 3 THEN NULL ELSE 'false' END AS grounded FROM ({_LEAVES})"


def _leaf_table(spark: SparkSession, d: str, *keep: str, each_precursor: bool = False) -> DataFrame:
    t = grounding.leaves(table(spark, d, "extractions"), "record_id", F.col("key_findings").alias("f"), *keep, each_precursor=each_precursor)
    g = F.when(F.col("value").isNull(), "false").when(F.col("path").startswith("characterization."), "table").when(F.coalesce(F.contains(F.lower("f"), F.lower("value")), F.lit(False)), "true").when(F.length("value") < 3, None).otherwise("false")
    return t.select("record_id", *keep, "path", "value", g.alias("grounded"))


_W = "CASE path " + " ".join(f"WHEN '{p}' THEN {w}" for p, w in grounding.WEIGHTS.items()) + " END"
_GIVEN = "(value IS NOT NULL AND value NOT IN ('', '[]'))"
_SURE = "coalesce(grounded IN ('true', 'table'), false)"
_NEEDED = ", ".join(repr(p) for p in {**grounding.CRITICAL, **grounding.IMPORTANT})


_EACH_LEAF = f"""SELECT record_id, path, value, grounded FROM ({_LEAF}) WHERE path <> 'precursors' UNION ALL SELECT record_id, 'precursors', v, CASE WHEN v IS NULL THEN 'false' WHEN contains(lower(f), lower(v)) THEN 'true' WHEN length(v) < 3 THEN NULL ELSE 'false' END
FROM (SELECT record_id, key_findings AS f, unnest(list_transform(precursors, lambda p: coalesce(p.name, p.concentration))) AS v FROM extractions)"""
_ONE = "path = 'precursors'"
_CRITICAL = ", ".join(map(repr, grounding.CRITICAL))


@query(f"""WITH l AS (SELECT *, coalesce(value NOT IN ('', '[]'), false) AS given, {_SURE} AS sure FROM ({_EACH_LEAF})), s AS (SELECT record_id, coalesce(is_perovskite_synthesis, false) AS counts FROM extractions),
r AS (SELECT record_id, any_value(counts) AS counts, count_if(given AND NOT {_ONE} AND path IN ({_NEEDED})) + coalesce(max((given AND {_ONE})::INT), 0) AS present, list(DISTINCT path) FILTER (WHERE given) AS has, count_if(given AND ({_ONE} OR grounded IS NOT NULL)) AS told,
count_if(given AND CASE WHEN {_ONE} THEN coalesce(grounded = 'true', false) ELSE sure END) AS good, sum(CASE WHEN given AND NOT {_ONE} THEN {_W} * CASE WHEN sure THEN 1 ELSE 0.5 END ELSE 0 END) + 3.0 * CASE WHEN max((given AND {_ONE})::INT) = 1 THEN CASE WHEN max((sure AND {_ONE})::INT) = 1 THEN 1 ELSE 0.5 END ELSE 0 END AS earned FROM l JOIN s USING (record_id) GROUP BY record_id)
SELECT record_id, CASE WHEN counts THEN round(present / 9, 6) END AS completeness, CASE WHEN counts THEN array_to_string(list_filter([{_CRITICAL}], lambda p: NOT coalesce(list_contains(has, p), false)), ',') ELSE '' END AS missing_critical, round(coalesce(good / nullif(told, 0), 0), 6) AS grounding_precision, round(earned / {sum(grounding.WEIGHTS.values())}, 6) AS weighted_score FROM r""")
def record_scores(spark: SparkSession, d: str) -> DataFrame:
    leaf = _leaf_table(spark, d, "is_perovskite_synthesis", each_precursor=True)
    return _rounded(grounding.record_scores(leaf, "record_id", "is_perovskite_synthesis"), "completeness", "grounding_precision", "weighted_score")


@query(f"""SELECT record_id, count_if(grounded = 'true') AS grounded_fields, count(value) AS total_fields, round(coalesce(count_if(grounded = 'true') / nullif(count(value) - count_if(value IS NOT NULL AND grounded IS NULL), 0), 0), 6) AS grounding_score FROM ({_LEAF}) GROUP BY record_id""")
def grounding_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(grounding.grounding_score(_leaf_table(spark, d), "record_id"), "grounding_score")


@query(f"""WITH t AS (SELECT doc_id, text, substr(text, 11, 40) AS source FROM documents WHERE regexp_full_match(text, '[\x20-\x7E\n]{{{{60,}}}}')) SELECT doc_id, strpos(lower(text), lower(trim(source))) - 1 AS norm_start, strpos(lower(text), lower(trim(source))) - 1 + length(trim(source)) AS norm_end FROM t WHERE length(trim(source)) >= 20 AND NOT starts_with(trim(source), 'Table')""".replace("{{", "{").replace("}}", "}"))
def exact_span(spark: SparkSession, d: str) -> DataFrame:
    """Where a piece of a document stands in it, by the operator that grounds values."""
    t = table(spark, d, "documents").where(F.col("text").rlike(r"\A[\x20-\x7E\n]{60,}\z")).select("doc_id", "text", F.substring("text", 11, 40).alias("source"))
    return grounding.ground(t, "source", "text").where("norm_start IS NOT NULL").select("doc_id", F.col("norm_start").cast("bigint").alias("norm_start"), F.col("norm_end").cast("bigint").alias("norm_end"))


@query()
def nfkc_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "devices").select("row_id", grounding.plain_text(F.col("Cell_stack_sequence")).alias("plain"))


@query()
def fuzzy_ground(spark: SparkSession, d: str) -> DataFrame:
    """Titles looked for in what their record found: few stand there, so most are searched by windows."""
    return grounding.ground(table(spark, d, "extractions").select("record_id", "title", "key_findings"), "title", "key_findings").select("record_id", "grounded", "norm_start", "norm_end")


# --- votes and corrections ------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT doi, nullif(lower(trim(synthesis_method)), '') AS k, count(*) AS votes, min(record_id) AS r FROM extractions GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY (k IS NULL)::INT, votes DESC, r) AS n FROM v)
SELECT b.doi, CASE WHEN k IS NOT NULL THEN e.synthesis_method END AS value, CASE WHEN k IS NULL THEN 0 ELSE votes END AS votes FROM b JOIN extractions e ON e.record_id = b.r WHERE n = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "extractions").select("doi", F.col("record_id").alias("run"), F.col("synthesis_method").alias("value"))
    return voting.majority(runs, ["doi"])


@query("SELECT doi, record_id AS run, coalesce(len(precursors), 0) AS size FROM extractions QUALIFY row_number() OVER (PARTITION BY doi ORDER BY coalesce(len(precursors), 0) DESC, record_id) = 1")
def longest_list(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "extractions").withColumnRenamed("record_id", "run")
    return voting.longest_list(t, ["doi"], "precursors").select("doi", "run", F.col("size").cast("bigint").alias("size"))


@query("""SELECT user_id, round(count_if(value > 10 AND event_type <> 'error') / nullif(count_if(event_type <> 'error'), 0), 2) AS stability, CASE WHEN count_if(event_type <> 'error') >= 2 THEN count_if(value > 10 AND event_type <> 'error') / count_if(event_type <> 'error') >= 0.5 END AS stable FROM events GROUP BY user_id""")
def probe_stability(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("answered"), (F.col("value") > 10).alias("matches"))
    return voting.probe_stability(t, ["user_id"])


@query(f"""WITH c AS (SELECT record_id, 'substrate' AS path, upper(substrate) AS correction FROM extractions WHERE substrate IS NOT NULL)
SELECT record_id, path, coalesce(correction, value) AS value, CASE WHEN correction IS NOT NULL THEN value END AS value_original FROM ({_LEAF}) LEFT JOIN c USING (record_id, path)""")
def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "extractions").select("record_id", F.lit("substrate").alias("path"), F.upper("substrate").alias("correction"))
    return voting.apply_corrections(_leaf_table(spark, d), c, ["record_id", "path"]).select("record_id", "path", "value", "value_original")


@query("""WITH p AS (SELECT record_id, unnest(precursors).name AS name FROM extractions), s AS (SELECT DISTINCT lower(trim(name)) AS k FROM p WHERE name LIKE 'Pb%')
SELECT record_id, name, k IS NOT NULL AS suspect, count(*) AS n FROM p LEFT JOIN s ON lower(trim(name)) = k GROUP BY ALL""")
def suspect_precursors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "extractions").select("record_id", F.explode("precursors").alias("x")).select("record_id", "x.name")
    out = voting.flag_suspects(p, p.where(F.col("name").startswith("Pb")), [], "name")
    return out.groupBy("record_id", "name", "suspect").agg(F.count("*").alias("n"))


# --- attention ------------------------------------------------------------------------------------------------------

HEADS, SIZE = 4, 16
_X = f"SELECT label AS b, h, vec_id AS pos, list_slice(embedding::DOUBLE[], h * {SIZE} + 1, h * {SIZE} + {SIZE}) AS vec FROM embeddings, (SELECT unnest(range({HEADS}))::INT AS h)"


def _attention_sql(where: str) -> str:
    return f"""WITH x AS ({_X}), s AS (SELECT q.b, q.h, q.pos AS qpos, k.vec, list_dot_product(q.vec, k.vec) / 4.0 AS s FROM x q JOIN x k ON q.b = k.b AND q.h = k.h AND ({where})), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY b, h, qpos)) AS e FROM s)
SELECT b, h, qpos, d::INT AS d, round(sum(e * vec[d + 1]) / sum(e), 4) AS value FROM e, (SELECT unnest(range({SIZE})) AS d) GROUP BY ALL"""


def _x(spark: SparkSession, d: str) -> DataFrame:
    return att.split_heads(table(spark, d, "embeddings"), "label", "vec_id", "embedding", HEADS, SIZE)


def _attended(links: DataFrame, x: DataFrame) -> DataFrame:
    return att.attend(links, x, SIZE).withColumn("value", F.round("value", 4))


@query(_attention_sql("true"))
def attention_full(spark: SparkSession, d: str) -> DataFrame:
    x = _x(spark, d)
    return _attended(att.links_all(x), x)


@query(_attention_sql("k.pos <= q.pos"))
def attention_causal(spark: SparkSession, d: str) -> DataFrame:
    x = _x(spark, d)
    return _attended(att.links_all(x, causal=True), x)


@query(_attention_sql("abs(k.pos - q.pos) <= 25"))
def attention_local(spark: SparkSession, d: str) -> DataFrame:
    x = _x(spark, d)
    return _attended(att.links_local(x, 25), x)


_RANDOM = " OR ".join(f"k.pos = (q.pos * {att.RANDOM_A} + {o} * {att.RANDOM_B}) % (SELECT max(vec_id) + 1 FROM embeddings)" for o in range(1, 9))


@query(_attention_sql(f"abs(k.pos - q.pos) <= 25 OR k.pos < 20 OR q.pos < 20 OR {_RANDOM}"))
def attention_sparse(spark: SparkSession, d: str) -> DataFrame:
    x = _x(spark, d)
    return _attended(att.links_sparse(x, 25, 20, 8, att.length(x)), x)


@query(f"""WITH x AS ({_X}), f AS (SELECT b, h, pos, vec, list_transform(vec, lambda v: CASE WHEN v > 0 THEN v + 1 ELSE exp(v) END) AS f FROM x), s AS (SELECT q.b, q.h, q.pos AS qpos, k.vec, list_dot_product(q.f, k.f) AS w FROM f q JOIN f k ON q.b = k.b AND q.h = k.h)
SELECT b, h, qpos, d::INT AS d, round(sum(w * vec[d + 1]) / sum(w), 4) AS value FROM s, (SELECT unnest(range({SIZE})) AS d) GROUP BY ALL""")
def attention_linear(spark: SparkSession, d: str) -> DataFrame:
    return att.attend_linear(_x(spark, d)).withColumn("value", F.round("value", 4))


@query(_attention_sql("k.pos % 10 <> 9"))
def attention_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth position is padding."""
    x = _x(spark, d)
    return _attended(att.masked(att.links_all(x), x.where("pos % 10 <> 9").select("b", "pos").distinct()), x)


@query(_attention_sql("true"))
def attention_blocked(spark: SparkSession, d: str) -> DataFrame:
    x = _x(spark, d)
    return att.attend_blocked(x, x, SIZE, 64).withColumn("value", F.round("value", 4))


@query(f"""WITH x AS ({_X}), s AS (SELECT q.b, q.h, q.pos AS qpos, q.vec AS q, k.vec, list_dot_product(q.vec, k.vec) / 4.0 AS s FROM x q JOIN x k ON q.b = k.b AND q.h = k.h), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY b, h, qpos)) AS e FROM s),
o AS (SELECT b, h, qpos, d::INT AS d, sum(e * vec[d + 1]) / sum(e) AS value FROM e, (SELECT unnest(range({SIZE})) AS d) GROUP BY ALL), y AS (SELECT b, h, qpos AS pos, list(value ORDER BY d) AS vec FROM o GROUP BY ALL),
s2 AS (SELECT q.b, q.h, q.pos AS qpos, k.vec, list_dot_product(q.vec, k.vec) / 4.0 AS s FROM x q JOIN y k ON q.b = k.b AND q.h = k.h), e2 AS (SELECT *, exp(s - max(s) OVER (PARTITION BY b, h, qpos)) AS e FROM s2),
c AS (SELECT b, h, qpos, d::INT AS d, sum(e * vec[d + 1]) / sum(e) AS value FROM e2, (SELECT unnest(range({SIZE})) AS d) GROUP BY ALL) SELECT b, h, qpos, d, round(o.value + c.value, 4) AS value FROM o JOIN c USING (b, h, qpos, d)""")
def attention_co(spark: SparkSession, d: str) -> DataFrame:
    x = _x(spark, d)
    return att.co_attend(x, x, x, SIZE).withColumn("value", F.round("value", 4))


@query("SELECT label AS b, vec_id AS pos, unnest(range(len(embedding)))::INT AS i, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def heads_round_trip(spark: SparkSession, d: str) -> DataFrame:
    x = _x(spark, d).select("b", "h", F.col("pos").alias("qpos"), F.posexplode("vec").alias("d", "value"))
    return att.merge_heads(x, SIZE).select("b", "pos", F.posexplode("vec").alias("i", "value")).withColumn("value", F.round("value", 6))


_PADDED_X = f"SELECT *, pos % 10 <> 9 AND b <> 0 AS valid FROM ({_X})"


@query(f"""WITH x AS ({_PADDED_X}), s AS (SELECT q.b, q.h, q.pos AS qpos, k.vec, k.valid, max(k.valid::INT) OVER (PARTITION BY q.b, q.h, q.pos) AS held, list_dot_product(q.vec, k.vec) / 4.0 AS s FROM x q JOIN x k ON q.b = k.b AND q.h = k.h),
m AS (SELECT b, h, qpos, vec, CASE WHEN held = 1 THEN s ELSE 0 END AS s FROM s WHERE valid OR held = 0), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY b, h, qpos)) AS e FROM m)
SELECT b, h, qpos, d::INT AS d, round(sum(e * vec[d + 1]) / sum(e), 4) AS value FROM e, (SELECT unnest(range({SIZE})) AS d) GROUP BY ALL""")
def attention_padded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth position and all of batch 0 are padding: there each query gets the average."""
    x = _x(spark, d)
    return _attended(att.masked(att.links_all(x), x.where("pos % 10 <> 9 AND b <> 0").select("b", "pos").distinct()), x)


@query(_attention_sql("k.pos % 2 = q.pos % 2"))
def attention_pair_mask(spark: SparkSession, d: str) -> DataFrame:
    """A mask of pairs: even positions see even ones, odd see odd."""
    x = _x(spark, d)
    links = att.links_all(x)
    return _attended(att.masked_pairs(links, links.where("pmod(qpos, 2) = pmod(kpos, 2)").select("b", "qpos", "kpos").distinct()), x)


@query(f"""WITH x AS ({_PADDED_X}), z AS (SELECT b, h, pos, vec AS q, CASE WHEN valid THEN vec ELSE list_transform(vec, lambda v: 0.0) END AS k FROM x),
f AS (SELECT b, h, pos, k AS vec, list_transform(q, lambda v: CASE WHEN v > 0 THEN v + 1 ELSE exp(v) END) AS q, list_transform(k, lambda v: CASE WHEN v > 0 THEN v + 1 ELSE exp(v) END) AS f FROM z),
s AS (SELECT q.b, q.h, q.pos AS qpos, k.vec, list_dot_product(q.q, k.f) AS w FROM f q JOIN f k ON q.b = k.b AND q.h = k.h)
SELECT b, h, qpos, d::INT AS d, round(sum(w * vec[d + 1]) / sum(w), 4) AS value FROM s, (SELECT unnest(range({SIZE})) AS d) GROUP BY ALL""")
def attention_linear_padded(spark: SparkSession, d: str) -> DataFrame:
    x = _x(spark, d)
    return att.attend_linear(x, valid=x.where("pos % 10 <> 9 AND b <> 0").select("b", "pos").distinct()).withColumn("value", F.round("value", 4))


# --- sequences ------------------------------------------------------------------------------------------------------

_IDS = "list_transform(string_split(coalesce({0}, ''), ' '), lambda w: length(w)::INT)"


def _ids(c) -> F.Column:
    return F.transform(F.split(c, " ", -1), lambda w: F.length(w))


_P, _A = _IDS.format("messages[2].content"), _IDS.format("messages[3].content")


@query(f"""WITH t AS (SELECT example_id, {_P} AS p, {_A} AS a FROM chat_examples), k AS (SELECT example_id, list_slice(a, 1, 64) AS a, list_slice(p, greatest(len(p) - greatest(64 - len(a), 0), 0) + 1, CASE WHEN len(a) < 64 THEN len(p) ELSE 0 END) AS p FROM t)
SELECT example_id, array_to_string(list_concat(p, a), ' ') AS input_ids, array_to_string(list_concat(list_transform(p, lambda x: -100), a), ' ') AS labels FROM k""")
def completion_only(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chat_examples").select("example_id", _ids(sequences.first_of(F.col("messages"), "user")).alias("p"), _ids(sequences.first_of(F.col("messages"), "assistant")).alias("a"))
    t = t.select("example_id", sequences.completion_only(F.col("p"), F.col("a"), F.transform("a", lambda x: F.lit(1.0)), 64).alias("s"))
    return t.select("example_id", *(F.array_join(F.col(f"s.{n}").cast("array<string>"), " ").alias(n) for n in ("input_ids", "labels")))


@query(f"""WITH t AS (SELECT example_id, {_A} AS a, row_number() OVER (ORDER BY example_id) - 1 AS i FROM chat_examples), b AS (SELECT *, i // 32 AS batch FROM t)
SELECT example_id, i AS index, batch, array_to_string(list_resize(a, max(len(a)) OVER (PARTITION BY batch), 0), ' ') AS padded FROM b""")
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chat_examples").select("example_id", _ids(sequences.first_of(F.col("messages"), "assistant")).alias("a"))
    p = sequences.padded(sequences.batches(t, ["example_id"], 32), "batch", "a", 0)
    return p.select("example_id", "index", "batch", F.array_join(F.col("padded").cast("array<string>"), " ").alias("padded"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS index FROM events QUALIFY index < 100")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The row limit of a run: the first hundred in a stated order."""
    return sequences.first_rows(table(spark, d, "events"), [F.desc("ts"), "event_id"], 100).select("event_id", "index")


@query("""WITH t AS (SELECT l_returnflag, l_discount AS l, lead(l_linenumber) OVER w AS n, lead(l_tax) OVER w AS t FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_returnflag, round(sum(l * t) / greatest(sum(t), 1.0), 6) AS weighted_loss FROM t WHERE n IS NOT NULL AND n <> -100 GROUP BY ALL""")
def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return _rounded(sequences.weighted_loss(t, "l_orderkey", "at", "l_discount", "l_linenumber", "l_tax", "l_returnflag"), "weighted_loss")


# --- documents ------------------------------------------------------------------------------------------------------

_ROW = "array_to_string(list_transform({0}, lambda c: trim(coalesce(c, ''))), ' | ')"


@query(f"""WITH t AS (SELECT paper_id, unnest(tables) AS t FROM parsed_papers) SELECT paper_id, t.table_index AS table_index, {_ROW.format('t.headers')} || chr(10) || repeat('-', greatest(length({_ROW.format('t.headers')}), 20)) || chr(10) || array_to_string(list_transform(t.rows, lambda r: {_ROW.format('r')}), chr(10)) AS rendered FROM t WHERE len(t.rows) > 0""")
def table_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "parsed_papers").select("paper_id", F.explode("tables").alias("t"))
    return t.select("paper_id", "t.table_index", ingest.table_text(F.col("t.headers"), F.col("t.rows")).alias("rendered")).where("rendered IS NOT NULL")


_FIELDS = ("title", "material", "synthesis_method", "process_conditions.temperature", "process_conditions.duration", "substrate")
_PRECURSOR = "list_transform(coalesce(precursors, []), lambda p: '  precursor: ' || coalesce(p.name, 'None') || ' | conc: ' || coalesce(p.concentration, 'None'))"


@query(f"""SELECT record_id, array_to_string(list_concat(list_filter([{', '.join(f"'{f}: ' || {f}" for f in _FIELDS)}], lambda v: v IS NOT NULL), {_PRECURSOR}), chr(10)) AS record FROM extractions""")
def record_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions").select("record_id", review.record_text({f: F.col(f) for f in _FIELDS}, F.col("precursors")).alias("record"))


_SHOWN = ", ".join(f"'{f}: ' || coalesce({f}, 'None') || ' (source: ' || substr(coalesce(key_findings, ''), 1, {100 if '.' in f else 120}) || ')'" for f in _FIELDS)


@query(f"SELECT record_id, array_to_string(list_concat([{_SHOWN}], list_transform(coalesce(precursors, []), lambda p: '  precursor: ' || coalesce(p.name, 'None') || ' | conc: ' || coalesce(p.concentration, 'None') || ' | source: ' || substr(coalesce(title, ''), 1, 100))), chr(10)) AS record FROM extractions")
def record_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Records with the starts of their sources."""
    sources = F.transform("precursors", lambda p: F.col("title"))
    return table(spark, d, "extractions").select("record_id", review.record_text({f: F.col(f) for f in _FIELDS}, F.col("precursors"), {f: F.col("key_findings") for f in _FIELDS}, sources).alias("record"))


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{n}'" for n, p in ingest.HEADINGS) + " ELSE 'other' END"


@query(f"SELECT {_CLASS} AS section, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM parsed_papers) GROUP BY ALL")
def section_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the papers classified as if it were a heading."""
    lines = table(spark, d, "parsed_papers").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(ingest.classify_heading(F.col("line")).alias("section")).agg(F.count("*").alias("n"))


_BLOCKS = """SELECT paper_id AS doc_id, (i // 40)::INT AS page, 600.0 AS page_width, CASE WHEN i % 3 = 2 THEN 320.0 ELSE 40.0 END AS x0, (i % 40) * 20.0 AS y0, (i % 40) * 20.0 + 12 AS y1, CASE WHEN i % 5 = 4 THEN 'Figure ' || (i // 5) || '. ' || line ELSE line END AS text
FROM (SELECT paper_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM parsed_papers)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the papers laid out as blocks of pages, every fifth a caption."""
    t = table(spark, d, "parsed_papers").select("paper_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    text = F.when(F.col("i") % 5 == 4, F.concat(F.lit("Figure "), F.floor(F.col("i") / 5).cast("string"), F.lit(". "), F.col("line"))).otherwise(F.col("line"))
    y = (F.col("i") % 40) * 20.0
    return t.select(F.col("paper_id").alias("doc_id"), F.floor(F.col("i") / 40).cast("int").alias("page"), F.lit(600.0).alias("page_width"), F.when(F.col("i") % 3 == 2, 320.0).otherwise(40.0).alias("x0"), y.alias("y0"), (y + 12).alias("y1"), text.alias("text"))


@query(f"SELECT doc_id, page, '[Page ' || page || ']' || chr(10) || string_agg(trim(text), chr(10) ORDER BY x0 >= page_width / 2, y0) AS page_text FROM ({_BLOCKS}) WHERE trim(text) <> '' GROUP BY doc_id, page")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return ingest.page_text(_blocks(spark, d))


_IMAGES = "SELECT DISTINCT doc_id, page, 1 AS image_no, 300 + page AS width, 190 + 10 * page AS height, 30.0 + 97 * page AS y1 FROM (SELECT doc_id, page FROM b)"


def _images(b: DataFrame) -> DataFrame:
    return b.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(1).alias("image_no"), (300 + F.col("page")).alias("width"), (190 + 10 * F.col("page")).alias("height"), (30.0 + 97 * F.col("page")).alias("y1"))


_IS_CAPTION = "regexp_matches({0}, '(?i)^\\s*fig(ure)?\\.?\\s*[0-9]+[a-z]?\\s*([.:|–—]|\\s\\s|$)')"
_FOUND = f"""SELECT i.doc_id, i.page, i.image_no, i.width, i.height, i.y1, coalesce(trim(c.text), '') AS caption FROM ({_IMAGES}) i LEFT JOIN b c ON c.doc_id = i.doc_id AND c.page = i.page AND c.y0 > i.y1 AND c.y0 < i.y1 + 150 WHERE i.width >= 200 AND i.height >= 200
QUALIFY row_number() OVER (PARTITION BY i.doc_id, i.page, i.image_no ORDER BY coalesce({_IS_CAPTION.format('c.text')}, false) DESC, c.y0, trim(c.text)) = 1"""


@query(f"WITH b AS ({_BLOCKS}) {_FOUND}")
def caption_range_join(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return ingest.captions_below(_images(b), b)


@query(f"""WITH b AS ({_BLOCKS}), f AS ({_FOUND}), c AS (SELECT doc_id, page, y0 AS caption_y, trim(text) AS caption FROM b WHERE {_IS_CAPTION.format('text')}) SELECT c.doc_id, c.page, c.caption, c.caption_y, coalesce(max(b.y1) FILTER (WHERE b.y1 < c.caption_y - 5), 0) + 2 AS region_top
FROM c ANTI JOIN f USING (doc_id, page, caption) JOIN b ON b.doc_id = c.doc_id AND b.page = c.page GROUP BY ALL HAVING c.caption_y - region_top >= 5""")
def uncovered_captions(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return ingest.uncovered_captions(b, ingest.captions_below(_images(b), b), least=5.0)  # lines stand close here


@query("""WITH f AS (SELECT doc_id, source, coalesce(section, 'none') AS caption, coalesce(n_chars, 0) AS size, 1 AS page FROM documents), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source, caption ORDER BY size DESC, doc_id) = 1)
SELECT source, caption, doc_id, size, CAST(row_number() OVER (PARTITION BY source ORDER BY page, caption) AS INTEGER) AS figure_number FROM k""")
def keep_largest(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("doc_id", "source", F.coalesce("section", F.lit("none")).alias("caption"), F.coalesce("n_chars", F.lit(0)).alias("size"), F.lit(1).alias("page"))
    return ingest.largest_by_caption(f, "source", "caption", "size", "doc_id").select("source", "caption", "doc_id", "size", "figure_number")


@query("""SELECT record_id, CAST(is_perovskite_synthesis AS VARCHAR) AS is_perovskite_synthesis, title, material, process_conditions.temperature AS temperature, len(list_filter(coalesce(precursors, []), lambda x: coalesce(x.name, x.concentration) IS NOT NULL)) AS n_precursors FROM extractions""")
def normalised_records(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "extractions")
    raw = F.to_json(F.struct(*(F.col(c) for c in ("title", "doi", "is_perovskite_synthesis", "material", "precursors", "synthesis_method", "process_conditions", "substrate", "characterization", "device_performance", "key_findings")), F.lit(1).alias("unknown_key")))
    n = t.select("record_id", records.normalise(raw, F.col("source_file")).alias("r"))
    return n.select("record_id", F.col("r.is_perovskite_synthesis").cast("string").alias("is_perovskite_synthesis"), "r.title", "r.material", F.col("r.process_conditions.temperature").alias("temperature"), F.size("r.precursors").cast("bigint").alias("n_precursors"))


# --- models ---------------------------------------------------------------------------------------------------------


@query()
def ridge_baseline(spark: SparkSession, d: str) -> DataFrame:
    """(field, n, mae, rmse, r2) of the four targets on the held-out papers."""
    _, metrics = models.baseline(table(spark, d, "devices"), "core")
    return metrics


@query(f"""WITH v AS (SELECT {q.given('Ref_DOI_number')} AS key FROM ({q.TARGETS}) WHERE {q.limits()}), s AS (SELECT {q.split('key')} AS split FROM v WHERE key IS NOT NULL)
SELECT (SELECT count(*) FROM devices) AS rows_total, count_if(split IN ('train', 'test')) AS rows_used, count_if(split = 'train') AS train_rows, count_if(split = 'test') AS test_rows FROM s""")
def baseline_rows(spark: SparkSession, d: str) -> DataFrame:
    return models.run_rows(table(spark, d, "devices"))


@query(f"{_RARE_SQL} SELECT DISTINCT column_name FROM f WHERE position <= 60 AND column_name NOT LIKE 'Ref%'")
def rare_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns that rare features come from: those that a regression adds to the core ones."""
    t = table(spark, d, "devices")
    return profile.rare_features(t, "row_id", DEVICE_COLUMNS, _USED).select("column_name").distinct()


@query(f"SELECT column_name FROM (SELECT column_name, count({q.number('value')}) / (SELECT count(*) FROM devices) AS share FROM ({_CELLS}) GROUP BY column_name) WHERE share >= 0.9")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "devices")
    found = models.numeric_columns(t, DEVICE_COLUMNS)
    return spark.createDataFrame([(c,) for c in found], "column_name string")


# --- pieces of the pipelines ----------------------------------------------------------------------------------------


@query(f"SELECT row_id, pce, voc, jsc, ff FROM ({q.TARGETS}) WHERE {q.limits()}")
def regression_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with targets within their limits, whatever their consistency."""
    return targets.valid_rows(table(spark, d, "devices"), max_error=None).select("row_id", *targets.FIELDS)


_SAFE = [c for c in (*prompts.PRIMARY_COLUMNS, *prompts.SECONDARY_COLUMNS) if c in DEVICE_COLUMNS and not c.startswith("JV_default_")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(_SAFE)) + ") t(column_name, place)")
def regression_columns(spark: SparkSession, d: str) -> DataFrame:
    """The features of a regression without rare ones."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(models.feature_columns(table(spark, d, "devices"), "core_secondary"))], "column_name string, place int")


@query(f"""WITH n AS (SELECT column_name, count(*) AS nonempty, count(DISTINCT value) AS n_distinct FROM ({_CELLS}) GROUP BY 1) SELECT c.column_name, coalesce(nonempty, 0) AS nonempty, coalesce(n_distinct, 0) AS n_distinct FROM (SELECT unnest(['Cell_architecture', 'split_key', 'Module', 'Ref_ID']) AS column_name) c LEFT JOIN n USING (column_name)""")
def listed_columns(spark: SparkSession, d: str) -> DataFrame:
    """A profile of the columns that are asked for, those without any value too."""
    t = table(spark, d, "devices")
    return profile.nonempty_counts(profile.value_counts(t, DEVICE_COLUMNS), ["Cell_architecture", "split_key", "Module", "Ref_ID"])


_RAW_SQL = """CASE record_id % 5 WHEN 0 THEN '{"filename": "f", "is_perovskite_synthesis": false}' WHEN 1 THEN '{"error": "timeout"}' WHEN 2 THEN '{"raw_output": "..."}' WHEN 3 THEN '{"raw_output": "...", "title": "t"}' ELSE '{"title": {"value": "t", "source": "s"}}' END"""


@query("SELECT record_id, CASE record_id % 5 WHEN 0 THEN 'not_perovskite' WHEN 1 THEN 'extraction_failed' WHEN 2 THEN 'extraction_failed' END AS reason, record_id % 5 > 2 AS complete, CASE WHEN record_id % 5 > 2 THEN 't' END AS title FROM extractions")
def record_status(spark: SparkSession, d: str) -> DataFrame:
    """Raw records of all kinds: minimal, failed, and full with plain and sourced values."""
    t = table(spark, d, "extractions").select("record_id", records.normalise(F.expr(_RAW_SQL), F.col("source_file")).alias("r"))
    return t.select("record_id", F.col("r._meta.reason").alias("reason"), F.col("r._meta.extraction_complete").alias("complete"), "r.title")


_PIECES = "SELECT doc_id, doc_id % 50 AS paper, 1 + doc_id % 3 AS number, coalesce(title, '') AS caption FROM documents"


@query(f"""WITH p AS ({_PIECES}), b AS (SELECT paper, number, arg_max(caption, doc_id) AS longer FROM p GROUP BY ALL), f AS (SELECT paper, doc_id, 'Figure ' || number || '. ' || substr(caption, 1, 10) AS caption, number FROM p)
SELECT f.paper, doc_id, CASE WHEN length(longer) > length(caption) + 20 THEN longer ELSE caption END AS caption FROM f LEFT JOIN b USING (paper, number)""")
def enriched_captions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("paper"), (1 + F.col("doc_id") % 3).cast("int").alias("number"), F.coalesce("title", F.lit("")).alias("caption"))
    figures = p.select("paper", "doc_id", F.concat(F.lit("Figure "), F.col("number").cast("string"), F.lit(". "), F.substring("caption", 1, 10)).alias("caption"))
    return ingest.enrich_captions(figures, p.select("paper", "number", F.col("doc_id").alias("ord"), "caption"), "paper").select("paper", "doc_id", "caption")


@query("SELECT record_id, concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(synthesis_method), ''), nullif(trim(key_findings), ''), nullif(trim(substrate), '')) AS text FROM extractions")
def full_texts(spark: SparkSession, d: str) -> DataFrame:
    """Sections in their canonical order, blank ones left out."""
    sections = {"other": F.col("substrate"), "results": F.col("key_findings"), "abstract": F.col("title"), "experimental": F.col("synthesis_method")}
    return table(spark, d, "extractions").select("record_id", ingest.full_text(sections).alias("text"))


_CRITIQUE_SQL = """CASE record_id % 4 WHEN 0 THEN '```json' || chr(10) || '{"wrong_section_fields": [{"field": "substrate", "correct_value": "glass"}, {"field": "", "correct_value": "x"}], "missing_fields": ["material", "substrate"], "overall_quality": "poor", "summary": "s"}' || chr(10) || '```' WHEN 1 THEN 'See: {"missing_fields": [], "product_as_precursor": [{"name": "MAPbI3"}], "overall_quality": "good"} - done' WHEN 2 THEN 'no answer' ELSE '{broken' END"""


@query("SELECT record_id, CASE record_id % 4 WHEN 0 THEN 'poor' WHEN 1 THEN 'good' ELSE 'unknown' END AS quality, CASE WHEN record_id % 4 = 0 THEN 2 ELSE 0 END AS wrong, CASE WHEN record_id % 4 = 0 THEN 2 ELSE 0 END AS missing, CASE WHEN record_id % 4 = 1 THEN 1 ELSE 0 END AS products FROM extractions")
def critiques(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a reviewer, fenced, within prose, without and with broken JSON."""
    t = table(spark, d, "extractions").select("record_id", review.parse_critique(F.expr(_CRITIQUE_SQL.replace("chr(10)", "char(10)"))).alias("c"))
    n = review.critique_counts(F.col("c"))
    return t.select("record_id", F.col("c.overall_quality").alias("quality"), n["wrong_section_fields"].alias("wrong"), n["missing_fields"].alias("missing"), n["product_as_precursor"].alias("products"))


@query("SELECT record_id, 'substrate' AS path, 'glass' AS correction FROM extractions WHERE record_id % 4 = 0")
def critique_corrections(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "extractions").select("record_id", review.parse_critique(F.expr(_CRITIQUE_SQL.replace("chr(10)", "char(10)"))).alias("critique"))
    return review.corrections(t, "record_id")


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total, CAST(sum(p_size) FILTER (WHERE p_size > 25) AS BIGINT) AS trainable, round(100.0 * sum(p_size) FILTER (WHERE p_size > 25) / sum(p_size), 6) AS percent FROM part")
def parameter_totals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("n"), (F.col("p_size") > 25).alias("trainable"))
    return _rounded(files.parameter_totals(t), "percent")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON trees of sourced leaves."""
    t = table(spark, d, "extractions")

    def leaf(c: str) -> Column:
        return F.struct(F.col(c).alias("value"), F.substring("key_findings", 1, 30).alias("source"))

    precursors = F.transform("precursors", lambda p: F.struct(p["name"].alias("name"), p["concentration"].alias("source")))
    tree = F.struct(leaf("title").alias("title"), leaf("material").alias("material"), F.struct(leaf("process_conditions.temperature").alias("temperature")).alias("process_conditions"), precursors.alias("precursors"))
    return t.select("record_id", "key_findings", F.to_json(tree, {"ignoreNullFields": "false"}).alias("record"))


_TREE = """SELECT record_id, 'title' AS path, title AS value, substr(key_findings, 1, 30) AS source FROM extractions UNION ALL SELECT record_id, 'material', material, substr(key_findings, 1, 30) FROM extractions
UNION ALL SELECT record_id, 'process_conditions.temperature', process_conditions.temperature, substr(key_findings, 1, 30) FROM extractions
UNION ALL SELECT record_id, 'precursors.' || i, NULL, p.concentration FROM (SELECT record_id, unnest(precursors) AS p, unnest(range(len(precursors))) AS i FROM extractions)"""


@query(_TREE)
def tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d).select("record_id", F.explode(trees.leaf_rows(F.col("record"))).alias("x"))
    return t.select("record_id", "x.path", "x.value", "x.source")


_TOLD = "CASE WHEN trim(coalesce(source, '')) = '' THEN 'false' WHEN starts_with(trim(source), 'Table') THEN 'table' WHEN length(trim(source)) < 20 THEN NULL WHEN path LIKE 'precursors.%' THEN 'false' ELSE 'true' END"


@query(f"""WITH t AS (SELECT record_id, value, {_TOLD} AS told FROM ({_TREE})), c AS (SELECT record_id, count_if(value IS NOT NULL AND value <> '') AS non_null, count_if(value IS NOT NULL AND value <> '' AND told IN ('true', 'table')) AS grounded, count_if(told IS NULL) AS unverifiable FROM t GROUP BY 1)
SELECT *, CASE WHEN non_null <> unverifiable THEN round(grounded / (non_null - unverifiable), 3) ELSE 0 END AS score FROM c""")
def tree_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Grounding of whole records in what they found: counts and score with precursors that have no value of their own."""
    t = _tree(spark, d).select("record_id", trees.tree_counts(trees.ground_tree(F.col("record"), F.col("key_findings"))).alias("c"))
    return t.select("record_id", "c.*", trees.tree_score(F.col("c")).alias("score"))


@query("SELECT record_id, upper(substrate) AS value, material FROM extractions")
def set_leaves(spark: SparkSession, d: str) -> DataFrame:
    """A leaf that the record lacks, written and read again, with one that it has."""
    t = table(spark, d, "extractions").select("record_id", F.upper("substrate").alias("s")).join(_tree(spark, d), "record_id")
    change = F.array(F.struct(F.lit("substrate.main").alias("path"), F.to_json(F.struct(F.col("s").alias("value")), {"ignoreNullFields": "false"}).alias("json")))
    out = t.select("record_id", trees.set_leaves(F.col("record"), change).alias("r"))
    return out.select("record_id", F.get_json_object("r", "$.substrate.main.value").alias("value"), F.get_json_object("r", "$.material.value").alias("material"))


_NUMBER = "-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?"


@query(f"""WITH a AS (SELECT example_id, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS a FROM chat_examples), s AS (SELECT example_id, f, strpos(a, '"' || f || '":') - 1 AS s, regexp_extract(a, '"' || f || '":\\s*{_NUMBER}') AS t FROM a, (SELECT unnest(['pce', 'ff']) AS f))
SELECT example_id, f AS field, CAST(s AS INTEGER) AS start, CAST(s + length(t) AS INTEGER) AS "end" FROM s WHERE t <> ''""".replace("\\\\", "\\"))
def answer_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where two numbers of the answers stand, from the key to the end of the value."""
    t = table(spark, d, "chat_examples").select("example_id", sequences.first_of(F.col("messages"), "assistant").alias("a"))
    return t.select("example_id", F.explode(sequences.spans(F.col("a"), "pce", "ff")).alias("x")).select("example_id", "x.*")


# --- relational staples of the star schema --------------------------------------------------------------------------


@query("""SELECT o_orderpriority, count(*) AS n, count(t) AS n_priced, round(avg(abs(t - o_totalprice)), 2) AS mae FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY ALL""")
def order_totals(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("t"))
    o = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("t").alias("n_priced"), F.round(F.avg(F.abs(F.col("t") - F.col("o_totalprice"))), 2).alias("mae"))


@query("SELECT date_trunc('day', ts) AS start, count(value) AS n, round(avg(abs(value - 10)), 6) AS mae FROM events GROUP BY ALL")
def windowed_error(spark: SparkSession, d: str) -> DataFrame:
    from sedge.streaming.events import windowed_error as run

    return _rounded(run(table(spark, d, "events").withColumn("truth", F.lit(10.0)).withColumn("pred", F.col("value"))), "mae")


