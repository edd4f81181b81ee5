"""Evaluation of predictions: field metrics, bins, validity, subgroups and physical verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.jsons import parse_object
from sedge.functions.numbers import parse_float, ratio
from sedge.operators.targets import FIELDS, LIMITS, bin_labels, consistency_error, make_bin

SUBGROUPS = ("low_pce_lt_5", "mid_pce_5_to_15", "high_pce_gte_15")


def pairs(df: DataFrame, truth: str = "t_", predicted: str = "p_", *keep: str) -> DataFrame:
    """(keep..., field, truth, pred): one row a field, no shuffle."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(truth + f).alias("truth"), F.col(predicted + f).alias("pred")) for f in FIELDS))
    return df.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.*")


def regression_aggregates() -> dict[str, Column]:
    """count, mae, rmse and r2 over the pairs where both are given; null over none; r2 null for constant truth."""
    both = F.col("truth").isNotNull() & F.col("pred").isNotNull()
    e = F.col("pred") - F.col("truth")
    return {"n": F.count_if(both), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "r2": 1 - ratio(F.sum(e * e), F.nullif(F.regr_sxx("pred", "truth"), F.lit(0.0)))}


def regression_metrics(long: DataFrame, *by: str) -> DataFrame:
    return long.groupBy(*by, "field").agg(*(c.alias(n) for n, c in regression_aggregates().items()))


def _binned(c: str) -> Column:
    out = F.when(F.lit(False), "")
    for f in FIELDS:
        out = out.when(F.col("field") == f, make_bin(f, F.col(c)))
    return out


def bin_accuracy(long: DataFrame, *by: str) -> DataFrame:
    both = F.col("truth").isNotNull() & F.col("pred").isNotNull()
    return long.groupBy(*by, "field").agg(F.count_if(both).alias("n"), ratio(F.count_if(both & (_binned("truth") == _binned("pred"))), F.count_if(both)).alias("accuracy"))


def field_validity(long: DataFrame) -> DataFrame:
    p, t = F.col("pred").isNotNull(), F.col("truth").isNotNull()
    n = F.count("*")
    return long.groupBy("field").agg(F.count_if(p).alias("predicted_count"), F.count_if(t).alias("truth_count"), F.count_if(p & t).alias("comparable_count"), ratio(F.count_if(p), n).alias("prediction_validity_rate"), ratio(F.count_if(t), n).alias("truth_validity_rate"), ratio(F.count_if(p & t), n).alias("comparable_rate"), ratio(F.count_if(~p), n).alias("missing_rate"))


def confusion_matrix(long: DataFrame) -> DataFrame:
    """(field, truth_bin, pred_bin, n) with every pair of labels, zero where it doesn't occur."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(a).alias("truth_bin"), F.lit(b).alias("pred_bin")) for f in FIELDS for a in bin_labels(f) for b in bin_labels(f)))
    every = long.sparkSession.range(1).select(F.explode(cells).alias("x")).select("x.*")
    found = long.where("truth IS NOT NULL AND pred IS NOT NULL").groupBy("field", _binned("truth").alias("truth_bin"), _binned("pred").alias("pred_bin")).agg(F.count("*").alias("n"))
    return every.join(found, ["field", "truth_bin", "pred_bin"], "left").select("field", "truth_bin", "pred_bin", F.coalesce("n", F.lit(0)).alias("n"))


def subgroup(pce: Column) -> Column:
    return F.when(pce < 5.0, SUBGROUPS[0]).when(pce < 15.0, SUBGROUPS[1]).when(pce.isNotNull(), SUBGROUPS[2])


def subgroup_metrics(df: DataFrame) -> DataFrame:
    """(subgroup, field, n, mae, rmse, r2); every subgroup and field comes out, nulls and 0 over no rows."""
    long = pairs(df.withColumn("subgroup", subgroup(F.col("t_pce"))).where("subgroup IS NOT NULL"), "t_", "p_", "subgroup")
    every = df.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(g).alias("subgroup"), F.lit(f).alias("field")) for g in SUBGROUPS for f in FIELDS))).alias("x")).select("x.*")
    return every.join(regression_metrics(long, "subgroup"), ["subgroup", "field"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def consistency_metrics(df: DataFrame, prefix: str = "p_") -> DataFrame:
    e = consistency_error(*(F.col(prefix + f) for f in FIELDS))
    return df.agg(F.count(e).alias("n"), F.avg(e).alias("mae"), F.max(e).alias("max_error"))


RANGE = "array<struct<field:string,value:double,low:double,high:double>>"
LABEL = "array<struct<field:string,value:string,allowed:array<string>>>"
MISMATCH = "array<struct<field:string,value:string,expected:string>>"
VIOLATIONS = ("range_violations", "invalid_bin_labels", "bin_mismatches")


def _found(values: dict[str, Column], labels: dict[str, Column], has_label: dict[str, Column], is_object: Column) -> dict[str, Column]:
    """The lists of one prediction's violations and missing fields, and its consistency error."""

    def listed(items: list[Column], kind: str) -> Column:
        found = F.array_compact(F.array(*items)).cast(kind)
        return F.when(is_object, found).otherwise(F.array().cast(kind))

    def item(when: Column, **parts: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(*(c.alias(n) for n, c in parts.items())))

    known = {f: F.coalesce(labels[f].isin(bin_labels(f)), F.lit(False)) for f in FIELDS}
    ranges = [item((v < LIMITS[f][0]) | (v > LIMITS[f][1]), field=F.lit(f), value=v, low=F.lit(LIMITS[f][0]), high=F.lit(LIMITS[f][1])) for f, v in values.items()]
    invalid = [item(has_label[f] & ~known[f], field=F.lit(f"{f}_bin"), value=labels[f], allowed=F.array(*map(F.lit, sorted(bin_labels(f))))) for f in FIELDS]
    wrong = [item(known[f] & (labels[f] != make_bin(f, values[f])), field=F.lit(f"{f}_bin"), value=labels[f], expected=make_bin(f, values[f])) for f in FIELDS]
    missing = F.array_compact(F.array(*(F.when(v.isNull(), F.lit(f)) for f, v in values.items())))
    return {
        "pce_consistency_error": F.when(is_object, consistency_error(*(values[f] for f in FIELDS))),
        "range_violations": listed(ranges, RANGE),
        "invalid_bin_labels": listed(invalid, LABEL),
        "bin_mismatches": listed(wrong, MISMATCH),
        "missing_fields": F.when(is_object, missing).otherwise(F.array(*map(F.lit, FIELDS))),
    }


def _check(found: dict[str, Column], is_object: Column, threshold: float) -> Column:
    bad = sum((F.size(found[n]) for n in VIOLATIONS), F.lit(0)) > 0
    bad = F.when(is_object, bad | F.coalesce(found["pce_consistency_error"] > threshold, F.lit(False))).otherwise(True)
    valid = is_object & (F.size(found["missing_fields"]) == 0)
    return F.struct(bad.alias("physically_inconsistent"), valid.alias("schema_valid"), *(c.alias(n) for n, c in found.items()))


def verification(values: dict[str, Column], labels: dict[str, Column], has_label: dict[str, Column], is_object: Column, threshold: float = 5.0) -> Column:
    """The checks of one prediction.

    Violations say what was found and what would be right: (field, value, low, high) of numbers out of their limits,
    ("<field>_bin", value, allowed) of unknown labels and ("<field>_bin", value, expected) of labels that don't fit
    their number. A label that is given as null is unknown, one that isn't given is skipped. Missing fields make a
    prediction invalid as to schema, not physically inconsistent.
    """
    return _check(_found(values, labels, has_label, is_object), is_object, threshold)


def payload(parsed: Column, text: Column) -> Column:
    """A record's JSON answer: the object that is already parsed, else the one in the text, null where there is none."""
    return F.coalesce(parsed, parse_object(text))


def parsed_predictions(records: DataFrame, *keep: str) -> DataFrame:
    """(keep..., p_json, t_json, p_<field>, t_<field>, check) of prediction records (prediction_text, ground_truth_text
    and, if there, prediction_json, ground_truth_json): whether each answer is an object, its numbers, and its checks."""
    def answer(name: str) -> Column:
        return payload(F.col(f"{name}_json"), F.col(f"{name}_text")) if f"{name}_json" in records.columns else parse_object(F.col(f"{name}_text"))

    rows = records.select(*keep, answer("prediction").alias("_p"), answer("ground_truth").alias("_t"))

    def number(side: str, f: str) -> Column:
        return parse_float(F.try_element_at(F.col(f"{side}.prediction"), F.lit(f)))

    # step by step, so that what many checks use is worked out once a row
    p = F.col("_p.prediction")
    rows = rows.select(
        *keep, F.col("_p").isNotNull().alias("p_json"), F.col("_t").isNotNull().alias("t_json"), p.isNotNull().alias("_ok"), *(number("_p", f).alias(f"p_{f}") for f in FIELDS), *(number("_t", f).alias(f"t_{f}") for f in FIELDS),
        *(F.try_element_at(p, F.lit(f"{f}_bin")).alias(f"_l_{f}") for f in FIELDS), *(F.coalesce(F.map_contains_key(p, f"{f}_bin"), F.lit(False)).alias(f"_h_{f}") for f in FIELDS),
    )
    told = [*keep, "p_json", "t_json", *(f"{x}_{f}" for x in "pt" for f in FIELDS)]
    found = _found(*({f: F.col(f"{x}_{f}") for f in FIELDS} for x in ("p", "_l", "_h")), F.col("_ok"))
    rows = rows.select(*told, "_ok", *(c.alias(n) for n, c in found.items()))
    return rows.select(*told, _check({n: F.col(n) for n in found}, F.col("_ok"), 5.0).alias("check"))


def _cells(parsed: DataFrame) -> DataFrame:
    """One row a (field, subgroup, truth bin, prediction bin), with counts and moments that add up to any metric."""
    long = pairs(parsed.withColumn("subgroup", subgroup(F.col("t_pce"))), "t_", "p_", "subgroup")
    both = F.col("truth").isNotNull() & F.col("pred").isNotNull()
    t, e = F.when(both, F.col("truth")), F.when(both, F.col("pred") - F.col("truth"))
    return long.groupBy("field", "subgroup", _binned("truth").alias("truth_bin"), _binned("pred").alias("pred_bin")).agg(
        F.count("*").alias("rows"), F.count(t).alias("n"), F.sum(F.abs(e)).alias("abs"), F.sum(e * e).alias("squares"),
        F.avg(t).alias("mean"), (F.var_pop(t) * F.count(t)).alias("spread"), F.min(t).alias("low"), F.max(t).alias("high"),
    )


def _regression(cells: list) -> dict:
    n = sum(c["n"] for c in cells)
    if not n:
        return {"count": 0, "mae": None, "rmse": None, "r2": None}
    given = [c for c in cells if c["n"]]
    mean = sum(c["n"] * c["mean"] for c in given) / n
    total = sum(c["spread"] + c["n"] * (c["mean"] - mean) ** 2 for c in given)
    squares = sum(c["squares"] for c in given)
    constant = min(c["low"] for c in given) == max(c["high"] for c in given)
    return {"count": n, "mae": sum(c["abs"] for c in given) / n, "rmse": (squares / n) ** 0.5, "r2": None if constant else 1 - squares / total}


def _rate(part: int, whole: int) -> float | None:
    return part / whole if whole else None


def _accuracy(cells: list) -> dict:
    n = sum(c["n"] for c in cells)
    return {"count": n, "accuracy": _rate(sum(c["n"] for c in cells if c["truth_bin"] == c["pred_bin"]), n)}


def _is_field(name: str):
    return lambda x: x["field"] == name


def _of_kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["field"].alias("field"))


def compute_metrics(records: DataFrame) -> dict:
    """The evaluation of prediction records as one nested document, from two aggregations over all records.

    The first counts cells of (field, subgroup, truth bin, prediction bin), a few hundred whatever the number of
    records, from which every metric by field, bin and subgroup adds up; the second has the checks.
    """
    parsed = parsed_predictions(records)
    cells = _cells(parsed).collect()  # at most fields x subgroups x bins x bins
    c, e = F.col("check"), F.col("check")["pce_consistency_error"]
    named = {f"{v}.{name}": F.sum(F.size(F.filter(c[v], _is_field(name)))) for v in VIOLATIONS for name in (FIELDS if v == "range_violations" else [f"{f}_bin" for f in FIELDS])}
    sums = parsed.agg(
        F.count("*").alias("rows"), F.count_if("p_json").alias("p_json"), F.count_if("t_json").alias("t_json"), F.count_if(c["physically_inconsistent"]).alias("bad"), F.count_if(~c["schema_valid"]).alias("invalid"),
        F.count(e).alias("n"), F.avg(e).alias("mae"), F.max(e).alias("max"), *(x.alias(n.replace(".", "/")) for n, x in named.items()),
    ).first()
    total = sums["rows"]
    by = {f: [x for x in cells if x["field"] == f] for f in FIELDS}
    groups = {g: {f: [x for x in by[f] if x["subgroup"] == g] for f in FIELDS} for g in SUBGROUPS}

    def validity(own: list) -> dict:
        p, t = (sum(x["rows"] for x in own if x[side] is not None) for side in ("pred_bin", "truth_bin"))
        n = sum(x["n"] for x in own)
        return {"predicted_count": p, "truth_count": t, "comparable_count": n, "prediction_validity_rate": _rate(p, total), "truth_validity_rate": _rate(t, total), "comparable_rate": _rate(n, total)}

    def confusion(f: str) -> dict:
        return {t: {p: sum(x["n"] for x in by[f] if (x["truth_bin"], x["pred_bin"]) == (t, p)) for p in bin_labels(f)} for t in bin_labels(f)}

    return {
        "rows": total,
        "json_validity_rate": _rate(sums["p_json"], total),
        "ground_truth_validity_rate": _rate(sums["t_json"], total),
        "field_validity": {f: validity(own) for f, own in by.items()},
        "field_metrics": {f: _regression(own) for f, own in by.items()},
        "physical_consistency": {"count": sums["n"], "mae": sums["mae"], "max": sums["max"]},
        "physics_verification": {
            "physically_inconsistent_count": sums["bad"], "physically_inconsistent_rate": _rate(sums["bad"], total), "schema_invalid_count": sums["invalid"], "schema_invalid_rate": _rate(sums["invalid"], total),
            "pce_consistency_count": sums["n"], "pce_consistency_mae": sums["mae"], "pce_consistency_max": sums["max"],
            **{v: {name.split(".")[1]: n for name in named if name.startswith(v + ".") and (n := sums[name.replace(".", "/")])} for v in VIOLATIONS},
        },
        "bin_accuracy": {f: _accuracy(own) for f, own in by.items()},
        "bin_confusion": {f: confusion(f) for f in FIELDS},
        "pce_subgroups": {g: {"rows": sum(x["rows"] for x in own["pce"]), "field_metrics": {f: _regression(x) for f, x in own.items()}, "bin_accuracy": {f: _accuracy(x) for f, x in own.items()}} for g, own in groups.items()},
        "missing_prediction_rate": {f: _rate(sum(x["rows"] for x in own if x["pred_bin"] is None), total) for f, own in by.items()},
    }


def flat_document(document: dict, prefix: str = "") -> list[tuple[str, object]]:
    """(dotted name, value) of the leaves of a nested document, sorted."""
    out = []
    for k, v in document.items():
        name = f"{prefix}.{k}" if prefix else k
        out += flat_document(v, name) if isinstance(v, dict) else [(name, v)]
    return sorted(out)


def metrics_table(spark: SparkSession, document: dict) -> DataFrame:
    """(metric, value) of a document: the form that write_metrics() takes."""
    return spark.createDataFrame([(n, None if v is None else float(v)) for n, v in flat_document(document)], "metric string, value double")


def verification_summary(checks: DataFrame, column: str = "check") -> DataFrame:
    c = F.col(column)
    n = F.count("*")
    return checks.agg(n.alias("n"), F.count_if(c["physically_inconsistent"]).alias("n_inconsistent"), F.count_if(c["schema_valid"]).alias("n_schema_valid"), ratio(F.count_if(c["physically_inconsistent"]), n).alias("inconsistent_rate"), ratio(F.count_if(c["schema_valid"]), n).alias("schema_valid_rate"))


def violations(checks: DataFrame, key: str, *keep: str, column: str = "check") -> DataFrame:
    """(keep..., field, value, ...): one row a violation of a kind, with its details."""
    return checks.select(*keep, F.explode(F.col(column)[key]).alias("_x")).select(*keep, "_x.*")


def violation_counts(checks: DataFrame, column: str = "check") -> DataFrame:
    """(kind, field, n) over the kinds of violations: one pass."""
    each = F.flatten(F.array(*(F.transform(F.col(column)[v], _of_kind(v)) for v in VIOLATIONS)))
    return checks.select(F.explode(each).alias("x")).select("x.*").groupBy("kind", "field").agg(F.count("*").alias("n"))


def flatten_metrics(row: DataFrame, prefix: str = "") -> DataFrame:
    """A row of nested structs as (metric, value) with dotted names, sorted; arrays are left out, nulls kept."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, at: str) -> list[str]:
        out = []
        for f in schema.fields:
            name = f"{at}.{f.name}" if at else f.name
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, name)
            elif not isinstance(f.dataType, T.ArrayType | T.MapType):
                out.append(name)
        return out

    names = leaves(row.schema, "")
    entries = F.array(*(F.struct(F.lit(prefix + n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return row.select(F.explode(entries).alias("x")).select("x.*").orderBy("metric")
