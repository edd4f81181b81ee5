"""Targets of device rows: numbers, limits, consistency, bins, confidence and justification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.missing import MISSING_TOKENS, strip
from sedge.functions.numbers import parse_float

#: Target columns, bin edges, physical limits, process columns.
TARGET_COLUMNS = {"pce": "JV_default_PCE", "voc": "JV_default_Voc", "jsc": "JV_default_Jsc", "ff": "JV_default_FF"}
BIN_EDGES = {"pce": (0.0, 5.0, 10.0, 15.0, 20.0, 25.0), "voc": (0.0, 0.6, 0.8, 1.0, 1.1, 1.2), "jsc": (0.0, 5.0, 10.0, 15.0, 20.0, 25.0), "ff": (0.0, 0.4, 0.5, 0.6, 0.7, 0.8)}
LIMITS = {"pce": (0.0, 35.0), "voc": (0.0, 2.0), "jsc": (0.0, 35.0), "ff": (0.0, 1.0)}
PROCESS_COLUMNS = ("Perovskite_deposition_procedure", "Perovskite_deposition_solvents", "Perovskite_deposition_thermal_annealing_temperature", "Perovskite_deposition_thermal_annealing_time", "ETL_stack_sequence", "HTL_stack_sequence", "Backcontact_stack_sequence")
FIELDS = tuple(TARGET_COLUMNS)
#: All columns that targets are made from.
USED_COLUMNS = (*TARGET_COLUMNS.values(), *PROCESS_COLUMNS, "Cell_architecture", "Cell_stack_sequence", "Perovskite_composition_short_form", "Perovskite_composition_long_form")
#: The sentences of a justification.
SENTENCES = {
    "architecture": "The device architecture is {}.",
    "composition": "The absorber composition is recorded as {}.",
    "stack": "The layer stack provides device context for transport and contact layers.",
    "procedure": "The perovskite deposition procedure is {}.",
    "annealing": "Annealing conditions are present in the input recipe.",
    "error": "The predicted metrics have a PCE consistency error of {} from Voc*Jsc*FF.",
}


def with_targets(df: DataFrame, drop_missing: bool = False) -> DataFrame:
    """Adds pce, voc, jsc and ff as numbers; with drop_missing only rows that have all four."""
    out = df.withColumns({f: parse_float(F.col(c)) for f, c in TARGET_COLUMNS.items()})
    return out.dropna(subset=list(FIELDS)) if drop_missing else out


def within_limits(cols: dict[str, Column]) -> Column:
    out = F.lit(True)
    for f, c in cols.items():
        out = out & c.between(*LIMITS[f])
    return out


def consistency_error(pce: Column, voc: Column, jsc: Column, ff: Column) -> Column:
    """abs(pce - voc * jsc * ff), null where any is."""
    return F.abs(pce - voc * jsc * ff)


def _own_error() -> Column:
    return consistency_error(*(F.col(f) for f in FIELDS))


def valid_targets(max_error: float | None = 5.0) -> Column:
    """Whether all targets (with_targets) are given, within their limits and, unless max_error is None, consistent."""
    good = within_limits({f: F.col(f) for f in FIELDS})
    return good if max_error is None else good & (_own_error() <= max_error)


def valid_rows(df: DataFrame, max_error: float | None = 5.0) -> DataFrame:
    """The rows with valid targets."""
    return with_targets(df, drop_missing=True).where(valid_targets(max_error))


def bin_labels(field: str) -> list[str]:
    e = BIN_EDGES[field]
    return [f"<{e[0]:g}", *(f"{a:g}-{b:g}" for a, b in zip(e, e[1:])), f"{e[-1]:g}+"]


def make_bin(field: str, value: Column) -> Column:
    """The label of the bin [low, high) that holds the value, with open ends; null stays null."""
    e, labels = BIN_EDGES[field], bin_labels(field)
    out = F.when(value < e[0], labels[0])
    for edge, label in zip(e[1:], labels[1:]):
        out = out.when(value < edge, label)
    return out.when(value.isNotNull(), labels[-1])


def confidence(error: Column) -> Column:
    """high, medium or low, by consistency and by how many process columns are missing."""
    missing = sum((F.coalesce(F.lower(strip(F.col(c))), F.lit("")).isin(*MISSING_TOKENS).cast("int") for c in PROCESS_COLUMNS), F.lit(0))
    return F.when((error <= 0.5) & (missing <= 2), "high").when((error <= 2.0) & (missing <= 4), "medium").otherwise("low")


def three_digits(v: Column) -> Column:
    """A number with three significant digits and no padding, as %.3g prints it (0 <= v < 1000)."""
    places = F.when(v == 0, 0).otherwise(2 - F.floor(F.log10(v)).cast("int"))
    fixed = F.when(places <= 0, F.format_string("%.0f", v)).when(places == 1, F.format_string("%.1f", v)).when(places == 2, F.format_string("%.2f", v)).when(places == 3, F.format_string("%.3f", v)).when(places == 4, F.format_string("%.4f", v)).otherwise(F.format_string("%.6f", v))
    return F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)


def justification(error: Column) -> Column:
    """Up to five sentences on the row. Text such as "Unknown" counts as given here."""

    def given(c: str) -> Column:
        return F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))

    def say(name: str, value: Column) -> Column:
        """The sentence with the value in it, null where there is none."""
        head, _, tail = SENTENCES[name].partition("{}")
        return F.concat(F.lit(head), value, F.lit(tail)) if "{}" in SENTENCES[name] else F.when(value.isNotNull(), SENTENCES[name])

    composition = F.coalesce(given("Perovskite_composition_long_form"), given("Perovskite_composition_short_form"))
    annealed = F.coalesce(given("Perovskite_deposition_thermal_annealing_temperature"), given("Perovskite_deposition_thermal_annealing_time"))
    about = {"architecture": given("Cell_architecture"), "composition": composition, "stack": given("Cell_stack_sequence"), "procedure": given("Perovskite_deposition_procedure"), "annealing": annealed, "error": three_digits(error)}
    said = F.array(*(say(name, value) for name, value in about.items()))
    return F.slice(F.array_compact(said), 1, 5)


def target_struct(schema: str = "performance_with_justification") -> Column:
    """The prediction target of a row that has its numbers (with_targets)."""
    prediction = F.struct(*(make_bin(f, F.col(f)).alias(f"{f}_bin") for f in FIELDS), *(F.round(F.col(f), 4).alias(f) for f in FIELDS))
    if schema == "performance_only":
        return F.struct(prediction.alias("prediction"))
    if schema != "performance_with_justification":
        raise ValueError(f"unknown output schema: {schema}")
    return F.struct(prediction.alias("prediction"), confidence(_own_error()).alias("confidence"), justification(_own_error()).alias("justification"))
