"""Prompts and chat examples from device rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.missing import meaningful
from sedge.operators.profile import leaks

#: The task and the titles of a prompt's parts.
HEADER = "Task: Predict perovskite solar-cell JV performance."
CORE, SECONDARY, RARE, OTHER = "Core device recipe:", "Secondary process and measurement details:", "Activated rare or special features:", "Other activated features:"
#: The columns of a recipe, and the sections of a hierarchical prompt by column prefix.
PRIMARY_COLUMNS = (
    "Cell_architecture", "Cell_stack_sequence", "Cell_area_measured", "Cell_flexible", "Cell_semitransparent", "Perovskite_composition_short_form", "Perovskite_composition_long_form", "Perovskite_composition_a_ions", "Perovskite_composition_a_ions_coefficients",
    "Perovskite_composition_b_ions", "Perovskite_composition_b_ions_coefficients", "Perovskite_composition_c_ions", "Perovskite_composition_c_ions_coefficients", "Perovskite_composition_inorganic", "Perovskite_composition_leadfree", "Perovskite_thickness", "Perovskite_band_gap",
    "Perovskite_deposition_procedure", "Perovskite_deposition_synthesis_atmosphere", "Perovskite_deposition_thermal_annealing_temperature", "Perovskite_deposition_thermal_annealing_time", "Perovskite_deposition_thermal_annealing_atmosphere", "ETL_stack_sequence", "ETL_deposition_procedure",
    "HTL_stack_sequence", "HTL_additives_compounds", "Backcontact_stack_sequence", "Backcontact_thickness_list", "JV_test_atmosphere", "JV_test_temperature", "JV_light_source_type", "JV_light_intensity", "JV_default_PCE_scan_direction",
)
SECONDARY_COLUMNS = (
    "Substrate_stack_sequence", "Substrate_cleaning_procedure", "Substrate_surface_roughness_rms", "ETL_thickness", "ETL_additives_compounds", "ETL_additives_concentrations", "ETL_deposition_solvents", "ETL_deposition_solvents_mixing_ratios", "ETL_deposition_reaction_solutions_compounds",
    "ETL_deposition_reaction_solutions_concentrations", "ETL_deposition_thermal_annealing_temperature", "ETL_deposition_thermal_annealing_time", "Perovskite_additives_compounds", "Perovskite_additives_concentrations", "Perovskite_deposition_solvents", "Perovskite_deposition_solvents_mixing_ratios",
    "Perovskite_deposition_reaction_solutions_compounds", "Perovskite_deposition_reaction_solutions_concentrations", "Perovskite_deposition_substrate_temperature", "Perovskite_deposition_thermal_annealing_relative_humidity", "Perovskite_storage_atmosphere", "Perovskite_storage_relative_humidity",
    "HTL_thickness_list", "HTL_additives_concentrations", "HTL_deposition_procedure", "HTL_deposition_solvents", "HTL_deposition_solvents_mixing_ratios", "HTL_deposition_thermal_annealing_temperature", "HTL_deposition_thermal_annealing_time", "Backcontact_deposition_procedure",
    "JV_light_masked_cell", "JV_light_mask_area", "JV_scan_speed", "JV_scan_delay_time", "JV_preconditioning_protocol",
)
#: Columns that are never rare features.
LISTED_COLUMNS = (*PRIMARY_COLUMNS, *SECONDARY_COLUMNS)
SECTIONS = {
    "Device": ("Cell_", "Module_"), "Substrate": ("Substrate_",), "ETL": ("ETL_",), "Perovskite absorber": ("Perovskite_",), "HTL": ("HTL_",), "Back contact": ("Backcontact_",),
    "Additional front layer": ("Add_lay_front",), "Additional back layer": ("Add_lay_back",), "Encapsulation": ("Encapsulation",), "JV measurement": ("JV_",),
}


def label(column: str) -> str:
    return column.replace("_", " ").strip().lower()


def field_lines(columns: list[str]) -> Column:
    """Array of "- label: value" of the columns that aren't missing, in their order."""
    return F.array_compact(F.array(*(F.concat(F.lit(f"- {label(c)}: "), meaningful(F.col(f"`{c}`").cast("string"))) for c in columns)))


def feature_lines(features: Column) -> Column:
    """The same of an array of (column_name, value)."""
    return F.transform(features, lambda x: F.concat(F.lit("- "), F.lower(F.trim(F.replace(x["column_name"], F.lit("_"), F.lit(" ")))), F.lit(": "), x["value"]))


def _text(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def _said(*lines: str) -> Column:
    return F.array(*map(F.lit, lines))


def core_prompt(df: DataFrame) -> Column:
    return _text(_said(HEADER, "", CORE), field_lines([c for c in PRIMARY_COLUMNS if c in df.columns]))


def core_secondary_prompt(df: DataFrame) -> Column:
    return _text(F.array(core_prompt(df)), _said("", SECONDARY), field_lines([c for c in SECONDARY_COLUMNS if c in df.columns]))


def with_rare_features(df: DataFrame, id_column: str, features: DataFrame) -> DataFrame:
    """Adds `features`: array of (column_name, value) in order, empty where a row has none."""
    lists = features.groupBy(F.col(id_column).alias("_f")).agg(F.array_sort(F.collect_list(F.struct("position", "column_name", "value"))).alias("features"))  # at most 60 a row
    return df.join(lists, F.col(id_column) == F.col("_f"), "left").drop("_f").withColumn("features", F.coalesce("features", F.array().cast("array<struct<position:int,column_name:string,value:string>>")))


def core_rare_prompt(df: DataFrame) -> Column:
    """Needs `features` (with_rare_features)."""
    more = F.when(F.size("features") > 0, F.concat(_said("", RARE), feature_lines(F.col("features")))).otherwise(F.array().cast("array<string>"))
    return _text(F.array(core_prompt(df)), more)


def hierarchical_prompt(df: DataFrame) -> Column:
    """Sections by column prefix; every JV_ column leaks, so that section stays empty. Needs `features`."""
    names = F.transform("features", lambda x: x["column_name"])
    parts, placed = [_said(HEADER)], []
    for title, prefixes in SECTIONS.items():
        columns = [c for c in df.columns if c.startswith(prefixes) and not leaks(c)]
        if not columns:
            continue
        placed += columns
        lines = F.array_compact(F.array(*(F.when(F.lit(c in PRIMARY_COLUMNS or c in SECONDARY_COLUMNS) | F.array_contains(names, c), F.concat(F.lit(f"- {label(c)}: "), meaningful(F.col(f"`{c}`").cast("string")))) for c in columns)))
        parts.append(F.when(F.size(lines) > 0, F.concat(_said("", f"{title}:"), lines)).otherwise(F.array().cast("array<string>")))
    left = F.filter("features", lambda x: ~x["column_name"].isin(placed)) if placed else F.col("features")
    parts.append(F.when(F.size(left) > 0, F.concat(_said("", OTHER), feature_lines(left))).otherwise(F.array().cast("array<string>")))
    return _text(*parts)


def messages(system: str, prompt: Column, answer: Column) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.lit(system)), ("user", prompt), ("assistant", answer))))
