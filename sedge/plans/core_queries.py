"""Queries of the core problems (units, packed fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedge.operators.packed import split_packed
from sedge.operators.units import common_quantities
from sedge.sources.tables import table

PACKED_FIELDS = ["Cell_stack_sequence", "Perovskite_composition_a_ions", "Perovskite_composition_a_ions_coefficients", "Backcontact_thickness_list"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return common_quantities(table(spark, d, "devices"), table(spark, d, "extractions"), table(spark, d, "source_units"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "devices"), "row_id", PACKED_FIELDS)


QUERIES = {"p3_found": p3_found, "p7_found": p7_found}
SQL: dict[str, str] = {}
