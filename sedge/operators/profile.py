"""Column profiles and rare features of wide string tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.missing import meaningful

#: Columns that leak the target, and name parts of rare processing steps.
LEAKAGE_PREFIXES = ("Ref_", "JV_", "Stabilised_performance_", "EQE_", "Stability_", "Outdoor_", "Stability_PCE_", "Outdoor_PCE_", "Outdoor_power_generated")
METADATA_COLUMNS = ("Ref_ID", "Ref_ID_temp", "Ref_name_of_person_entering_the_data", "Ref_data_entered_by_author", "Ref_DOI_number", "Ref_lead_author", "Ref_journal", "Ref_original_filename_data_upload", "Ref_free_text_comment", "Ref_internal_sample_id", "JV_link_raw_data", "Stabilised_performance_link_raw_data", "EQE_link_raw_data", "Stability_link_raw_data_for_stability_trace", "Outdoor_link_raw_data_for_outdoor_trace")
RARE_KEYWORDS = ("additives", "quenching", "after_treatment", "surface_treatment", "storage", "humidity", "atmosphere", "encapsulation", "flexible", "semitransparent", "module", "solvent_annealing", "pressure", "passivation")


def leaks(column: str) -> bool:
    return column in METADATA_COLUMNS or column.startswith(LEAKAGE_PREFIXES)


def leaks_target(column: str) -> bool:
    """Narrower: of the JV_ columns only those named after a target."""
    return leaks(column) and (not column.startswith("JV_") or column in METADATA_COLUMNS or any(t in column for t in ("PCE", "Voc", "Jsc", "FF")))


def cells(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep..., column_name, value) of every cell that isn't missing: one pass, no shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), meaningful(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns))
    return df.select(*keep, F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("_cell")).select(*keep, "_cell.column_name", "_cell.value")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, value_count)."""
    return cells(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("value_count"))


def nonempty_counts(counts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, nonempty, n_distinct) from value_counts; with `columns`, empty columns come out as 0."""
    out = counts.groupBy("column_name").agg(F.sum("value_count").alias("nonempty"), F.count("*").alias("n_distinct"))
    if columns is None:
        return out
    every = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column_name"))
    return every.join(out, "column_name", "left").select("column_name", F.coalesce("nonempty", F.lit(0)).alias("nonempty"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def is_rare(rows: Column, coverage: float = 0.20, frequency: float = 0.02) -> Column:
    """On (column_name, value, nonempty, value_count): not inactive, and little covered, rare, true or named so."""
    v = F.lower(F.col("value"))
    named = F.lower("column_name").rlike("|".join(RARE_KEYWORDS))
    n = F.greatest(rows, F.lit(1))
    return ~v.isin("false", "0", "0.0") & ((F.col("nonempty") / n < coverage) | (F.col("value_count") / n < frequency) | (v == "true") | named)


def rare_features(df: DataFrame, id_column: str, columns: list[str], used: tuple[str, ...] = (), coverage: float = 0.20, frequency: float = 0.02, most: int = 60) -> DataFrame:
    """(id, position, column_name, value): each row's rare features, the rarest first, at most `most`.

    Leaking columns and those in `used` are pruned from the scan. The counts join by shuffle or, where small, by
    AQE's choice as a broadcast; a window over one row's own cells ranks them.
    """
    columns = [c for c in columns if not leaks(c) and c not in used]
    if not columns:
        return df.select(id_column, F.lit(0).alias("position"), F.lit("").alias("column_name"), F.lit("").alias("value")).where("false")
    counts = value_counts(df, columns)
    stats = counts.join(nonempty_counts(counts).select("column_name", "nonempty"), "column_name")
    found = cells(df, columns, id_column).join(stats, ["column_name", "value"]).where(is_rare(F.lit(df.count()), coverage, frequency))
    w = Window.partitionBy(id_column).orderBy("nonempty", "value_count", "column_name")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select(id_column, "position", "column_name", "value")
