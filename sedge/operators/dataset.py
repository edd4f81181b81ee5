"""The chat dataset of a device table: which rows count, their prompts and answers, their splits and the summary."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.missing import meaningful
from sedge.functions.splits import check_ratios, split_name
from sedge.operators import prompts, targets
from sedge.operators.profile import rare_features
from sedge.sources.tables import cut

SPLIT_KEY = "Ref_DOI_number"
SPLITS = ("train", "validation", "test")
REPRESENTATIONS = ("core", "core_secondary", "core_rare", "hierarchical")
#: Fixed value: what the assistant is told.
SYSTEM = "You predict perovskite solar-cell JV performance from structured device recipes. Return only valid JSON matching the requested schema."


@dataclass(frozen=True)
class Config:
    """What is built: max_error None or negative keeps rows of any consistency error."""

    representation: str = "core_rare"
    schema: str = "performance_with_justification"
    split_key: str = SPLIT_KEY
    train: float = 0.8
    validation: float = 0.1
    seed: int = 17
    max_error: float | None = 5.0
    coverage: float = 0.2
    frequency: float = 0.02
    most_features: int = 60

    @property
    def prefix(self) -> str:
        return f"{self.representation}__{self.schema}"


def marked(df: DataFrame, config: Config) -> DataFrame:
    """Adds the targets, _key and _split (train, validation, test, or null for a row that is skipped).

    A row is skipped without valid targets, or without a key: the split key's value, else the DOI. Columns that the
    table lacks count as missing.
    """
    check_ratios(config.train, config.validation)
    lacking = [c for c in targets.USED_COLUMNS if c not in df.columns]
    out = targets.with_targets(df.withColumns({c: F.lit(None).cast("string") for c in lacking}))
    good = targets.valid_targets(None if config.max_error is None or config.max_error < 0 else config.max_error)
    keys = [meaningful(F.col(f"`{c}`").cast("string")) for c in dict.fromkeys((config.split_key, SPLIT_KEY)) if c in df.columns]
    key = F.coalesce(*keys) if keys else F.lit(None).cast("string")
    return out.withColumn("_key", key).withColumn("_split", F.when(F.coalesce(good, F.lit(False)) & F.col("_key").isNotNull(), split_name(F.col("_key"), config.train, config.validation, config.seed)))


def examples(df: DataFrame, id_column: str, config: Config) -> DataFrame:
    """(id, messages, metadata, split) of the rows that count. Rare features are told by the counts of all rows."""
    if config.representation not in REPRESENTATIONS:
        raise ValueError(f"unknown input representation: {config.representation}")
    rows = marked(df, config).where("_split IS NOT NULL")
    if config.representation in ("core_rare", "hierarchical"):
        columns = [c for c, t in df.dtypes if t == "string"]
        rows = prompts.with_rare_features(rows, id_column, rare_features(df, id_column, columns, prompts.LISTED_COLUMNS, config.coverage, config.frequency, config.most_features))
    build = {"core": prompts.core_prompt, "core_secondary": prompts.core_secondary_prompt, "core_rare": prompts.core_rare_prompt, "hierarchical": prompts.hierarchical_prompt}[config.representation]
    said = prompts.messages(SYSTEM, build(rows), F.to_json(targets.target_struct(config.schema)))
    about = F.struct(F.col("_key").alias("split_key"), F.lit(config.representation).alias("input_representation"), F.lit(config.schema).alias("output_schema"))
    return rows.select(id_column, said.alias("messages"), about.alias("metadata"), F.col("_split").alias("split"))


def summary(df: DataFrame, config: Config) -> DataFrame:
    """(rows_read, rows_skipped, rows_written, train, validation, test) in one pass without building anything."""
    split = F.col("_split")
    counts = [F.count_if(F.coalesce(split == s, F.lit(False))).alias(s) for s in SPLITS]
    return marked(df, config).agg(F.count("*").alias("rows_read"), F.count_if(split.isNull()).alias("rows_skipped"), F.count(split).alias("rows_written"), *counts)


def build(df: DataFrame, id_column: str, folder: str, config: Config | None = None, source: str = "") -> dict:
    """Writes the examples as JSON lines, a folder "<prefix>.<split>.jsonl" each, and returns the summary, which is
    also written as "<prefix>.summary.json". Every split is written, an empty one too; rows without an id get one."""
    config = config or Config()
    if id_column not in df.columns:
        df = cut(df.withColumn(id_column, F.monotonically_increasing_id()))
    made = examples(df, id_column, config)
    for s in SPLITS:
        made.where(F.col("split") == s).select("messages", "metadata").write.mode("overwrite").json(f"{folder}/{config.prefix}.{s}.jsonl")
    counts = summary(df, config).first().asDict()
    out = {"input_csv": source, "output_dir": folder, "input_representation": config.representation, "output_schema": config.schema, "split_key": config.split_key}
    out |= {k: counts[k] for k in ("rows_read", "rows_skipped", "rows_written")} | {"split_counts": {s: counts[s] for s in SPLITS}}
    df.sparkSession.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{config.prefix}.summary.json")
    return out

