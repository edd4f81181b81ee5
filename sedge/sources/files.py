"""Files in and out: device CSV, JSON lines, YAML records and registries, checksums, manifests, metric tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHAT = "messages array<struct<role:string,content:string>>, metadata struct<split_key:string,input_representation:string,output_schema:string>"


_ANSWER = "struct<prediction:map<string,string>,confidence:string,justification:array<string>>"
#: A prediction record; its checks aren't read again.
PREDICTIONS = f"index long, metadata struct<split_key:string,input_representation:string,output_schema:string>, prompt_text string, ground_truth_text string, ground_truth_json {_ANSWER}, prediction_text string, prediction_json {_ANSWER}"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The prediction records of JSON lines."""
    return read_jsonl(spark, path, PREDICTIONS)


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order and other characters escaped, a file a task."""
    plain = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})

    @F.pandas_udf("string")
    def escaped(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(json.loads(x), sort_keys=True))

    df.select(escaped(plain).alias("value")).write.mode("overwrite").text(path)


def evaluate_predictions(spark: SparkSession, path: str, json_path: str | None = None, csv_path: str | None = None) -> dict:
    """The metrics of the prediction records of a file, written as one JSON document and as a flat table where asked."""
    from sedge.operators.evaluation import compute_metrics, metrics_table

    document = compute_metrics(read_predictions(spark, path))
    if json_path:
        write_json(document, json_path)
    if csv_path:
        write_metrics(metrics_table(spark, document), csv_path)
    return document


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the types that its values have; empty ones are null. One more pass tells the types."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"', encoding="UTF-8")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A device CSV: header, UTF-8 with or without a mark, quoted line breaks, every value a string ("" if empty)."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns))


def read_jsonl(spark: SparkSession, path: str, schema: str = CHAT, allow_empty: bool = True) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    if not allow_empty and df.isEmpty():
        raise ValueError(f"{path} has no records")
    return df


def write_splits(df: DataFrame, path: str, split: str = "split") -> dict[str, int]:
    """JSON lines, a folder a split; keys in order, other characters as they are. Returns the rows of each split,
    counted while they are written."""
    columns = sorted(c for c in df.columns if c != split)
    names = ("train", "validation", "test")
    seen = Observation()
    rows = df.select(*columns, split).observe(seen, *(F.count_if(F.col(split) == s).alias(s) for s in names))
    rows.write.mode("overwrite").partitionBy(split).json(path)
    return {s: seen.get[s] for s in names}


def write_metrics(flat: DataFrame, path: str) -> None:
    """(metric, value) as one sorted CSV file: a report of a few rows."""
    flat.coalesce(1).sortWithinPartitions("metric").write.mode("overwrite").csv(path, header=True)


def write_json(payload: dict, path: str) -> None:
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")


def read_yaml_records(spark: SparkSession, folder: str, name: str = "output.yaml") -> DataFrame:
    """(source_file, raw_json) of the YAML records below a folder; a file without content is {} (the
    file reader leaves out files of no bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(folder)

    @F.pandas_udf("string")
    def to_json(content: pd.Series) -> pd.Series:
        import yaml

        return content.map(lambda b: json.dumps(yaml.safe_load(bytes(b)) or {}, ensure_ascii=False, default=str))

    return files.select(F.element_at(F.split("path", "/"), -2).alias("source_file"), to_json("content").alias("raw_json"))


def read_registry(spark: SparkSession, path: str, allowed: set[str] | None = None) -> DataFrame:
    """(name, family, description, hyperparameters) of a YAML registry; names outside `allowed` are an error."""
    import yaml

    entries = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if allowed is not None and (unknown := set(entries) - allowed):
        raise ValueError(f"unknown entries: {sorted(unknown)}")
    rows = [(k, v.get("family"), v.get("description"), {a: json.dumps(b) for a, b in (v.get("default_hyperparameters") or {}).items()}) for k, v in entries.items()]
    return spark.createDataFrame(rows, "name string, family string, description string, hyperparameters map<string,string>")


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(split, path, sha256, rows, bytes) of the files of each split; rows are lines that aren't blank."""
    out = None
    for split, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        lines = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != ""))
        one = files.select(F.lit(split).alias("split"), "path", F.sha2("content", 256).alias("sha256"), lines.cast("bigint").alias("rows"), F.col("length").alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def extract_documents(spark: SparkSession, folder: str, parser: Callable[[bytes], dict], pattern: str = "*.pdf") -> DataFrame:
    """(path, parser, text) of documents by a given parser; a document that fails comes out with null text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    got = parser(bytes(content))
                    rows.append((path, got.get("parser"), got.get("text")))
                except Exception as e:  # one broken file doesn't end the scan
                    rows.append((path, f"failed: {type(e).__name__}", None))
            yield pd.DataFrame(rows, columns=["path", "parser", "text"])

    return files.mapInPandas(run, "path string, parser string, text string")


def call_service(df: DataFrame, column: str, client: Callable[[str], str | None], out: str = "answer") -> DataFrame:
    """Adds the answer of an injected client to each row; null on any failure."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            answers = []
            for x in s:
                try:
                    answers.append(client(x))
                except Exception:
                    answers.append(None)
            yield pd.Series(answers, dtype="string")

    return df.withColumn(out, ask(F.col(column)))


def by_family(registry: DataFrame, family: str) -> DataFrame:
    return registry.where(F.col("family") == family).orderBy("name")


def parameter_totals(parameters: DataFrame) -> DataFrame:
    """(total, trainable, percent) of (name, n, trainable)."""
    t = F.sum(F.when(F.col("trainable"), F.col("n")).otherwise(0))
    return parameters.agg(F.sum("n").alias("total"), t.alias("trainable"), F.try_divide(100.0 * t, F.sum("n")).alias("percent"))


def numeric_log(values: dict) -> list[tuple[str, float]]:
    """The numbers of a flat mapping, as a long table for a tracker; other values are left out."""
    return sorted((k, float(v)) for k, v in values.items() if isinstance(v, int | float) and not isinstance(v, bool))


def commit_id(folder: str = ".") -> str | None:
    """The checked-out commit of a folder, null where there is none."""
    import subprocess

    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=30).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def data_version(file: str) -> str | None:
    """The hash that a data-version file (YAML, outs with md5) records, null where there is none."""
    import yaml

    try:
        outs = (yaml.safe_load(Path(file).read_text(encoding="utf-8")) or {}).get("outs") or []
    except (OSError, yaml.YAMLError, AttributeError):
        return None
    return next((str(o["md5"]) for o in outs if isinstance(o, dict) and o.get("md5")), None)


def read_config(path: str) -> dict:
    """A YAML configuration; an empty file is empty."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def split_paths(folder: str, prefix: str) -> dict[str, str]:
    """Where the splits of a dataset are."""
    return {s: str(Path(folder) / f"{prefix}.{s}.jsonl") for s in ("train", "validation", "test")}


def process_role(environment: dict[str, str]) -> dict:
    """Rank, number and whether this is the main one of several processes, as their launcher tells it."""
    rank, size = int(environment.get("RANK", "0")), int(environment.get("WORLD_SIZE", "1"))
    return {"rank": rank, "world_size": size, "main": rank == 0, "distributed": size > 1}


def extract_by_cascade(df: DataFrame, key: str, content: str, parsers: list[tuple[str, Callable[[bytes], dict | None]]]) -> DataFrame:
    """(key, parser, text) of documents by the first of several parsers, in their order, that gives a text; the last
    error where none does."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, raw in zip(pdf[key], pdf[content]):
                row = (k, "failed: no parser", None)
                for name, parser in parsers if raw is not None else ():
                    try:
                        got = parser(bytes(raw))
                        if got and got.get("text"):
                            row = (k, name, got["text"])
                            break
                    except Exception as e:  # the next parser is tried
                        row = (k, f"failed: {type(e).__name__}", None)
                rows.append(row)
            yield pd.DataFrame(rows, columns=[key, "parser", "text"])

    return df.select(key, content).mapInPandas(run, f"`{key}` {kind}, parser string, text string")
