"""Regression baselines on device rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.missing import meaningful
from sedge.functions.numbers import parse_float
from sedge.functions.splits import split_name
from sedge.operators import prompts, targets
from sedge.operators.evaluation import regression_metrics
from sedge.operators.profile import leaks_target, rare_features
from sedge.sources.tables import cut_packed

MAX_CATEGORIES = 50


def numeric_columns(df: DataFrame, columns: list[str], share: float = 0.9) -> list[str]:
    """Columns that hold a number in at least that share of all rows, missing ones counted; one pass."""
    n = F.greatest(F.count("*"), F.lit(1))
    row = df.agg(*((F.count(parse_float(F.col(c))) / n).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] >= share]


def safe_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that are there and don't tell the target, each once, in their order."""
    return [c for c in dict.fromkeys(columns) if c in df.columns and c not in targets.TARGET_COLUMNS.values() and not leaks_target(c)]


def feature_columns(df: DataFrame, representation: str = "core_rare", id_column: str = "row_id") -> list[str]:
    """The features of a representation: the core columns, the secondary ones, and those of the rows' rare features."""
    if representation not in ("core", "core_secondary", "core_rare", "hierarchical"):
        raise ValueError(f"unknown feature representation: {representation}")
    columns = list(prompts.PRIMARY_COLUMNS)
    if representation in ("core_secondary", "hierarchical"):
        columns += prompts.SECONDARY_COLUMNS
    if representation in ("core_rare", "hierarchical"):
        rare = rare_features(df, id_column, [c for c, t in df.dtypes if t == "string"], prompts.LISTED_COLUMNS)
        columns += sorted(r["column_name"] for r in rare.select("column_name").distinct().collect())  # at most the table's columns
    return safe_columns(df, columns)


def prepare(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Numbers as doubles, null where there is none, and categories with "missing": row by row, nothing is learned."""
    return df.withColumns({c: parse_float(F.col(c)) for c in numeric} | {c: F.coalesce(meaningful(F.col(c)), F.lit("missing")) for c in categorical})


def ridge(target: str, alpha: float, n: int, deviation: float) -> LinearRegression:
    """Ridge with an unpenalised intercept; the solver scales the label, so alpha is scaled back."""
    return LinearRegression(labelCol=target, elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * deviation / n)


def _counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, v, n): how often each value of each column is given, in one pass."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))).alias("x")).select("x.*")
    return cells.where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))


def _frequent(df: DataFrame, categorical: list[str]) -> dict[str, list[str]]:
    """The MAX_CATEGORIES - 1 most frequent values of each column."""
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
    out: dict[str, list[str]] = {c: [] for c in categorical}
    for r in _counts(df, categorical).withColumn("k", place).where(F.col("k") < MAX_CATEGORIES).orderBy("c", "k").collect():
        out[r["c"]].append(r["v"])
    return out


def _medians(df: DataFrame, numeric: list[str]) -> dict[str, float]:
    """The lower median of each column that has numbers, exact at any size."""
    by = Window.partitionBy("c")
    ranked = _counts(df, numeric).select("c", "v", F.sum("n").over(by.orderBy("v")).alias("upto"), F.sum("n").over(by).alias("all"))
    return {r["c"]: r["v"] for r in ranked.where("2 * upto >= all").groupBy("c").agg(F.min("v").alias("v")).collect()}


class Learned:
    """What turns prepared rows into features: frequent values, medians, and a pipeline of scales and categories."""

    def __init__(self, frequent: dict[str, list[str]], medians: dict[str, float], pipeline: PipelineModel | None = None):
        self.frequent, self.medians, self.pipeline = frequent, medians, pipeline

    def filled(self, df: DataFrame) -> DataFrame:
        grouped = {c: F.when(F.col(c).isin(top), F.col(c)).otherwise("other") for c, top in self.frequent.items()}
        return df.withColumns(grouped | {f"{c}_f": F.coalesce(F.col(c), F.lit(m)) for c, m in self.medians.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.filled(df))


class Fitted:
    """A regressor with what was learned for its features."""

    def __init__(self, learned: Learned, regressor):
        self.learned, self.regressor = learned, regressor

    def transform(self, df: DataFrame) -> DataFrame:
        return self.regressor.transform(self.learned.transform(df))


def learn(df: DataFrame, numeric: list[str], categorical: list[str], model: str = "ridge") -> Learned:
    """Learned from prepared training rows, the same for any target.

    ridge takes categories one-hot, the frequent ones by themselves; random_forest and gradient_boosting as ordinals.
    A column without any number in the training rows is left out.
    """
    medians = _medians(df, numeric) if numeric else {}
    numeric = [c for c in numeric if c in medians]
    out = Learned(_frequent(df, categorical) if categorical else {}, {c: medians[c] for c in numeric})
    stages = [StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep")] if categorical else []
    inputs = [f"{c}_i" for c in categorical]
    if model == "ridge" and categorical:
        stages.append(OneHotEncoder(inputCols=inputs, outputCols=[f"{c}_h" for c in categorical]))
        inputs = [f"{c}_h" for c in categorical]
    stages += [VectorAssembler(inputCols=[f"{c}_f" for c in numeric], outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_s", withMean=True)] if numeric else []
    stages.append(VectorAssembler(inputCols=(["_s"] if numeric else []) + inputs, outputCol="features"))
    out.pipeline = Pipeline(stages=stages).fit(out.filled(df))
    return out


def regress(df: DataFrame, target: str, model: str = "ridge", alpha: float = 1.0, trees: int = 200, depth: int = 24):
    """A model of a target fitted on rows with features."""
    if model == "ridge":
        row = df.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("d")).first()
        return ridge(target, alpha, row["n"], row["d"] or 1.0).fit(df)
    if model == "random_forest":
        return RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, maxBins=128, seed=17).fit(df)
    if model == "gradient_boosting":
        return GBTRegressor(labelCol=target, maxIter=trees, stepSize=0.05, maxDepth=min(depth, 4), subsamplingRate=0.85, maxBins=128, seed=17).fit(df)
    raise ValueError(f"unknown model: {model}")


def fit(df: DataFrame, numeric: list[str], categorical: list[str], target: str, model: str = "ridge", **more) -> Fitted:
    """A model fitted on prepared training rows, with all that it learns from them: medians, scales, categories."""
    learned = learn(df, numeric, categorical, model)
    return Fitted(learned, regress(learned.transform(df), target, model, **more))


def _split(df: DataFrame, split_key: str, train: float, validation: float, seed: int) -> DataFrame:
    """Rows with targets within their limits, and their split by key; rows without a key are left out."""
    rows = targets.valid_rows(df, max_error=None)
    return rows.withColumn("split", split_name(meaningful(F.col(split_key)), train, validation, seed)).where("split IS NOT NULL")


def run_rows(df: DataFrame, split_key: str = "Ref_DOI_number", train: float = 0.8, validation: float = 0.1, seed: int = 17) -> DataFrame:
    """(rows_total, rows_used, train_rows, test_rows): what a baseline is fitted and tested on."""
    s = _split(df, split_key, train, validation, seed).agg(F.count_if(F.col("split").isin("train", "test")).alias("rows_used"), F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "test").alias("test_rows"))
    return df.agg(F.count("*").alias("rows_total")).join(s).select("rows_total", "rows_used", "train_rows", "test_rows")  # one row each


def baseline(df: DataFrame, representation: str = "core_rare", model: str = "ridge", split_key: str = "Ref_DOI_number", id_column: str = "row_id", seed: int = 17, **more) -> tuple[dict, DataFrame]:
    """The summary of a run, and (field, n, mae, rmse, r2) of its four targets on the test rows.

    Everything that is learned is learned from the training rows; which columns are numeric is told by them too. Rows are
    read and parsed once for that and once for all else: features are the same for all targets.
    """
    columns = feature_columns(targets.valid_rows(df, max_error=None), representation, id_column)
    rows = _split(df, split_key, 0.8, 0.1, seed).where("split IN ('train', 'test')")
    numeric = numeric_columns(rows.where("split = 'train'"), columns)
    categorical = [c for c in columns if c not in numeric]
    prepared = cut_packed(prepare(rows, numeric, categorical).select("split", *targets.FIELDS, *columns))
    learned = learn(prepared.where("split = 'train'"), numeric, categorical, model)
    told = cut_packed(learned.transform(prepared).select("split", *targets.FIELDS, "features"))
    train, test, metrics = told.where("split = 'train'"), told.where("split = 'test'"), None
    for field in targets.FIELDS:
        fitted = regress(train, field, model, **more)
        own = regression_metrics(fitted.transform(test).select(F.lit(field).alias("field"), F.col(field).alias("truth"), F.col("prediction").alias("pred")))
        metrics = own if metrics is None else metrics.unionByName(own)
    n = {r["split"]: r["count"] for r in prepared.groupBy("split").count().collect()}
    counts = {"rows_total": df.count(), "rows_used": sum(n.values()), "train_rows": n.get("train", 0), "test_rows": n.get("test", 0)}
    summary = {"model": model, "representation": representation, "split_key": split_key, "feature_count": len(columns), "feature_columns": columns, **counts}
    return summary, metrics
