"""Votes of several extraction runs, probe stability, and corrections by critique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(leaf: DataFrame, by: list[str], run: str = "run", value: str = "value") -> DataFrame:
    """(by..., value, votes): the value most runs agree on, case and blanks aside; nulls lose, ties go to the
    earliest run, whose spelling comes out. Two partial aggregations, no window over runs."""
    key = F.lower(F.trim(F.col(value)))
    given = F.nullif(key, F.lit("")).isNotNull()
    votes = leaf.groupBy(*by, F.when(given, key).alias("_key")).agg(F.count("*").alias("votes"), F.min(F.struct(run, value)).alias("_first"))
    best = F.max(F.struct(F.col("_key").isNotNull().alias("g"), F.col("votes"), (-F.col(f"_first.{run}")).alias("r"), F.col(f"_first.{value}").alias("v")))
    return votes.groupBy(*by).agg(best.alias("b")).select(*by, F.when(F.col("b.g"), F.col("b.v")).alias(value), F.when(F.col("b.g"), F.col("b.votes")).otherwise(0).alias("votes"))


def longest_list(runs: DataFrame, by: list[str], items: str, run: str = "run") -> DataFrame:
    """(by..., run, size) of the longest list, the earliest of equals."""
    n = F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))
    return runs.groupBy(*by).agg(F.max(F.struct(n.alias("n"), (-F.col(run)).alias("r"))).alias("b")).select(*by, (-F.col("b.r")).alias(run), F.col("b.n").alias("size"))


def probe_stability(answers: DataFrame, by: list[str], probes: int = 2) -> DataFrame:
    """(by..., stability, stable) from (by..., answered, matches): stable from half on if all probes were answered."""
    n, m = F.count_if("answered"), F.count_if(F.col("answered") & F.col("matches"))
    share = F.try_divide(m.cast("double"), n)
    return answers.groupBy(*by).agg(F.round(share, 2).alias("stability"), F.when(n >= probes, share >= 0.5).alias("stable"))


def apply_corrections(leaf: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves with the corrections that aren't null; value_original keeps what was replaced."""
    new = corrections.where("correction IS NOT NULL").groupBy(*keys).agg(F.min("correction").alias("correction"))
    out = leaf.join(new, keys, "left")
    changed = F.col("correction").isNotNull()
    return out.withColumn("value_original", F.when(changed, F.col("value"))).withColumn("value", F.coalesce("correction", "value")).drop("correction")


def flag_suspects(items: DataFrame, suspects: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds suspect: whether a critique names the item, case and blanks aside."""
    named = suspects.select(*keys, F.lower(F.trim(F.col(name))).alias("_name")).where("_name IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    out = items.withColumn("_name", F.lower(F.trim(F.col(name)))).join(named, [*keys, "_name"], "left")
    return out.withColumn("suspect", F.coalesce("_hit", F.lit(False))).drop("_hit", "_name")
