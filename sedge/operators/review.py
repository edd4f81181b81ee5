"""Reviews of extractions by an injected client: record text, probes, critiques and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.operators.grounding import PROBE_SCORE, partial_ratio
from sedge.operators.voting import probe_stability

CRITIQUE = "struct<wrong_section_fields:array<struct<field:string,correct_value:string>>,missing_fields:array<string>,product_as_precursor:array<struct<name:string>>,overall_quality:string,summary:string>"
NO_ANSWER = "NOT FOUND"


#: Characters of a source that are shown: of a field, and of a field within a group or a precursor.
SHOWN, SHOWN_INSIDE = 120, 100


def record_text(fields: dict[str, Column], precursors: Column, sources: dict[str, Column] | None = None, precursor_sources: Column | None = None) -> Column:
    """A record as lines "field: value" and "  precursor: name | conc: concentration"; fields without a value are left out.

    With `sources` each line shows the start of its source, and fields without a value come out as None;
    `precursor_sources` is an array in the order of the precursors.
    """

    def shown(source: Column, field: str) -> Column:
        return F.substring(F.coalesce(source, F.lit("")), 1, SHOWN_INSIDE if "." in field else SHOWN)

    def line(n: str, c: Column) -> Column:
        if sources is None:
            return F.concat(F.lit(f"{n}: "), c)
        return F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit("None")), F.lit(" (source: "), shown(sources.get(n, F.lit("")), n), F.lit(")"))

    lines = F.array_compact(F.array(*(line(n, c) for n, c in fields.items())))
    named = F.coalesce(precursors, F.array().cast("array<struct<name:string,concentration:string>>"))

    def precursor(p: Column, i: Column) -> Column:
        said = F.concat(F.lit("  precursor: "), F.coalesce(p["name"], F.lit("None")), F.lit(" | conc: "), F.coalesce(p["concentration"], F.lit("None")))
        if precursor_sources is None:
            return said
        return F.concat(said, F.lit(" | source: "), F.substring(F.coalesce(F.get(precursor_sources, i), F.lit("")), 1, SHOWN_INSIDE))

    return F.array_join(F.concat(lines, F.transform(named, precursor)), "\n")


def parse_critique(raw: Column) -> Column:
    """The JSON of an answer, else a critique of unknown quality with the start of the answer as its summary."""
    s = F.trim(F.regexp_replace(raw, r"[\p{Cntrl}&&[^\t\n\r]]", ""))
    # what stands between the first and the last brace; fences and prose around it don't matter
    inner = F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))
    s = F.trim(F.regexp_replace(s, r"```[a-z]*", ""))
    none = F.array().cast("array<struct<field:string,correct_value:string>>")
    default = F.struct(none.alias("wrong_section_fields"), F.array().cast("array<string>").alias("missing_fields"), F.array().cast("array<struct<name:string>>").alias("product_as_precursor"), F.lit("unknown").alias("overall_quality"), F.substring(s, 1, 300).alias("summary"))
    return F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, CRITIQUE)).otherwise(default.cast(CRITIQUE))


def critique_counts(critique: Column) -> Column:
    def n(name: str) -> Column:
        return F.greatest(F.coalesce(F.size(critique[name]), F.lit(0)), F.lit(0)).alias(name)

    return F.struct(n("wrong_section_fields"), n("missing_fields"), n("product_as_precursor"))


def corrections(reviews: DataFrame, id_column: str, critique: str = "critique") -> DataFrame:
    """(id, path, correction) of the fields that a critique corrects."""
    x = reviews.select(id_column, F.explode(F.col(critique)["wrong_section_fields"]).alias("x"))
    return x.where("x.correct_value IS NOT NULL AND x.field <> ''").select(id_column, F.col("x.field").alias("path"), F.col("x.correct_value").alias("correction"))


def ask(df: DataFrame, prompt: str, clients: list[Callable[[str], str]], out: str = "answer") -> DataFrame:
    """Adds the first answer that a list of clients gives, in their order; null if all fail."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            answers = []
            for x in s:
                got = None
                for client in clients if isinstance(x, str) else ():
                    try:
                        got = client(x)
                        break
                    except Exception:
                        continue
                answers.append(got)
            yield pd.Series(answers, dtype="string")

    return df.withColumn(out, run(F.col(prompt)))


def answers_match(answer: Column, value: Column, least: float = PROBE_SCORE) -> Column:
    """Whether an answer states a value, by the best window's similarity; NOT FOUND doesn't."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, v in batches:
            yield pd.Series([isinstance(x, str) and isinstance(y, str) and NO_ANSWER not in x.upper() and partial_ratio(y.lower().strip(), x.lower()) >= least for x, y in zip(a, v)], dtype="boolean")

    return run(answer, value)


def probe(leaf: DataFrame, questions: DataFrame, clients: list[Callable[[str], str]], id_column: str) -> DataFrame:
    """(id, path, stability, stable) of leaves (id, path, value, context) by questions (path, question)."""
    q = leaf.where("value IS NOT NULL").join(questions, "path").withColumn("_prompt", F.concat_ws("\n\n", "context", "question"))
    a = ask(q, "_prompt", clients).withColumn("answered", F.col("answer").isNotNull())
    return probe_stability(a.withColumn("matches", answers_match(F.col("answer"), F.col("value"))), [id_column, "path"])


#: Two questions a field that is often taken from the wrong section.
PROBES = {
    "process_conditions.temperature": ("Which temperature was the film or material heated to? Give the number and its unit.", "How hot was the sample kept in the thermal step of the procedure?"),
    "process_conditions.annealing": ("How was the film annealed after deposition: temperature and time?", "Which thermal treatment followed deposition, and how long did it take?"),
    "process_conditions.duration": ("How long did the main step of synthesis or annealing take?", "Which processing time is given for the key step?"),
    "process_conditions.atmosphere": ("Under which gas or atmosphere was the work done?", "Was the step done in an inert gas, and in which?"),
    "material": ("Which perovskite was made? Give its formula.", "What is the formula of the main material?"),
    "precursors": ("Which precursors was the perovskite made from?", "Which salts or reagents does the procedure name?"),
}
PROBE = "An excerpt of a paper:\n\n{}\n\n{}\n\nAnswer in one short sentence from the excerpt only, or with NOT FOUND."
REVIEW = "Check a record against the paper it was taken from.\n\nRecord:\n{}\n\nPaper:\n{}\n\nName wrong and missing fields and products that are listed as precursors, as JSON."


def filled(template: str, *parts: Column) -> Column:
    """The template with a column in each pair of braces."""
    texts = [F.lit(x) for x in template.split("{}")]
    return F.concat(*(c for pair in zip(texts, [*parts, F.lit("")]) for c in pair))


def verify_probes(leaf: DataFrame, clients: list[Callable[[str], str]], id_column: str, questions: dict[str, tuple[str, ...]] = PROBES) -> tuple[DataFrame, DataFrame]:
    """(id, path, stability, stable) of leaves (id, path, value, context), and (id, n_probed, n_unstable).

    Every question about a leaf is asked; a leaf is told stable or not where all its questions were answered.
    """
    rows = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(q).alias("question")) for p, qs in questions.items() for q in qs))
    asked = leaf.where("value IS NOT NULL AND trim(value) <> ''").withColumn("_q", F.explode(F.filter(rows, lambda x: x["path"] == F.col("path")))).withColumn("_prompt", filled(PROBE, F.col("context"), F.col("_q.question")))
    answered = ask(asked, "_prompt", clients).withColumn("answered", F.col("answer").isNotNull())
    found = probe_stability(answered.withColumn("matches", answers_match(F.col("answer"), F.col("value"))), [id_column, "path"], 2).where("stability IS NOT NULL")
    return found, found.groupBy(id_column).agg(F.count("*").alias("n_probed"), F.count_if(F.col("stability") < 0.5).alias("n_unstable"))


def review(records: DataFrame, record: str, text: str, clients: list[Callable[[str], str]]) -> DataFrame:
    """Adds critique and its counts to records (their text form) with the texts they were taken from."""
    asked = ask(records.withColumn("_prompt", filled(REVIEW, F.coalesce(record, F.lit("")), F.coalesce(text, F.lit("")))), "_prompt", clients)
    out = asked.withColumn("critique", parse_critique(F.coalesce("answer", F.lit(""))))
    return out.withColumn("counts", critique_counts(F.col("critique"))).drop("_prompt", "answer")
