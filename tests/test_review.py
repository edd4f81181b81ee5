from pyspark.sql import functions as F

from sedge.operators import review
from sedge.sources.files import by_family, commit_id, numeric_log, parameter_totals


def test_critiques(spark):
    raws = ['```json\n{"wrong_section_fields": [{"field": "a.b", "correct_value": "x"}, {"field": "c", "correct_value": null}], "product_as_precursor": [{"name": "P"}]}\n```', "no json\x07 here", '{"broken": ', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string").withColumn("critique", review.parse_critique(F.col("raw")))
    got = {r["id"]: r["critique"] for r in df.collect()}
    assert got[1]["overall_quality"] == "unknown" and got[1]["summary"] == "no json here" and got[2]["overall_quality"] == "unknown"
    assert [tuple(r) for r in review.corrections(df, "id").collect()] == [(0, "a.b", "x")]
    n = df.where("id = 0").select(review.critique_counts(F.col("critique")).alias("n")).first()["n"]
    assert (n["wrong_section_fields"], n["missing_fields"], n["product_as_precursor"]) == (2, 0, 1)


def test_probes_fall_back_through_clients(spark):
    def broken(_):
        raise RuntimeError

    def stub(prompt):
        return "It was heated to 100 C." if "How hot" in prompt else "NOT FOUND"

    leaf = spark.createDataFrame([(1, "t", "100 C", "text"), (1, "m", "MAPbI3", "text"), (2, "t", None, "text")], "doc int, path string, value string, context string")
    q = spark.createDataFrame([("t", "How hot?"), ("t", "Say: How hot was it?"), ("m", "What?"), ("m", "Which?")], "path string, question string")
    got = {(r["doc"], r["path"]): (r["stability"], r["stable"]) for r in review.probe(leaf, q, [broken, stub], "doc").collect()}
    assert got == {(1, "t"): (1.0, True), (1, "m"): (0.0, False)}


def test_small_tables(spark):
    p = spark.createDataFrame([("a", 90, False), ("b", 10, True)], "name string, n int, trainable boolean")
    assert tuple(parameter_totals(p).first()) == (100, 10, 10.0)
    r = spark.createDataFrame([("lora", "peft"), ("full", "full"), ("ia3", "peft")], "name string, family string")
    assert [x["name"] for x in by_family(r, "peft").collect()] == ["ia3", "lora"]
    assert numeric_log({"b": 1, "a": 0.5, "c": "x", "d": True}) == [("a", 0.5), ("b", 1.0)]
    assert commit_id("/nonexistent") is None
