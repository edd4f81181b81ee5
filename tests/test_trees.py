import json

from pyspark.sql import functions as F

from sedge.operators import review, trees
from sedge.sources import files

TEXT = "Films were annealed at 100 C for ten minutes in nitrogen. The solvent was a mixture of DMF and DMSO in four to one."
RECORD = {
    "title": {"value": "T", "source": "short"}, "process_conditions": {"temperature": {"value": "100 C", "source": "annealed at 100 C for ten minutes", "source_doc": "si"}, "duration": {"value": "10 min", "source": ""}},
    "device_performance": {"pce": {"value": None, "source": "Table 1, row 2 of the paper"}}, "precursors": [{"name": "PbI2", "concentration": "1 M", "source": "x"}, {"name": "MAI", "source": "a source that stands nowhere in it at all"}], "other": [1, {"a": "b"}],
}


def _df(spark):
    return spark.createDataFrame([(1, json.dumps(RECORD), TEXT), (2, "not json", TEXT), (3, None, None), (4, "{}", "")], "id int, record string, text string")


def test_leaves_and_grounding(spark):
    df = _df(spark)
    got = {r["id"]: [x.asDict() for x in r["l"] or []] for r in df.select("id", trees.leaf_rows(F.col("record")).alias("l")).collect()}
    assert [x["path"] for x in got[1]] == ["title", "process_conditions.temperature", "process_conditions.duration", "device_performance.pce", "precursors.0", "precursors.1"]
    assert got[1][1]["source_doc"] == "si" and got[2] == got[3] == got[4] == []
    g = df.withColumn("g", trees.ground_tree(F.col("record"), F.col("text")))
    tree = json.loads(g.where("id = 1").first()["g"])
    assert tree["process_conditions"]["temperature"]["grounded"] is True and tree["process_conditions"]["temperature"]["span"] == {"start": 11, "end": 44}
    assert tree["title"]["grounded"] is None and tree["process_conditions"]["duration"]["grounded"] is False and tree["device_performance"]["pce"]["grounded"] == "table"
    c = {r["id"]: (tuple(r["c"]), r["s"], tuple(r["m"])) for r in g.withColumn("c", trees.tree_counts(F.col("g"))).select("id", "c", trees.tree_score(F.col("c")).alias("s"), trees.grounded_leaves(F.col("g")).alias("m")).collect()}
    # the precursor without a value can't be told either, so the denominator shrinks
    assert c[1] == ((3, 1, 2), 1.0, (1, 6)) and c[4] == ((0, 0, 0), 0.0, (0, 0))


def test_leaves_are_set(spark):
    changes = [("process_conditions.temperature", '{"value": "90 C"}'), ("new.deep.leaf", '{"value": 1}')]
    df = spark.createDataFrame([(json.dumps(RECORD), changes), (None, changes), ("{}", None)], "record string, c array<struct<path:string,json:string>>")
    out = [json.loads(r[0]) for r in df.select(trees.set_leaves(F.col("record"), F.col("c"))).collect()]
    assert out[0] == RECORD | {"process_conditions": RECORD["process_conditions"] | {"temperature": {"value": "90 C"}}, "new": {"deep": {"leaf": {"value": 1}}}}
    assert out[1]["new"] == {"deep": {"leaf": {"value": 1}}} and out[2] == {}


def test_extraction_in_runs(spark):
    def extractor(text, temperature):
        if text == "broken" or (text == "once" and temperature):
            raise ValueError
        hot = temperature > 0
        return {"material": {"value": "MAPbI3" if hot else "FAPbI3", "source": "s"}, "precursors": [{"name": "a"}] * (3 if hot else 1), "substrate": {"value": "glass", "source": str(temperature)}}, f"m{temperature}"

    docs = spark.createDataFrame([(1, "fine"), (2, "broken"), (3, "once")], "doc int, text string")
    runs = trees.extraction_runs(docs, "doc", "text", extractor, n=3)
    assert runs.count() == 9
    out = {r["doc"]: (json.loads(r["record"]), r["model"]) for r in trees.merge_runs(runs, "doc").collect()}
    assert out[1][0]["material"]["value"] == "MAPbI3" and out[1][0]["substrate"]["source"] == "0.0" and len(out[1][0]["precursors"]) == 3 and out[1][1] == "m0.0"
    assert out[2] == ({"error": trees.RUNS_FAILED}, "unknown") and out[3][0]["material"]["value"] == "FAPbI3"


def test_probes_and_review(spark):
    leaf = spark.createDataFrame([(1, "material", "MAPbI3", TEXT), (1, "process_conditions.atmosphere", "argon", TEXT), (2, "material", None, TEXT), (3, "material", "CsPbI3", TEXT)], "id int, path string, value string, context string")

    def client(prompt):
        if "CsPbI3" in prompt or "perovskite was made" in prompt:
            return "It is MAPbI3."
        return "NOT FOUND"

    found, totals = review.verify_probes(leaf, [client], "id")
    got = {(r["id"], r["path"]): (r["stability"], r["stable"]) for r in found.collect()}
    assert got == {(1, "material"): (0.5, True), (1, "process_conditions.atmosphere"): (0.0, False), (3, "material"): got[3, "material"]} and got[3, "material"][0] <= 0.5
    assert {r["id"]: (r["n_probed"], r["n_unstable"]) for r in totals.where("id = 1").collect()} == {1: (2, 1)}
    said = json.dumps({"wrong_section_fields": [{"field": "material", "correct_value": "X"}], "missing_fields": [], "product_as_precursor": [], "overall_quality": "good", "summary": "s"})
    out = review.review(spark.createDataFrame([(1, "r", "t"), (2, None, None)], "id int, record string, text string"), "record", "text", [lambda p: f"```json\n{said}\n```" if "\nr\n" in p else "fine"]).orderBy("id").collect()
    assert out[0]["critique"]["overall_quality"] == "good" and out[0]["counts"]["wrong_section_fields"] == 1
    assert out[1]["critique"]["overall_quality"] == "unknown" and out[1]["critique"]["summary"] == "fine"


def test_small_sources(spark, tmp_path):
    (tmp_path / "d.dvc").write_text("outs:\n- md5: abc\n  path: d\n")
    (tmp_path / "c.yaml").write_text("a: {b: 1}\n")
    assert files.data_version(str(tmp_path / "d.dvc")) == "abc" and files.data_version(str(tmp_path / "none")) is None and files.read_config(str(tmp_path / "c.yaml")) == {"a": {"b": 1}}
    assert files.split_paths("x", "core")["test"].endswith("core.test.jsonl")
    assert files.process_role({}) == {"rank": 0, "world_size": 1, "main": True, "distributed": False} and files.process_role({"RANK": "2", "WORLD_SIZE": "4"})["main"] is False
    docs = spark.createDataFrame([(1, bytearray(b"good")), (2, bytearray(b"bad")), (3, None)], "id int, content binary")
    parsers = [("first", lambda b: {"text": "1:" + b.decode()} if b == b"good" else 1 / 0), ("second", lambda b: None)]
    got = {r["id"]: (r["parser"], r["text"]) for r in files.extract_by_cascade(docs, "id", "content", parsers).collect()}
    assert got == {1: ("first", "1:good"), 2: ("failed: ZeroDivisionError", None), 3: ("failed: no parser", None)}
