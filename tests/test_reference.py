import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions.jsons import parse_object
from sedge.functions.missing import is_missing, is_missing_text, meaningful
from sedge.functions.numbers import parse_float
from sedge.functions.splits import check_ratios, split_name
from sedge.operators import attention, evaluation, grounding, ingest, models, profile, prompts, records, retrieval, sequences, targets, voting

DEVICE = {
    "Ref_ID": "1", "Cell_architecture": "nip", "Cell_stack_sequence": "SLG | FTO | TiO2 | Perovskite | Spiro-MeOTAD | Au", "Perovskite_composition_short_form": "MAPbI", "Perovskite_composition_long_form": "MAPbI3", "Perovskite_band_gap": "1.55", "Perovskite_deposition_procedure": "Spin-coating",
    "Perovskite_deposition_solvents": "DMF", "Perovskite_deposition_thermal_annealing_temperature": "100", "Perovskite_deposition_thermal_annealing_time": "10", "ETL_stack_sequence": "TiO2", "HTL_stack_sequence": "Spiro-MeOTAD", "Backcontact_stack_sequence": "Au", "JV_light_intensity": "100",
    "JV_default_PCE": "12", "JV_default_Voc": "1.0", "JV_default_Jsc": "20", "JV_default_FF": "0.6", "Encapsulation": "TRUE", "Cell_note": "0",
}


@pytest.fixture(scope="module")
def devices(spark):
    rows = [{**DEVICE, "Ref_DOI_number": f"10.0000/test-{i}"} for i in range(40)]
    return spark.createDataFrame(rows)


def test_golden_dataset_row(devices):
    v = targets.valid_rows(devices)
    assert v.count() == 40
    r = v.select(prompts.core_prompt(v).alias("p"), targets.target_struct().alias("t")).first()
    assert "- cell architecture: nip" in r["p"] and "- perovskite composition long form: MAPbI3" in r["p"] and "jv default pce:" not in r["p"]
    t = r["t"]["prediction"]
    assert [t[f"{f}_bin"] for f in targets.FIELDS] == ["10-15", "1-1.1", "20-25", "0.6-0.7"]
    assert r["t"]["confidence"] == "high" and len(r["t"]["justification"]) == 5
    splits = {x[0] for x in v.select(split_name(F.col("Ref_DOI_number"), 0.8, 0.1, 17)).collect()}
    assert splits <= {"train", "validation", "test"} and "train" in splits


def test_every_prompt(devices):
    f = profile.rare_features(devices, "Ref_DOI_number", devices.columns, prompts.PRIMARY_COLUMNS + prompts.SECONDARY_COLUMNS)
    assert {r["column_name"] for r in f.collect()} == {"Encapsulation"}
    t = prompts.with_rare_features(devices, "Ref_DOI_number", f)
    r = t.select(prompts.core_rare_prompt(t).alias("a"), prompts.hierarchical_prompt(t).alias("b"), prompts.core_secondary_prompt(t).alias("c")).first()
    assert r["a"].endswith("Activated rare or special features:\n- encapsulation: TRUE")
    assert "JV measurement" not in r["b"] and "\n\nDevice:\n- " in r["b"] and "Encapsulation:\n- encapsulation: TRUE" in r["b"]
    assert "Secondary process and measurement details:\n- perovskite deposition solvents: DMF" in r["c"]


def test_missing_and_numbers(spark):
    values = [None, "", " Unknown ", "nan;N/A", "N/A | ", "x; nan", "\tnone\n", "ok"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(is_missing(F.col("v"))).collect()] == [is_missing_text(v) for v in values] == [True] * 5 + [False, True, False]
    assert df.select(meaningful(F.col("v")).alias("m")).where("m = 'ok'").count() == 1
    nums = spark.createDataFrame([(v,) for v in ("1.5", " 2 ", "1d", "nan", "inf", "1e999", "1_0", "-.5e1", "abc", None)], "v string")
    assert [r[0] for r in nums.select(parse_float(F.col("v"))).collect()] == [1.5, 2.0, None, None, None, None, None, -5.0, None, None]
    for bad in ((0, 0.1), (0.8, -0.1), (0.9, 0.1)):
        with pytest.raises(ValueError):
            check_ratios(*bad)


def test_bins_and_significant_digits(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 4.999, 5.0, 25.0, 99.0, None)], "v double")
    assert [r[0] for r in df.select(targets.make_bin("pce", F.col("v"))).collect()] == ["<0", "0-5", "0-5", "5-10", "25+", "25+", None]
    errors = [0.0, 1.0, 0.5, 0.1234, 12.34, 123.4, 0.00567, 2.5]
    got = spark.createDataFrame([(v,) for v in errors], "v double").select(targets.three_digits(F.col("v"))).collect()
    assert [r[0] for r in got] == [f"{v:.3g}" for v in errors]


ANSWERS = [
    ('{"prediction": {"pce": 12, "voc": 1.0, "jsc": 20, "ff": 0.6, "pce_bin": "10-15"}}', (False, True)),
    ('```json\n{"prediction": {"pce": 12, "voc": 1.0, "jsc": 20, "ff": 0.6}}\n```', (False, True)),
    ('Sure: {"prediction": {"pce": 12, "voc": 1.0, "jsc": 20, "ff": 0.6}} done', (False, True)),
    ("[1]", (True, False)), ("", (True, False)), (None, (True, False)), ('{"prediction": {"pce": "NaN", "voc": 1.0, "jsc": 20, "ff": 0.6}}', (False, False)),
    ('{"prediction": {"pce": 40, "voc": 1.0, "jsc": 20, "ff": 0.6}}', (True, True)), ('{"prediction": {"pce": 12, "voc": 1.0, "jsc": 20, "ff": 0.6, "pce_bin": "5-10"}}', (True, True)),
    ('{"prediction": {"pce": 12, "voc": 1.0, "jsc": 20, "ff": 0.6, "pce_bin": "huge"}}', (True, True)), ('{"prediction": {"pce": 12, "voc": 1.0, "jsc": 20, "ff": 0.6, "pce_bin": null}}', (True, True)),
]


def test_verification_cases(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string").select("i", parse_object(F.col("a"))["prediction"].alias("p"))
    values = {f: parse_float(F.try_element_at("p", F.lit(f))) for f in targets.FIELDS}
    labels = {f: F.try_element_at("p", F.lit(f"{f}_bin")) for f in targets.FIELDS}
    has = {f: F.coalesce(F.map_contains_key("p", f"{f}_bin"), F.lit(False)) for f in targets.FIELDS}
    checks = df.select("i", evaluation.verification(values, labels, has, F.col("p").isNotNull()).alias("check"))
    for r in checks.orderBy("i").collect():
        assert (r["check"]["physically_inconsistent"], r["check"]["schema_valid"]) == ANSWERS[r["i"]][1], ANSWERS[r["i"]]
    s = evaluation.verification_summary(checks).first()
    assert s["n"] == len(ANSWERS) and s["n_inconsistent"] == 7


def test_metrics_over_nothing_and_by_hand(spark):
    schema = ", ".join(f"t_{f} double, p_{f} double" for f in targets.FIELDS)
    df = spark.createDataFrame([(10.0, 12.0, 1.0, 1.1, 20.0, None, 0.5, 0.5), (20.0, 16.0, 1.0, 0.9, 22.0, 21.0, 0.7, 0.6)], schema)
    m = {r["field"]: r for r in evaluation.regression_metrics(evaluation.pairs(df)).collect()}
    assert m["pce"]["mae"] == 3.0 and math.isclose(m["pce"]["rmse"], math.sqrt(10)) and math.isclose(m["pce"]["r2"], 1 - 20 / 50)
    assert m["voc"]["r2"] is None and m["jsc"]["n"] == 1
    g = evaluation.subgroup_metrics(df.limit(0)).collect()
    assert len(g) == 12 and all(r["n"] == 0 and r["mae"] is None for r in g)
    c = evaluation.confusion_matrix(evaluation.pairs(df))
    assert c.count() == 4 * 49 and c.where("field = 'pce'").agg(F.sum("n")).first()[0] == 2
    flat = evaluation.flatten_metrics(df.select(F.struct(F.struct(F.lit(1).alias("b")).alias("a"), F.array(F.lit(1)).alias("skip")).alias("m")).limit(1))
    assert [tuple(r) for r in flat.collect()] == [("m.a.b", 1.0)]


def test_bm25():
    text = "\n\n".join(f"paragraph {i} " + "filler words of no interest to anybody at all in this place " * 2 + ("anneal the perovskite film" if i in (3, 7) else "") for i in range(20))
    n, context = retrieval.retrieve(text, "perovskite anneal", top_k=2)
    assert n == 2 and context.index("paragraph 3") < context.index("paragraph 7")
    assert retrieval.retrieve("short", "x", budget=3) == (0, "sho") and retrieval.retrieve(None) == (0, "")
    long = "\n\n".join(["word " * 100] * 30)
    assert retrieval.retrieve(long, "word", budget=1200)[0] <= 3
    common = [["a", "b"], ["a", "c"], ["a", "d"]]
    s = retrieval.scores(common, ["a"])
    assert all(math.isfinite(x) for x in s)  # "a" is in every paragraph: its idf is negative and replaced


def test_grounding(spark):
    assert grounding.partial_ratio("anneal", "the annealing step") == 100.0
    assert grounding.plain("100 ℃ – x") == "100 °C - x"
    text = "The film was annealed at 100 °C for ten minutes in nitrogen before contact evaporation."
    assert grounding.find_span("annealed at 100 ℃ for ten", text) == (13, 39)
    assert grounding.find_span("annealled at 100 °C fer ten minutes", text) is not None
    assert grounding.find_span("entirely different sentence on another topic", text) is None and grounding.find_span("short", text) is None
    rows = [("annealed at 100 °C for ten", text), ("Table 2: PCE", text), ("short", text), ("", text), (None, text), ("the film was annealed", "THE FILM WAS ANNEALED"), ("wholly unrelated words are here", text)]
    got = grounding.ground(spark.createDataFrame(rows, "source string, text string"), "source", "text").collect()
    kinds = {(r["source"], r["grounded"]) for r in got}
    assert kinds == {("annealed at 100 °C for ten", "true"), ("Table 2: PCE", "table"), ("short", None), ("", "false"), (None, "false"), ("the film was annealed", "true"), ("wholly unrelated words are here", "false")}


def test_scores_of_records(spark):
    rows = [(1, True, "material", "MAPbI3", "true"), (1, True, "substrate", "glass", None), (1, True, "synthesis_method", None, "false"), (1, True, "precursors", "PbI2", "true"), (1, True, "precursors", "MAI", "table"), (1, True, "precursors", None, None), (2, False, "material", "x", "table"), (3, True, "substrate", "[]", "true")]
    df = spark.createDataFrame(rows, "id int, s boolean, path string, value string, grounded string")
    got = {r["id"]: r for r in grounding.record_scores(df, "id", "s").collect()}
    total = sum(grounding.WEIGHTS.values())
    assert got[1]["completeness"] == 3 / 9 and got[1]["missing_critical"] == "synthesis_method,process_conditions.temperature"
    assert math.isclose(got[1]["grounding_precision"], 2 / 3) and math.isclose(got[1]["weighted_score"], (3.0 + 0.5 + 3.0) / total)
    assert got[2]["completeness"] is None and got[2]["missing_critical"] == "" and got[2]["grounding_precision"] == 1.0
    assert got[3]["grounding_precision"] == 0.0 and got[3]["weighted_score"] == 0.0


def test_votes(spark):
    runs = spark.createDataFrame([(1, 0, "A"), (1, 1, "b"), (1, 2, " B "), (2, 0, None), (2, 1, "x"), (3, 0, "p"), (3, 1, "q"), (4, 0, None)], "doc int, run int, value string")
    got = {r["doc"]: (r["value"], r["votes"]) for r in voting.majority(runs, ["doc"]).collect()}
    assert got == {1: ("b", 2), 2: ("x", 1), 3: ("p", 1), 4: (None, 0)}
    lists = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "b"]), (1, 2, ["c", "d"]), (2, 0, None)], "doc int, run int, items array<string>")
    assert {r["doc"]: (r["run"], r["size"]) for r in voting.longest_list(lists, ["doc"], "items").collect()} == {1: (1, 2), 2: (0, 0)}
    probes = spark.createDataFrame([(1, True, True), (1, True, False), (2, True, True), (2, False, None)], "doc int, answered boolean, matches boolean")
    assert {r["doc"]: (r["stability"], r["stable"]) for r in voting.probe_stability(probes, ["doc"]).collect()} == {1: (0.5, True), 2: (1.0, None)}


def _dense(q, mask=None):
    s = q @ q.T / math.sqrt(q.shape[1])
    if mask is not None:
        s = np.where(mask, s, -np.inf)
    w = np.exp(s - s.max(1, keepdims=True))
    return (w / w.sum(1, keepdims=True)) @ q


def test_sparse_query_takes_its_length_from_the_table(spark, tmp_path):
    from sedge.plans import reference_queries as rq

    n, rng = 700, np.random.default_rng(8)
    e = rng.normal(size=(n, rq.HEADS * rq.SIZE)).astype("float32")
    spark.createDataFrame([(i, 0, [float(v) for v in e[i]]) for i in range(n)], "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = np.zeros((rq.HEADS, n, rq.SIZE))
    for r in rq.attention_sparse(spark, str(tmp_path)).collect():
        got[r["h"], r["qpos"], r["d"]] = r["value"]
    i = np.arange(n)
    mask = (abs(i[:, None] - i[None]) <= 25) | (i[None] < 20) | (i[:, None] < 20)
    for o in range(1, 9):
        mask |= i[None] == ((i[:, None] * attention.RANDOM_A + o * attention.RANDOM_B) % n)
    for h in range(rq.HEADS):
        np.testing.assert_allclose(got[h], _dense(e[:, h * rq.SIZE : (h + 1) * rq.SIZE].astype("float64"), mask), atol=1e-4)
    assert attention.length(spark.createDataFrame([], "pos bigint")) == 1


def test_attention_against_dense(spark):
    rng = np.random.default_rng(7)
    q = rng.normal(size=(12, 4))
    x = spark.createDataFrame([(0, 0, i, [float(v) for v in q[i]]) for i in range(12)], "b int, h int, pos int, vec array<double>")
    i = np.arange(12)

    def result(links):
        out = np.zeros((12, 4))
        for r in attention.attend(links, x, 4).collect():
            out[r["qpos"], r["d"]] = r["value"]
        return out

    np.testing.assert_allclose(result(attention.links_all(x)), _dense(q), atol=1e-9)
    np.testing.assert_allclose(result(attention.links_all(x, True)), _dense(q, i[None] <= i[:, None]), atol=1e-9)
    np.testing.assert_allclose(result(attention.links_local(x, 2)), _dense(q, abs(i[:, None] - i[None]) <= 2), atol=1e-9)
    mask = (abs(i[:, None] - i[None]) <= 2) | (i[None] < 1) | (i[:, None] < 1)
    for o in (1, 2):
        mask |= i[None] == ((i[:, None] * attention.RANDOM_A + o * attention.RANDOM_B) % 12)
    np.testing.assert_allclose(result(attention.links_sparse(x, 2, 1, 2, 12)), _dense(q, mask), atol=1e-9)
    phi = np.where(q > 0, q + 1, np.exp(q))
    lin = np.zeros((12, 4))
    for r in attention.attend_linear(x).collect():
        lin[r["qpos"], r["d"]] = r["value"]
    np.testing.assert_allclose(lin, (phi @ (phi.T @ q)) / (phi @ phi.sum(0))[:, None], atol=1e-9)


def test_sequences(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [7, 8], [1.0, 2.0]), ([1], [5, 6, 7, 8, 9, 10], [1.0] * 6)], "p array<int>, a array<int>, w array<double>")
    got = [r[0] for r in df.select(sequences.completion_only(F.col("p"), F.col("a"), F.col("w"), 5)).collect()]
    assert got[0]["input_ids"] == [2, 3, 4, 7, 8] and got[0]["labels"] == [-100] * 3 + [7, 8] and got[0]["loss_weights"] == [0.0] * 3 + [1.0, 2.0]
    assert got[1]["input_ids"] == [5, 6, 7, 8, 9] == got[1]["labels"]
    with pytest.raises(Exception, match="empty"):
        df.select(sequences.completion_only(F.col("p"), F.array().cast("array<int>"), F.col("w"), 5)).collect()
    with pytest.raises(ValueError):
        sequences.completion_only(F.col("p"), F.col("a"), F.col("w"), 1)
    text = json.dumps({"prediction": {"pce": 12.5, "voc": 1}})
    (_, a, b), = sequences.field_spans(text, "pce")
    assert text[a:b] == '"pce": 12.5'
    assert sequences.token_weights(text, [(0, 2), (a + 1, a + 3), (3, 3)], 1.0, {"prediction.pce": 4.0}) == [1.0, 4.0, 1.0]
    p = sequences.padded(spark.createDataFrame([(1, [1, 2]), (1, [3]), (2, [4])], "b int, ids array<int>"), "b", "ids", 0)
    assert sorted(r["padded"] for r in p.collect()) == [[1, 2], [3, 0], [4]]
    loss = spark.createDataFrame([(1, 0, 2.0, -100, 0.0), (1, 1, 4.0, 5, 3.0), (1, 2, 9.0, 6, 1.0)], "s int, i int, l double, y int, w double")
    assert sequences.weighted_loss(loss, "s", "i", "l", "y", "w").first()[0] == (2.0 * 3 + 4.0 * 1) / 4


def test_ingest(spark):
    heads = ["2 Experimental section", "Results and Discussion", "Optical properties", "Introduction", "Conclusions", "Acknowledgements", None]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in heads], "h string").select(ingest.classify_heading(F.col("h"))).collect()]
    assert got == ["experimental", "results", "other", "introduction", "conclusion", "other", "other"]
    blocks = spark.createDataFrame([(1, 1, 600.0, 320.0, 10.0, 20.0, "right top"), (1, 1, 600.0, 40.0, 50.0, 60.0, "left low"), (1, 1, 600.0, 40.0, 5.0, 9.0, " left top "), (1, 1, 600.0, 40.0, 200.0, 210.0, "Figure 1. A cell"), (1, 2, 600.0, 40.0, 80.0, 90.0, "Fig. 2: B")], "doc_id int, page int, page_width double, x0 double, y0 double, y1 double, text string")
    assert ingest.document_text(ingest.page_text(blocks)).first()["text"].startswith("[Page 1]\nleft top\nleft low\nFigure 1. A cell\nright top\n\n[Page 2]")
    images = spark.createDataFrame([(1, 1, 1, 300, 300, 100.0), (1, 1, 2, 100, 300, 100.0), (1, 2, 1, 300, 300, 100.0)], "doc_id int, page int, image_no int, width int, height int, y1 double")
    found = ingest.captions_below(images, blocks)
    assert [(r["page"], r["image_no"], r["caption"]) for r in found.collect()] == [(1, 1, "Figure 1. A cell"), (2, 1, "")]
    assert [(r["caption"], r["region_top"]) for r in ingest.uncovered_captions(blocks, found).collect()] == [("Fig. 2: B", 2.0)]
    sections = spark.createDataFrame([(1, 1, 0, "short"), (1, 1, 1, "Figure 1. A cell with a much longer caption than before")], "doc_id int, number int, ord int, caption string")
    assert ingest.enrich_captions(found, sections).first()["caption"].endswith("than before")
    xml = """<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title level="a">A <i>cell</i></title><idno type="DOI"> 10.0000/x </idno><abstract><div><p>Abstract words.</p></div></abstract></teiHeader><text><body>
<div><head>Experimental</head><p>Films <b>were</b> cast.</p><p>Then heated.</p><div><head>Results</head><p>nested</p></div></div><div><p>No head here.</p></div><div><head>Results</head><p>Good.</p></div><div><head>Thanks</head></div>
<figure><head>Figure 1.</head><figDesc>A cell.</figDesc></figure></body></text></TEI>"""
    docs = spark.createDataFrame([(1, xml), (2, "<html>waking up"), (3, None), (4, xml.replace(' xmlns="http://www.tei-c.org/ns/1.0"', ""))], "id int, xml string")
    t = ingest.tei_sections(docs, "xml", "id").where("id IN (1, 4)").orderBy("id", "ord").collect()
    want = [("experimental", "Experimental", "Films were cast.\n\nThen heated."), ("other", None, "No head here."), ("results", "Results", "Good.")]
    assert [(r["section"], r["head"], r["text"]) for r in t] == want * 2
    parts = {r["id"]: r["tei"] for r in ingest.tei(docs, "xml").collect()}
    assert (parts[1]["title"], parts[1]["doi"], parts[1]["abstract"], parts[1]["captions"]) == ("A cell", "10.0000/x", "Abstract words.", ["Figure 1. A cell."])
    assert parts[2]["error"] and parts[3]["error"] and not parts[2]["sections"]
    accepted = docs.select("id", ingest.is_tei(F.lit(200), F.col("xml")).alias("a"), ingest.is_tei(F.lit(503), F.col("xml")).alias("b")).orderBy("id").collect()
    assert [r["a"] for r in accepted] == [True, False, False, True] and not any(r["b"] for r in accepted)


def test_records(spark):
    raws = ["{}", '{"error": "x"}', '{"title": {"value": "T", "source": "s"}, "is_perovskite_synthesis": true, "precursors": [{"name": "A", "concentration": null}, {"name": null, "concentration": null}], "process_conditions": {"temperature": {"value": "100 C"}}, "junk": 1}']
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in raws], "raw string").select(records.normalise(F.col("raw"), F.lit("f")).alias("r")).collect()]
    assert [r["_meta"]["reason"] for r in got] == ["not_perovskite", "extraction_failed", None]
    assert got[0]["is_perovskite_synthesis"] is False and got[2]["title"] == "T" and got[2]["process_conditions"]["temperature"] == "100 C" and len(got[2]["precursors"]) == 1 and got[0]["precursors"] == []


def test_a_baseline_learns_from_training_rows_only(spark):
    from sedge.operators import models as mm

    rows = [(i, f"10.0000/{i % 60}", str(1.2 + (i % 7) / 10) if i % 11 else None, ("nip", "pin", None)[i % 3], "12", "1.0", "20", "0.6") for i in range(240)] + [(900, None, "1.5", "nip", "12", "1.0", "20", "0.6")]
    df = spark.createDataFrame(rows, "row_id int, Ref_DOI_number string, Perovskite_band_gap string, Cell_architecture string, JV_default_PCE string, JV_default_Voc string, JV_default_Jsc string, JV_default_FF string")
    summary, metrics = mm.baseline(df, "core")
    assert summary["feature_columns"] == ["Cell_architecture", "Perovskite_band_gap"] and summary["rows_total"] == 241 and summary["rows_used"] == summary["train_rows"] + summary["test_rows"] <= 240
    assert {r["field"]: r["n"] for r in metrics.collect()} == dict.fromkeys(targets.FIELDS, summary["test_rows"])
    prepared = mm.prepare(targets.with_targets(df), ["Perovskite_band_gap"], ["Cell_architecture"])
    fitted = mm.fit(prepared.where("row_id < 100"), ["Perovskite_band_gap"], ["Cell_architecture"], "pce")
    assert set(fitted.frequent["Cell_architecture"]) == {"nip", "pin", "missing"}
    assert mm.numeric_columns(df, ["Perovskite_band_gap", "JV_default_PCE"]) == ["Perovskite_band_gap", "JV_default_PCE"] and mm.numeric_columns(df.withColumn("x", F.when(F.col("row_id") < 200, "1")), ["x"]) == []


def test_attention_with_padding(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6, 4))
    x = attention.split_heads(spark.createDataFrame([(b, i, [float(y) for y in r]) for b in (0, 1) for i, r in enumerate(v)], "b int, i int, e array<double>"), "b", "i", "e", 1, 4)
    valid = x.where("b = 0 AND pos < 4").select("b", "pos")
    got = attention.attend(attention.masked(attention.links_all(x), valid), x, 4).collect()
    assert len(got) == 2 * 6 * 4
    out = np.zeros((2, 6, 4))
    for r in got:
        out[r["b"], r["qpos"], r["d"]] = r["value"]
    s = v @ v[:4].T / 2
    w = np.exp(s - s.max(1, keepdims=True))
    np.testing.assert_allclose(out[0], w @ v[:4] / w.sum(1, keepdims=True), atol=1e-9)
    np.testing.assert_allclose(out[1], np.repeat(v.mean(0, keepdims=True), 6, 0), atol=1e-9)
    phi = lambda a: np.where(a > 0, a + 1, np.exp(a))
    k = v * (np.arange(6) < 4)[:, None]
    want = (phi(v) @ (phi(k).T @ k)) / (phi(v) @ phi(k).sum(0))[:, None]
    lin = np.zeros((6, 4))
    for r in attention.attend_linear(x.where("b = 0"), valid=valid).collect():
        lin[r["qpos"], r["d"]] = r["value"]
    np.testing.assert_allclose(lin, want, atol=1e-9)
    for causal in (False, True):
        a, b = ({(r["qpos"], r["d"]): r["value"] for r in y.where("b = 0").collect()} for y in (attention.attend_blocked(x, x, 4, 4, causal), attention.attend(attention.links_all(x, causal), x, 4)))
        assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
    attention.check_shape(x, 4)
    for bad in (x.unionByName(x), x.withColumn("vec", F.slice("vec", 1, 3))):
        with pytest.raises(ValueError):
            attention.check_shape(bad, 4)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ np.array([2.0, -1.0]) + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = models.ridge("y", 1.0, 200, float(np.std(y))).fit(v)
    xc, yc = x - x.mean(0), y - y.mean()
    np.testing.assert_allclose(m.coefficients.toArray(), np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc), atol=1e-6)


@pytest.mark.parametrize("model", ["random_forest", "gradient_boosting"])
def test_tree_models_fit(devices, model):
    rows = targets.with_targets(devices).withColumn("pce", F.col("pce") + F.length("Ref_DOI_number"))
    rows = models.prepare(rows, ["Perovskite_band_gap"], ["Cell_architecture"])
    assert models.fit(rows, ["Perovskite_band_gap"], ["Cell_architecture"], "pce", model, trees=3, depth=3).transform(rows).count() == 40


def test_what_is_learned_serves_every_target(spark):
    rows = [(None if i % 5 == 0 else float(i), f"k{min(i % 60, 55)}", 2.0 * i, -1.0 * i) for i in range(1, 241)]
    df = spark.createDataFrame(rows, "a double, k string, y double, z double")
    given = sorted(r[0] for r in rows if r[0] is not None)
    learned = models.learn(df, ["a"], ["k"])
    assert learned.medians == {"a": given[(len(given) - 1) // 2]}
    assert len(learned.frequent["k"]) == models.MAX_CATEGORIES - 1 and learned.frequent["k"][0] == "k55"
    features = learned.transform(df).select("features", "y", "z").cache()
    for y in "yz":
        one = models.fit(df, ["a"], ["k"], y).transform(df).select("prediction").collect()
        np.testing.assert_allclose([r[0] for r in models.regress(features, y).transform(features).select("prediction").collect()], [r[0] for r in one])
