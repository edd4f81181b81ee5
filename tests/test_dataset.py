import json
import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sedge.functions.splits import split_name
from sedge.operators import dataset, evaluation, sequences, targets
from sedge.sources import files

ROW = {
    "Cell_architecture": "nip", "Cell_stack_sequence": "SLG | FTO | TiO2 | Perovskite | Spiro-MeOTAD | Au", "Perovskite_composition_short_form": "MAPbI", "Perovskite_composition_long_form": "MAPbI3", "Perovskite_band_gap": "1.55",
    "Perovskite_deposition_procedure": "Spin-coating", "Perovskite_deposition_thermal_annealing_temperature": "100", "Perovskite_deposition_thermal_annealing_time": "10", "ETL_stack_sequence": "TiO2", "HTL_stack_sequence": "Spiro-MeOTAD",
    "Backcontact_stack_sequence": "Au", "JV_light_intensity": "100", "JV_default_PCE": "12", "JV_default_Voc": "1.0", "JV_default_Jsc": "20", "JV_default_FF": "0.6",
}


def _csv(path, keys, **change):
    names = ["Ref_DOI_number", *ROW]
    lines = [",".join(names)] + [",".join(f'"{v}"' for v in (k, *(ROW | change).values())) for k in keys]
    Path(path).write_text("\ufeff" + "\n".join(lines) + "\n", encoding="utf-8")


def _lines(folder):
    return [json.loads(x) for f in sorted(Path(folder).glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]


@pytest.mark.parametrize("representation", dataset.REPRESENTATIONS)
def test_build_from_a_csv(spark, tmp_path, representation):
    found = {r["s"]: r["k"] for r in spark.range(400).select(F.concat(F.lit("10.0000/test-"), "id").alias("k")).withColumn("s", split_name(F.col("k"), 0.8, 0.1, 17)).collect()}
    _csv(tmp_path / "in.csv", [found[s] for s in dataset.SPLITS])
    config = dataset.Config(representation=representation)
    made = dataset.build(files.read_csv(spark, str(tmp_path / "in.csv")), "row_id", str(tmp_path / "out"), config, "in.csv")
    assert (made["rows_read"], made["rows_written"], made["rows_skipped"]) == (3, 3, 0) and made["split_counts"] == {"train": 1, "validation": 1, "test": 1}
    saved = json.loads("".join(f.read_text() for f in (tmp_path / "out" / f"{config.prefix}.summary.json").glob("part-*")))
    assert saved == made
    for split in dataset.SPLITS:
        (record,) = _lines(tmp_path / "out" / f"{config.prefix}.{split}.jsonl")
        assert [m["role"] for m in record["messages"]] == ["system", "user", "assistant"]
        asked, said = record["messages"][1]["content"], json.loads(record["messages"][2]["content"])
        assert asked.startswith("Task: Predict perovskite solar-cell JV performance.") and "cell architecture: nip" in asked and "perovskite composition long form: MAPbI3" in asked and "jv default pce:" not in asked.lower()
        assert [said["prediction"][f"{f}_bin"] for f in targets.FIELDS] == ["10-15", "1-1.1", "20-25", "0.6-0.7"]
        assert record["metadata"] == {"split_key": found[split], "input_representation": representation, "output_schema": config.schema}


def test_rows_that_are_skipped(spark, tmp_path):
    _csv(tmp_path / "a.csv", ["10.0000/a", "nan", "10.0000/b"])
    _csv(tmp_path / "b.csv", ["10.0000/c"], JV_default_PCE="60")
    df = files.read_csv(spark, str(tmp_path / "a.csv")).unionByName(files.read_csv(spark, str(tmp_path / "b.csv")))
    s = dataset.summary(df, dataset.Config()).first()
    assert (s["rows_read"], s["rows_skipped"], s["rows_written"]) == (4, 2, 2)
    assert dataset.summary(df.limit(0), dataset.Config()).first()["rows_read"] == 0
    assert dataset.summary(df.drop("Ref_DOI_number"), dataset.Config()).first()["rows_written"] == 0
    with pytest.raises(ValueError):
        dataset.summary(df, dataset.Config(train=0.9, validation=0.1))
    with pytest.raises(ValueError):
        dataset.examples(df, "row_id", dataset.Config(representation="other"))


def _answer(pce, voc=1.0, jsc=20.0, ff=0.6, **more):
    return json.dumps({"prediction": {"pce": pce, "voc": voc, "jsc": jsc, "ff": ff, **more}})


def test_metrics_of_a_predictions_file(spark, tmp_path):
    rng = random.Random(3)
    truths = [rng.uniform(1, 24) for _ in range(40)]
    rows = []
    for i, t in enumerate(truths):
        p = _answer(t + rng.uniform(-4, 4), jsc=None if i == 5 else 20.0, **({"pce_bin": "huge"} if i == 6 else {"voc_bin": "0-0.6"} if i == 7 else {}))
        p = {1: f"```json\n{p}\n```", 2: f"I think: {p} fits", 3: "no idea", 4: None, 8: _answer(50.0), 9: "[1]"}.get(i, p)
        rows.append({"index": i, "ground_truth_text": _answer(t), "prediction_text": p, "metadata": {"split_key": "é"}})
    rows.append({"index": 40, "ground_truth_text": "none", "prediction_json": json.loads(_answer(10.0)), "prediction_text": "not read"})
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    m = files.evaluate_predictions(spark, str(tmp_path / "p.jsonl"), str(tmp_path / "m.json"), str(tmp_path / "m.csv"))
    assert json.loads((tmp_path / "m.json").read_text()) == json.loads(json.dumps(m))
    assert m["rows"] == 41 and m["json_validity_rate"] == 38 / 41 and m["ground_truth_validity_rate"] == 40 / 41
    read = [(t, json.loads(re.search(r"\{.*\}", r["prediction_text"])[0])["prediction"]["pce"]) for t, r in zip(truths, rows) if r["index"] not in (3, 4, 9)]
    e = [p - t for t, p in read]
    mean = sum(t for t, _ in read) / len(read)
    got = m["field_metrics"]["pce"]
    assert got["count"] == 37 and math.isclose(got["mae"], sum(map(abs, e)) / 37) and math.isclose(got["rmse"], math.sqrt(sum(x * x for x in e) / 37))
    assert math.isclose(got["r2"], 1 - sum(x * x for x in e) / sum((t - mean) ** 2 for t, _ in read)) and m["field_metrics"]["voc"]["r2"] is None
    assert m["field_validity"]["jsc"]["predicted_count"] == 37 and m["missing_prediction_rate"]["jsc"] == 4 / 41
    v = m["physics_verification"]
    assert v["range_violations"] == {"pce": sum(not 0 <= p <= 35 for _, p in read)} and v["invalid_bin_labels"] == {"pce_bin": 1} and v["bin_mismatches"] == {"voc_bin": 1}
    assert v["schema_invalid_count"] == 4 and sum(g["rows"] for g in m["pce_subgroups"].values()) == 40
    assert sum(n for row in m["bin_confusion"]["pce"].values() for n in row.values()) == 37
    flat = dict(evaluation.flat_document(m))
    assert flat["pce_subgroups.low_pce_lt_5.field_metrics.pce.count"] == m["pce_subgroups"]["low_pce_lt_5"]["field_metrics"]["pce"]["count"]
    assert spark.read.csv(str(tmp_path / "m.csv"), header=True).count() == len(flat)
    files.write_predictions(files.read_predictions(spark, str(tmp_path / "p.jsonl")), str(tmp_path / "again"))
    assert files.evaluate_predictions(spark, str(tmp_path / "again")) == m
    assert all(x.isascii() for f in (tmp_path / "again").glob("part-*") for x in f.read_text(encoding="utf-8"))


def test_metrics_over_no_records(spark):
    empty = spark.createDataFrame([], "prediction_text string, ground_truth_text string")
    m = evaluation.compute_metrics(empty)
    assert m["rows"] == 0 and m["json_validity_rate"] is None and m["field_metrics"]["pce"] == {"count": 0, "mae": None, "rmse": None, "r2": None} and m["physical_consistency"]["max"] is None


def test_violations_say_what_would_be_right(spark):
    df = spark.createDataFrame([(_answer(40.0, pce_bin="huge", ff_bin="0-0.4"), None)], "prediction_text string, ground_truth_text string")
    c = evaluation.parsed_predictions(df).first()["check"]
    assert [r.asDict() for r in c["range_violations"]] == [{"field": "pce", "value": 40.0, "low": 0.0, "high": 35.0}]
    assert c["invalid_bin_labels"][0]["allowed"] == sorted(targets.bin_labels("pce")) and c["bin_mismatches"][0].asDict() == {"field": "ff_bin", "value": "0-0.4", "expected": "0.6-0.7"}


def test_numbering_and_batches(spark):
    rng = random.Random(1)
    values = [rng.randrange(50) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    got = {r["id"]: (r["index"], r["batch"]) for r in sequences.batches(df, [F.desc("v"), "id"], 32).collect()}
    want = sorted(range(300), key=lambda i: (-values[i], i))
    assert got == {i: (k, k // 32) for k, i in enumerate(want)}
    assert [r["id"] for r in sequences.first_rows(df, [F.desc("v"), "id"], 5).orderBy("index").collect()] == want[:5]
    assert sequences.first_rows(df, ["id"], None).count() == 300 and sequences.batches(df.limit(0), ["id"], 3).count() == 0
