import json

import pytest
from pyspark.sql import functions as F

from sedge.sources import tables
from sedge.sources import files
from sedge.streaming.events import split_stream, windowed_error


def test_csv_keeps_strings_and_line_breaks(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes('﻿a,b\n1,"x\ny"\n,"say ""hi"""\n'.encode())
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "d.csv")).collect()] == [("1", "x\ny"), ("", 'say "hi"')]


def test_jsonl_splits_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("train", "é", 1), ("test", "b", 2)], "split string, text string, n int")
    files.write_splits(df, str(tmp_path / "out"))
    back = files.read_jsonl(spark, str(tmp_path / "out/split=train"), "n int, text string")
    assert [tuple(r) for r in back.collect()] == [(1, "é")]
    m = files.manifest(spark, {"train": str(tmp_path / "out/split=train")}).first()
    assert m["rows"] == 1 and len(m["sha256"]) == 64
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "empty.jsonl"), allow_empty=False)


def test_yaml_and_registry(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1/output.yaml").write_text("title: T\nn: 1\n")
    (tmp_path / "p2").mkdir()
    (tmp_path / "p2/output.yaml").write_text("# nothing\n")
    got = {r["source_file"]: json.loads(r["raw_json"]) for r in files.read_yaml_records(spark, str(tmp_path)).collect()}
    assert got == {"p1": {"title": "T", "n": 1}, "p2": {}}
    (tmp_path / "r.yaml").write_text("lora:\n  family: peft\n  default_hyperparameters:\n    rank: 16\n")
    r = files.read_registry(spark, str(tmp_path / "r.yaml"), {"lora"}).first()
    assert r["family"] == "peft" and r["hyperparameters"] == {"rank": "16"}
    with pytest.raises(ValueError):
        files.read_registry(spark, str(tmp_path / "r.yaml"), {"full"})


def test_parsers_and_services_survive_failures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parser(content):
        if content == b"bad":
            raise ValueError
        return {"parser": "stub", "text": content.decode()}

    got = {r["path"][-5:]: (r["parser"], r["text"]) for r in files.extract_documents(spark, str(tmp_path), parser).collect()}
    assert got == {"a.pdf": ("stub", "good"), "b.pdf": ("failed: ValueError", None)}
    df = spark.createDataFrame([("a",), (None,)], "q string")
    assert sorted(map(str, (r["answer"] for r in files.call_service(df, "q", lambda x: x + "!").collect()))) == ["None", "a!"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", d * 1.0, h * 1.0) for d in range(1, 4) for h in range(5)]
    df = spark.createDataFrame(rows, "ts string, truth double, pred double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_error(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed_error(df).collect()))
    q = split_stream(stream, "ts").writeStream.format("memory").queryName("s").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert spark.table("s").groupBy("split").count().collect()


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        def __init__(self, master, named):
            self.master, self.named = master, named

        def getConf(self):
            return {"spark.checkpoint.dir": self.named} if self.named else {}

    class Session:
        def __init__(self, *args):
            self.sparkContext, self.conf = Context(*args), {}

    assert tables.checkpoint_folder(Session("spark://host:7077", "hdfs://shared/c")) == "hdfs://shared/c"
    assert "sedge-checkpoint-" in tables.checkpoint_folder(Session("local[4]", None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            tables.checkpoint_folder(Session(master, None))


def test_typed_csv_and_counted_writes(spark, tmp_path):
    (tmp_path / "d.csv").write_text('a,b,c\n1,1.5,x\n2,,"y\nz"\n')
    assert files.read_typed_csv(spark, str(tmp_path / "d.csv")).dtypes == [("a", "int"), ("b", "double"), ("c", "string")]
    df = spark.createDataFrame([("train", 1), ("train", 2), ("test", 3)], "split string, v int")
    assert files.write_splits(df, str(tmp_path / "out")) == {"train": 2, "validation": 0, "test": 1}
    assert spark.read.json(str(tmp_path / "out")).count() == 3
