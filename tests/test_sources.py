import json

import pytest
from pyspark.sql import functions as F

from pairsieve.sources import readers, writers
from pairsieve.streaming.windows import windowed_rates


def test_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('"bare"\n\n{"claim": "c", "text": "t"}\nnot json\n{"x": 1}\n')
    got = [r[0] for r in readers.json_lines(spark, str(p)).select(readers.text_of(F.col("v"))).collect()]
    assert got[:2] == ["bare", "c"] and json.loads(got[2]) == {"x": 1}
    with pytest.raises(Exception):
        readers.json_lines(spark, str(p), strict=True).collect()
    assert readers.json_lines(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    with pytest.raises(Exception):
        readers.text_lines(spark, str(tmp_path / "none")).collect()


def test_documents_and_folders(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"prompt": "p", "label": True}, {"prompt": None}]}))
    assert [tuple(r) for r in readers.data_document(spark, str(tmp_path / "d.json"), "struct<prompt:string,label:boolean>").collect()] == [("p", True), (None, None)]
    f = spark.createDataFrame([("/x/2/a",), ("/x/2/b",), ("/x/1/a",), ("/x/1/b",), ("/x/3/a",)], "path string")
    done = readers.complete_folders(f, ["a", "b"])
    assert {r.folder for r in done.collect()} == {"/x/1", "/x/2"} and readers.latest_folder(done).first().folder == "/x/2"
    assert readers.latest_folder(done.limit(0)).count() == 0


def test_folders_with_alternates_and_names(spark):
    f = spark.createDataFrame([("/x/1/a",), ("/x/1/b2",), ("/x/2/a",)], "path string")
    assert [r.folder for r in readers.complete_folders(f, ["a", ("b", "b2")]).collect()] == ["/x/1"]
    c = spark.createDataFrame([((1, ("x", 2)),)], "c struct<b:int,a:struct<z:string,y:int>>")
    d = spark.createDataFrame([((("x", 2)[::-1], 1),)], "c struct<a:struct<y:int,z:string>,b:int>")
    assert c.select(readers.config_name(c, "c")).first()[0] == d.select(readers.config_name(d, "c")).first()[0]


def test_files_by_rule(spark, tmp_path):
    for run, name, text in (("r1", "samples_b.txt", "bb"), ("r1", "samples_a.txt", "aa\nab"), ("r2", "samples_c.txt", "cc"), ("r3", "samples_d.txt", ""), ("r2", "results_1.json", "{}")):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(text)
    root = f"file:{tmp_path}"
    assert readers.files(spark, root).count() == 4  # the empty file is left out
    assert readers.first_of(spark, root, ["none_*", "samples_*"]).endswith("r1/samples_a.txt") and readers.first_of(spark, root, ["none_*"]) is None
    assert readers.last_of(spark, root, "samples_*").endswith("r2/samples_c.txt")
    assert {r.run: r.value for r in readers.run_texts(spark, root).collect()} == {"r1": "aa\nab", "r2": "cc"}


def test_runs_ranges_bundles(spark, tmp_path):
    runs = spark.createDataFrame([("a", ["t"], "finished"), ("b", ["t"], "failed"), ("c", None, "finished")], "run string, tags array<string>, state string")
    h = [spark.createDataFrame([("a", 1), ("b", 2)], "run string, x int"), spark.createDataFrame([("a", "y"), ("c", "z")], "run string, y string")]
    assert sorted(map(tuple, readers.run_histories(runs, "t", h).collect()), key=repr) == [("a", 1, None), ("a", None, "y")]
    assert [r.id for r in readers.row_range(spark.range(10), "id", 3, 5).collect()] == [3, 4]
    assert [r.id for r in readers.matching(spark.range(10), F.col("id") > 2, ["id"], 2).collect()] == [3, 4]
    (tmp_path / "q.jsonl").write_text('"one"\n{"question": "two"}\n')
    b = readers.bundle(spark, str(tmp_path), {"question": "q.jsonl", "fact": "none.jsonl"})
    assert {(r.kind, r.t) for r in b.select("kind", readers.text_of(F.col("v")).alias("t")).collect()} == {("question", "one"), ("question", "two")}
    c = readers.with_defaults(spark.createDataFrame([("x", None)], "a string, b string"), {"b": "0", "c": "1"}).first()
    assert (c.a, c.b, c.c) == ("x", "0", "1")


def test_written_sets(spark, tmp_path):
    folder = writers.run_folder(str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, k string")
    writers.write_set(df, folder, {"z": 1, "a": 2}, 7, "k")
    m = spark.read.json(f"{folder}/metadata").first()
    assert m.rows == 3 and m.seed == 7 and json.loads(m.config) == {"a": 2, "z": 1} and m.counts.asDict() == {"a": 2, "null": 1}
    assert spark.read.json(f"{folder}/data").count() == 3
    with pytest.raises(Exception):
        writers.write_set(df, folder, {}, 7)
    for _ in range(2):
        writers.append(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2025-01-0{1 + i % 3} 10:00:00", "ab"[i % 2], i) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, t string, k string, v int").withColumn("ts", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "e"))
    stream = windowed_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", "k", F.col("v") > 10)
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, windowed_rates(df, "ts", "k", F.col("v") > 10).collect()))
