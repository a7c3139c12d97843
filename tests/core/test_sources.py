"""Readers and writers on small files."""

import gzip
import json
import tarfile

import numpy as np
import pytest
from acquira.sources import readers, writers
from acquira.streaming.answers import answers_by_window

XML = "<annotation><size><width>200</width><height>100</height><depth>3</depth></size>{}</annotation>"
OBJECT = "<object><name>{}</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>30</xmax><ymax>40</ymax></bndbox></object>"


def test_counts(spark, tmp_path):
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        json.dump({"000000000001": {"person": 2, "sofa": 1}}, f)
    assert sorted(map(tuple, readers.read_counts(spark, str(tmp_path / "c.json.gz")).collect())) == [("000000000001", "couch", 1), ("000000000001", "person", 2)]
    (tmp_path / "bad.json").write_text(json.dumps({"1": {"person": 0}}))
    with pytest.raises(Exception, match="bad count"):
        readers.read_counts(spark, str(tmp_path / "bad.json")).collect()


def test_annotations(spark, tmp_path):
    d = tmp_path / "xml"
    d.mkdir()
    (d / "a.xml").write_text(XML.format(OBJECT.format("dog") + OBJECT.format("person") + OBJECT.format("dog")))
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        tar.add(d / "a.xml", "x/a.xml")
    for got in (readers.read_annotations(spark, str(d)), readers.read_annotation_archive(spark, str(tmp_path / "x.tar"))):
        assert sorted((r.image_id, r.class_name, r.ordinal, r.width) for r in got.collect()) == [("a", "dog", 0, 200), ("a", "dog", 1, 200), ("a", "person", 0, 200)]
        assert {tuple(r) for r in readers.annotation_counts(got, ["dog"]).collect()} == {("a", "dog", 2)}


def test_lists_results_and_arms(spark, tmp_path):
    (tmp_path / "l.txt").write_text("b\n\n a \nb\n")
    assert sorted(map(tuple, readers.read_list(spark, str(tmp_path / "l.txt")).collect())) == [("a", 2), ("b", 0)]
    (tmp_path / "results_x.csv").write_text("task,ap,name\nt1,1.5,u\nt2,—,v\n")
    (tmp_path / "results_y.csv").write_text("task,n\nt1,3\n")
    d = readers.read_arms(spark, str(tmp_path))
    assert {(r.arm, r.task, r.ap, r.n) for r in d.collect()} == {("x", "t1", 1.5, None), ("x", "t2", None, None), ("y", "t1", None, 3)}


def test_metrics_logs_and_detections(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"coco_eval_bbox": [0.0, 0.0] + [float(i) for i in range(80)] + [9.5]}))
    got = {r.class_name: r.ap50 for r in readers.read_metrics(spark, str(tmp_path / "m.json"), [f"c{i}" for i in range(80)]).collect()}
    assert got["c0"] == 0.0 and got["c79"] == 79.0 and got["unknown"] == 9.5
    (tmp_path / "log.txt").write_text("U_Recall: np.float64(3.5)\nWI = tensor(0.25)\nU_Recall: 4\n")
    assert tuple(readers.parse_log(spark, str(tmp_path / "log.txt"), {"u": "U_Recall", "wi": "WI", "none": "X"}).first()) == (4.0, 0.25, None)
    art = {"schema": "detections_v1", "unknown_class_name": "unknown", "ground_truth": [{"image_id": "i", "class_name": "c", "box": [0, 0, 1, 1]}], "detections": [{"image_id": "i", "class_name": "unknown", "score": 0.5, "box": [0, 0, 1, 1]}]}
    (tmp_path / "d.json").write_text(json.dumps(art))
    truth, found = readers.read_detections(spark, str(tmp_path / "d.json"), "detections_v1")
    assert truth.first().box.x2 == 1.0 and found.first().score == 0.5


def test_pool(spark, tmp_path):
    np.savez(tmp_path / "p.npz", split=np.array(["pool", "eval"]), embedding=np.array([[3, 4], [1, 0]], np.float16), posterior_q=np.array([[100, 100], [255, 0]], np.int64))
    readers.pool_to_parquet(spark, str(tmp_path / "p.npz"), str(tmp_path / "p"))
    r = readers.read_pool(spark, str(tmp_path / "p"), split="pool").first()
    assert np.allclose(r.embedding, [0.6, 0.8]) and np.allclose(r.posterior, [0.5, 0.5])
    with pytest.raises(ValueError):
        readers.read_pool(spark, str(tmp_path / "p"), split="none")


def test_writers(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 0.5)], "x int, y double"), spark.createDataFrame([(2, None)], "x int, z string")
    writers.write_csv([a, b], str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {("1", "0.5", None), ("2", None, None)}
    assert writers.to_markdown(a) == "| x | y |\n| --- | --- |\n| 1 | 0.50 |\n" and "1 & 0.50" in writers.to_latex(a)
    assert writers.to_text(a) == "x  y\n1  0.50\n"
    with pytest.raises(ValueError):
        writers.to_markdown(spark.range(3), limit=2)
    assert writers.check_split_name("voc_ft_3", "ft") == "voc_ft_3" and writers.check_split_name("shared_test") == "shared_test"
    for wrong in ("train_test", "shared_eval", "shared_val", "plain"):
        with pytest.raises(ValueError):
            writers.check_split_name(wrong)


def test_json_once_and_compressed(tmp_path):
    path = str(tmp_path / "a.json")
    digest = writers.write_once({"b": 1, "a": [2]}, path)
    assert writers.write_once({"a": [2], "b": 1}, path) == digest
    with pytest.raises(ValueError):
        writers.write_once({"a": 3}, path)
    first = writers.write_compressed({"b": 1, "a": [2]}, str(tmp_path / "a.gz"))
    assert first == digest and writers.read_compressed(str(tmp_path / "a.gz"), digest) == {"a": [2], "b": 1}
    with pytest.raises(ValueError):
        writers.read_compressed(str(tmp_path / "a.gz"), "0")


def test_stream_of_answers(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    d.write.parquet(str(tmp_path / "in"))
    s = answers_by_window(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), every="1 day")
    q = s.writeStream.outputMode("complete").format("memory").queryName("answers").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(answers) FROM answers").first()[0] == d.count()


def test_run_scan_and_refusals(spark, tmp_path):
    for run, rows in (("random__none", "task,ap\nt2,1.5\nt3,2\n"), ("random__uniform", "task,ap,n\nt2,1.25,3\n")):
        (tmp_path / run / "t2_random").mkdir(parents=True)
        (tmp_path / run / "results_x.csv").write_text(rows)
    (tmp_path / "random__none" / "t2_random" / "metrics.json").write_text(json.dumps({"coco_eval_bbox": [0.0, 0.0] + [float(i) for i in range(80)] + [9.5]}))
    rows, values = readers.read_runs(spark, str(tmp_path), ["a", "b"])
    assert {(r.run, r.task, r.ap, r.n) for r in rows.collect()} == {("random__none", "t2", 1.5, None), ("random__none", "t3", 2.0, None), ("random__uniform", "t2", 1.25, 3)}
    assert {(r.run, r.task, r.class_name, r.ap50) for r in values.collect()} == {("random__none", "t2", "a", 0.0), ("random__none", "t2", "b", 1.0), ("random__none", "t2", "unknown", 9.5)}
    assert readers.read_runs(spark, str(tmp_path), ["a"], include=["random__uniform"])[0].count() == 1
    (tmp_path / "t.csv").write_text("arm,task,status\na,1,complete\na,1,complete\n")
    with pytest.raises(ValueError):
        readers.read_trajectory(spark, str(tmp_path / "t.csv"), ["arm", "task"])
    (tmp_path / "g.csv").write_text("class_name,grp,n\na,head,1\na,tail,2\n")
    with pytest.raises(ValueError):
        readers.read_groups(spark, str(tmp_path / "g.csv"))
