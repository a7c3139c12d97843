"""Archives of vectors and of annotations."""

import os
import tarfile

import numpy as np
import pytest
from acquira.sources import archives, readers
from pyspark.sql import functions as F


def test_vectors_there_and_back(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(10, 4)).astype(np.float16)
    df = spark.createDataFrame([(i, f"é{i}", [float(v) for v in r], i % 2 == 0) for i, r in enumerate(x)], "key long, name string, embedding array<float>, odd boolean")
    archives.write_vectors(df.repartition(3), str(tmp_path / "a"), half=("embedding",), version="v2")
    files = [f for f in os.listdir(tmp_path / "a")]
    assert 1 <= len(files) <= 3 and all(f.endswith(".npz") for f in files)
    with np.load(tmp_path / "a" / files[0]) as z:
        assert z["embedding"].dtype == np.float16 and str(z["version"]) == "v2" and z["name"].dtype.kind == "U"
    back = archives.read_vectors(spark, str(tmp_path / "a"), version="v2", rows_per_task=3)
    assert back.rdd.getNumPartitions() >= 4  # ranges of rows, not archives
    assert sorted((r.key, r.name, tuple(r.embedding), r.odd) for r in back.collect()) == [(i, f"é{i}", tuple(x[i].astype(float).tolist()), i % 2 == 0) for i in range(10)]
    with pytest.raises(Exception, match="has version v2, not v1"):
        archives.read_vectors(spark, str(tmp_path / "a"), version="v1").collect()
    archives.write_vectors(df.where("key < 2"), str(tmp_path / "a"), mode="overwrite")
    assert archives.read_vectors(spark, str(tmp_path / "a")).count() == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(i, None if i == 7 else [1.0, 2.0]) for i in range(8)], "key long, embedding array<double>").repartition(4)
    with pytest.raises(Exception, match="without a value"):
        archives.write_vectors(bad, str(tmp_path / "b"))
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "key long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        archives.write_vectors(ragged, str(tmp_path / "b"))
    assert not [f for _, _, fs in os.walk(tmp_path / "b") for f in fs] and not [d for d in os.listdir(tmp_path) if d.startswith("_")]


def test_archives_written_by_others(spark, tmp_path):
    np.savez_compressed(tmp_path / "p.npz", split=np.array(["pool", "eval", "pool"]), grid=np.arange(12, dtype=np.int32).reshape(3, 2, 2), short=np.array([1]), version=np.array("x"))
    got = archives.read_vectors(spark, str(tmp_path / "p.npz"), version="x")
    assert sorted(got.columns) == ["grid", "row", "split"]
    assert sorted((r.row, r.split, r.grid) for r in got.collect()) == [(0, "pool", [0, 1, 2, 3]), (1, "eval", [4, 5, 6, 7]), (2, "pool", [8, 9, 10, 11])]
    assert got.where("split = 'pool'").count() == 2


def test_one_tar_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "TAR_BYTES", 4096)
    one = "<annotation><size><width>9</width><height>9</height><depth>3</depth></size>{}</annotation>"
    box = "<object><name>dog</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object>"
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for i in range(40):
            data = one.format(box * (i % 5 + 1)).encode()
            info = tarfile.TarInfo(f"d/{'long/' * (30 if i % 7 == 0 else 0)}i{i}.xml")
            info.size = len(data)
            (tmp_path / "m").write_bytes(data)
            tar.add(tmp_path / "m", info.name)
        tar.add(tmp_path / "m", "d/readme.txt")
    index = archives.tar_index(spark, str(tmp_path / "x.tar"), ".xml")
    assert index.count() == 40
    spread = archives.tar_members(index).select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 3
    objects = readers.read_annotation_archive(spark, str(tmp_path / "x.tar"))
    classes = readers.image_classes(objects, total=sum(i % 5 + 1 for i in range(40)))
    assert {r.image_id for r in classes.collect()} == {f"i{i}" for i in range(40)}
    with pytest.raises(ValueError, match="objects"):
        readers.image_classes(objects, total=7)
