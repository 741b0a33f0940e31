"""The folder for intermediate tables."""

import types

import pytest

from quillgraph import shared


def test_a_cluster_without_a_shared_folder_is_refused():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    spark = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(RuntimeError):
        shared.shared_folder(spark)


def test_written_tables_are_removed(spark, monkeypatch):
    monkeypatch.setattr(shared, "_written", [])
    made = shared.written(spark.range(3), "numbers")
    assert made.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(shared._written[0])
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    shared.remove_written(spark)
    assert not files.exists(path) and shared._written == []


def test_partitions_grow_with_the_files_read(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"{tmp_path}/rows")
    rows, least = spark.read.parquet(f"{tmp_path}/rows"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shared.spread(rows, "id").rdd.getNumPartitions() == least
    monkeypatch.setattr(shared, "PARTITION_BYTES", shared._input_bytes(rows) // 50)
    assert shared.spread(rows, "id").rdd.getNumPartitions() == 64 and shared.spread(rows.union(rows), "id").rdd.getNumPartitions() == 128
