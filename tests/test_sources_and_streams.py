import json

import pyarrow as pa
import pyarrow.feather
import pytest

from tessella.sources import io
from tessella.streaming import incremental


def test_files_and_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,t\n1,été\n2,b\n", encoding="utf-8")
    (tmp_path / "l.csv").write_bytes("x,t\n3,été\n".encode("latin-1"))
    pa.feather.write_feather(pa.table({"x": [4], "t": ["f"]}), str(tmp_path / "f.feather"))
    spark.createDataFrame([(5, "p")], "x int, t string").write.parquet(str(tmp_path / "p.parquet"))
    paths = [str(tmp_path / n) for n in ("a.csv", "l.csv", "f.feather", "p.parquet", "readme.md")]
    df = io.load_files(spark, paths)
    assert sorted((r.x, r.t) for r in df.collect()) == [(1, "été"), (2, "b"), (3, "été"), (4, "f"), (5, "p")]
    assert io.load_files(spark, str(tmp_path / "none.txt")) is None
    with pytest.raises(ValueError):
        io.load_file(spark, "x.txt")
    other = spark.createDataFrame([(1,)], "y int")
    other.write.parquet(str(tmp_path / "o.parquet"))
    with pytest.raises(ValueError):
        io.load_files(spark, [paths[0], str(tmp_path / "o.parquet")])
    io.save_splits({"train": df, "test": df.limit(1), "val": None}, str(tmp_path / "saved"))
    back = io.load_splits(spark, str(tmp_path / "saved"))
    assert back["train"].count() == 5 and back["test"].count() == 1 and back["val"] is None


def test_dataset_and_results(spark, tmp_path):
    a = spark.createDataFrame([(1, 0, 2, "u"), (2, 0, 3, "v")], "a int, z int, only int, t string")
    b = spark.createDataFrame([(3, 0, "w")], "a int, z int, t string")
    io.register_source("mem", lambda s, rest: {"train": a, "test": b})
    ds = io.load_dataset(spark, "mem://anything", "t", sensitive=("a",))
    assert set(ds.df.columns) == {"a", "t", "dataset", "row_id"} and ds.part("test").count() == 1
    with pytest.raises(ValueError):
        io.load_dataset(spark, "mem://anything", "absent")
    io.save_results({"x": ds.df}, {"n": 3}, str(tmp_path / "res"))
    tables, scalars = io.load_results(spark, str(tmp_path / "res"))
    assert tables["x"].count() == 3 and scalars == {"n": 3}
    (tmp_path / "splits.json").write_text(json.dumps({"train": "a.csv", "test": ["b.csv"]}))
    assert io.manifest_splits(spark, str(tmp_path))["train"] == [str(tmp_path / "a.csv")]
    io.save_text(spark, str(tmp_path / "d.txt"), "a🎉b")
    assert io.load_text(spark, str(tmp_path / "d.txt")) == "ab" and io.load_text(spark, str(tmp_path / "no.txt")) is None


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(300).selectExpr("timestamp_seconds(1700000000 + id * 60) as ts", "cast(id % 2 as string) as kind", "if(id % 10 = 0, double('nan'), cast(id as double)) as v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_profile(stream, "ts", "kind", "v").writeStream.format("memory").queryName("prof").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    plain = lambda d: sorted((r.window_start, r.group, r.n, r.null_count, round(r.mean, 9), round(r.std, 9), r.min, r.max) for r in d.collect())
    assert plain(spark.table("prof")) == plain(incremental.windowed_profile(df, "ts", "kind", "v"))


def test_folder_source_and_split_reading(spark, tmp_path):
    """A fetched dataset by its manifest, by the names of its files, or as train; lines without breaks in splits."""
    one, two = tmp_path / "hub" / "one", tmp_path / "hub" / "two"
    for folder in (one, two):
        folder.mkdir(parents=True)
        (folder / "train_0.csv").write_text("row_id,x,label\n1,2.5,a\n2,3.5,b\n")
        (folder / "test_0.csv").write_text("row_id,x,label\n3,4.5,a\n")
    (one / "splits.json").write_text('{"train": ["train_0.csv", "test_0.csv"]}')
    io.register_source("hub", io.folder_source(str(tmp_path / "hub")))
    ds = io.load_dataset(spark, "hub://one", "label", key="row_id")
    assert {r.dataset for r in ds.df.collect()} == {"train"} and ds.df.count() == 3
    ds = io.load_dataset(spark, "hub://two", "label", key="row_id")
    assert {(r.row_id, r.dataset) for r in ds.df.collect()} == {(1, "train"), (2, "train"), (3, "test")}
    df = io.load_file(spark, str(one / "train_0.csv"), multiline=False, schema="row_id bigint, x double, label string")
    assert [r.x for r in df.collect()] == [2.5, 3.5]
    assert io.load_file(spark, str(one).replace("one", "two") + "/train_0.csv").count() == 2
