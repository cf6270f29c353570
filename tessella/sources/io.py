"""Reading and writing datasets and results."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.prep import Dataset, align, check_target, drop_zero_columns, merge_splits

READERS = (".csv", ".parquet", ".feather")
SNIFFED = 100_000  # bytes an encoding is guessed from


def _path(spark: SparkSession, path: str):
    """Path and file system: local, shared or an object store, as the session is configured."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _path(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file; None if there is none."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 if the head of the file decodes as such, utf-16 by its mark, else iso-8859-1. Of a folder its first file
    counts."""
    jvm = spark._jvm
    at, fs = _path(spark, path)
    if fs.getFileStatus(at).isDirectory():
        inside = sorted((f.getPath() for f in fs.listStatus(at) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda p: p.getName())
        if not inside:
            return "utf-8"
        at = inside[0]
    stream = fs.open(at)
    try:
        head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, SNIFFED)))
    finally:
        stream.close()
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if len(head) < SNIFFED or e.start < len(head) - 3:  # else the last character was cut
            return "iso-8859-1"
    return "utf-8"


def load_file(spark: SparkSession, path: str, *, multiline: bool = True, schema: str | None = None) -> DataFrame:
    """One csv, parquet or feather file by its suffix; others are an error. Quoted fields of a csv may hold line breaks,
    so it is one task's work; ``multiline=False`` says that none does, and large files are then read in splits. A
    ``schema`` saves the scan that infers one. A feather file is read on the driver: it is meant for small tables."""
    suffix = Path(path).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None, encoding=sniff_encoding(spark, path), multiLine=multiline, escape='"')
    if suffix == ".feather":
        from pyarrow import feather

        return spark.createDataFrame(feather.read_table(path.removeprefix("file:")))
    raise ValueError(f"unknown file type {path}")


def load_files(spark: SparkSession, paths: str | list[str], **how) -> DataFrame | None:
    """Files of known type as one frame; others are skipped. Different column sets are an error; None without files."""
    paths = [paths] if isinstance(paths, str) else paths
    parts = [load_file(spark, p, **how) for p in paths if Path(p).suffix.lower() in READERS]
    if not parts:
        return None
    if any(set(p.columns) != set(parts[0].columns) for p in parts):
        raise ValueError("the files have different columns")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_splits(splits: dict[str, DataFrame | None], path: str, split: str = "dataset") -> None:
    """One table partitioned by split, so that reading a split reads only its files."""
    merge_splits(splits, split).write.mode("overwrite").partitionBy(split).parquet(path)


def load_splits(spark: SparkSession, path: str, split: str = "dataset") -> dict[str, DataFrame | None]:
    df = spark.read.parquet(path)
    held = {r[0] for r in df.select(split).distinct().collect()}  # split names
    return {n: df.where(F.col(split) == n).drop(split) if n in held else None for n in ("train", "val", "test")}


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """Side text without characters beyond the basic plane."""
    write_text(spark, path, re.sub(r"[^\u0000-￿]", "", text))


load_text = read_text


def folder_source(root: str) -> Callable[[SparkSession, str], dict[str, DataFrame]]:
    """Adapter of a hub whose datasets were fetched into folders of ``root``: files by ``splits.json`` if there is one,
    else every file whose name starts with a split's, else all files as train."""

    def read(spark: SparkSession, name: str) -> dict[str, DataFrame]:
        folder = f"{root.rstrip('/')}/{name}"
        held = manifest_splits(spark, folder)
        if held is None:
            at, fs = _path(spark, folder)
            files = sorted(f.getPath().toString() for f in fs.listStatus(at) if Path(f.getPath().getName()).suffix.lower() in READERS)
            named = {s: [f for f in files if Path(f).name.lower().startswith(s)] for s in ("train", "val", "test")}
            held = {s: f for s, f in named.items() if f} or {"train": files}
        return {s: d for s, f in held.items() if (d := load_files(spark, f)) is not None}

    return read


ADAPTERS: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}


def register_source(scheme: str, adapter: Callable[[SparkSession, str], dict[str, DataFrame]]) -> None:
    """Hub sources plug in by scheme: the adapter gets what follows ``scheme://`` and returns splits by name."""
    ADAPTERS[scheme] = adapter


def load_dataset(
    spark: SparkSession, link: str | dict[str, str | list[str]], target: str, *, key: str | None = None, sensitive: tuple[str, ...] = (),
    interest: tuple[str, ...] = (), title: str | None = None, description: str | None = None, seed: int = 42,
) -> Dataset:
    """A dataset from a registered source, a saved folder, or files by split. Columns the splits don't share and columns
    that hold only 0 or null are dropped; the target must be there."""
    if isinstance(link, dict):
        splits = {n: load_files(spark, p) for n, p in link.items()}
    elif (m := re.match(r"(\w+)://(.*)", link)) and m[1] in ADAPTERS:
        splits = ADAPTERS[m[1]](spark, m[2])
    else:
        splits = load_splits(spark, link)
    splits = align({n: d for n, d in splits.items() if d is not None})
    for d in splits.values():
        check_target(d, target)
    df = drop_zero_columns(merge_splits(splits), keep=(target, "dataset"))
    if key is None:
        from tessella.session import cut

        key, df = "row_id", cut(df.withColumn("row_id", F.monotonically_increasing_id()))  # fixed from here on
    path = link if isinstance(link, str) else None
    return Dataset(df, target, "dataset", key, sensitive, interest, title, description, seed, path)


def manifest_splits(spark: SparkSession, folder: str) -> dict[str, list[str]] | None:
    """``splits.json`` of a folder: which files are train, val and test; None if there is none."""
    text = read_text(spark, f"{folder}/splits.json")
    return None if text is None else {n: [f"{folder}/{f}" for f in ([fs] if isinstance(fs, str) else fs)] for n, fs in json.loads(text).items()}


def save_results(tables: dict[str, DataFrame], scalars: dict, path: str) -> None:
    """Result tables as parquet, the rest as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_text(SparkSession.active(), f"{path}/scalars.json", json.dumps({"tables": {n: d.schema.simpleString() for n, d in tables.items()}, "scalars": scalars}))


def load_results(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Results back, their schemas checked."""
    text = read_text(spark, f"{path}/scalars.json")
    if text is None:
        raise ValueError(f"no results in {path}")
    held = json.loads(text)
    tables = {}
    for name, schema in held["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.schema.simpleString() != schema:
            raise ValueError(f"table {name} has another schema than it was saved with")
        tables[name] = df
    return tables, held["scalars"]
