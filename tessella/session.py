"""Session helpers: table access and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share. It is the session's ``spark.checkpoint.dir``; only where that is unset
    (local tests) a temporary folder is made, once per session. On a cluster without the setting this is an error, as
    a folder of one machine would not do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in files of the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of the shared folder that nothing has yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a compressed columnar table of the shared folder and read it back. Smaller on disk than
    ``cut`` for wide rows, and column pruning still applies to later reads. The table stays until ``discard``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete the tables ``written`` in this process and return their number. Results that still read from them are
    void, so it is called once those are saved."""
    conf = spark._jsc.hadoopConfiguration()
    n = 0
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n
