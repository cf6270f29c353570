"""Exact nearest neighbours of a query set in blocks.

Every query meets every row, so the work is queries x rows: a query set of a fixed share of the rows, or a whole table of
moderate size. Rows are cut into blocks by a hash of their id and queries are repeated once per block; a task scores one
block against one chunk of queries with matrix products and keeps the k best, and the partial lists are merged. Nothing
is broadcast and no pair is emitted that isn't in a partial list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, CHUNK = 50_000, 20_000


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.array(col.to_pylist(), dtype=np.float64)


def knn_edges(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int = 10, metric: str = "euclidean") -> DataFrame:
    """(src_id, dst_id, rank, dist): the ``k`` nearest rows of each query, itself left out, ties by id.

    Rows whose vector is null, holds null or NaN, or differs in length from the first usable one take no part; for
    cosine neither do zero vectors."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    schema = "src_id bigint, dst_id bigint, dist double"

    def clean(df):
        v = F.col(f"`{vec_col}`").cast("array<double>")
        ok = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
        if metric == "cosine":
            ok = ok & F.exists(v, lambda x: x != 0)
        return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("vec")).where(ok & F.col("id").isNotNull())

    data = clean(rows)
    first = data.agg(F.count(F.lit(1)).alias("n"), F.mode(F.size("vec")).alias("dim")).first()
    if not first.n:
        return rows.sparkSession.createDataFrame([], "src_id bigint, dst_id bigint, rank int, dist double")
    blocks = max(1, -(-first.n // BLOCK))
    data, asks = data.where(F.size("vec") == first.dim), clean(queries).where(F.size("vec") == first.dim)
    chunks = max(1, -(-asks.count() // CHUNK))
    held = data.select("id", "vec", F.lit(0).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("bigint").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = asks.select(
        "id", "vec", F.lit(1).alias("asks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(chunks)).cast("int").alias("chunk")
    )

    def meet(t: pa.Table) -> pa.Table:
        side = t.column("asks").to_numpy()
        ids, x = t.column("id").to_numpy(), _matrix(t.column("vec"))
        if metric == "cosine" and len(x):
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        h = np.flatnonzero(side == 0)
        h = h[np.argsort(ids[h], kind="stable")]
        out = []
        for s in range(0, int((side == 1).sum()), 1024):
            a = np.flatnonzero(side == 1)[s : s + 1024]
            if metric == "cosine":
                d = 1 - x[a] @ x[h].T
            else:
                d = (x[a] ** 2).sum(1)[:, None] - 2 * x[a] @ x[h].T + (x[h] ** 2).sum(1)[None, :]
            d[ids[a][:, None] == ids[h][None, :]] = np.inf
            near = min(len(h), k + 8)
            if near == 0:
                continue
            best = np.sort(np.argpartition(d, near - 1, axis=1)[:, :near], axis=1)
            # anew without cancellation
            exact = np.sqrt(((x[a][:, None, :] - x[h[best]]) ** 2).sum(2)) if metric == "euclidean" else np.take_along_axis(d, best, 1)
            exact[ids[a][:, None] == ids[h[best]]] = np.inf
            order = np.argsort(exact, axis=1, kind="stable")[:, :k]
            dist, best = np.take_along_axis(exact, order, 1), np.take_along_axis(best, order, 1)
            at = np.nonzero(np.isfinite(dist))
            out.append((ids[a][at[0]], ids[h[best[at]]], dist[at]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.array([], np.int64), np.array([], np.int64), np.array([]))
        return pa.table({"src_id": pa.array(a, pa.int64()), "dst_id": pa.array(b, pa.int64()), "dist": pa.array(c, pa.float64())})

    part = held.unionByName(asked).groupBy("block", "chunk").applyInArrow(meet, schema)
    rank = F.expr("row_number() over (partition by src_id order by dist, dst_id)").cast("int")
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("src_id", "dst_id", "rank", "dist")
