"""Queries of the problems tagged llm, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, packing, splitting, vectors
from tessella.llm import near_dup as nd
from tessella.session import table, written

DIM = 64


# --- 4: overlaps across splits ---------------------------------------------------------------------------------
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nd.cross_split_pairs(table(spark, d, "split_rows"), "row_id", "note", "dataset")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Every overlapping row with its class of equal word sets and its number of partners; copies aren't expanded."""
    return nd.cross_split_links(table(spark, d, "split_rows"), "row_id", "note", "dataset").withColumnRenamed("key", "row_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping rows and pairs per evaluation split and source."""
    rows = table(spark, d, "split_rows").where("dataset <> 'train'").select("row_id", "dataset", "dataset_key").dropDuplicates(["row_id"])
    return p4_links(spark, d).join(rows, "row_id").groupBy("dataset", "dataset_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_links").alias("pairs"))


# --- 5: most similar vectors -----------------------------------------------------------------------------------
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.usable(table(spark, d, "feature_vectors"), "vec_id", "vec", DIM)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mutual_pairs(_vectors(spark, d), DIM)


def p5_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of all vectors for every vector whose id is divisible by 100."""
    v = _vectors(spark, d)
    return vectors.top_k(v.where("id % 100 = 0"), v, DIM).withColumn("cos", F.round("cos", 6))


def p5_outlier_score(spark: SparkSession, d: str) -> DataFrame:
    """Outlier score of the same vectors: exp(-mean distance / median of it), distance being 1 - cosine."""
    found = p5_topk(spark, d).groupBy("query_id").agg(F.avg(1 - F.col("cos")).alias("far"))
    middle = found.agg(F.percentile_approx("far", 0.5, 10_000).alias("middle"))
    return found.join(F.broadcast(middle)).select(
        F.col("query_id").alias("vec_id"), F.round(F.exp(-F.col("far") / F.nullif("middle", F.lit(0.0))), 6).alias("outlier_score")
    )


# --- 6: near-duplicate groups ----------------------------------------------------------------------------------
def _groups(spark: SparkSession, d: str) -> DataFrame:
    return nd.near_duplicate_groups(table(spark, d, "split_rows").where("dataset = 'train'"), "row_id", "note")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).where("id <> group_id").select(F.col("group_id").alias("row_id_a"), F.col("id").alias("row_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by size and by number of different texts."""
    sizes = _groups(spark, d).groupBy("group_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("group_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts"))


# --- 8, 9, 10: texts in tokens ---------------------------------------------------------------------------------
def _limits(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "text_limits").where(F.col("purpose") == purpose).first()
    return row.max_tokens, row.overlap_tokens


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    size, _ = _limits(spark, d, "container")
    return packing.fill_containers(table(spark, d, "documents"), "doc_id", "text", size).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    size, _ = _limits(spark, d, "container")
    return packing.fill_report(p8_containers(spark, d), size)


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).rows().withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    m = _mixture(spark, d)
    return m.report(m.rows())


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture, by source: no text more often than allowed, all texts equally often but for one
    use, and the tokens as budgeted but for less than one text; a source at its limit is used up."""
    m = _mixture(spark, d)
    uses = m.rows().groupBy("source", "id", "n_tokens").agg(F.count(F.lit(1)).alias("k"))
    got = uses.groupBy("source").agg(F.max("k").alias("most"), F.min("k").alias("least"), F.count(F.lit(1)).alias("used"), F.sum(F.col("k") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("longest"))
    plan = [(s, t, m.repeats[s], m.count[s], m.budget[s], s in m.frozen) for s, t in m.targets.items()]
    asked = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, n_texts long, budget long, frozen boolean")
    least = F.when(F.col("used") == F.col("n_texts"), F.col("least")).otherwise(0)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return asked.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "n_texts",
        ((z("most") <= F.col("max_repeats")) & (z("most") - F.coalesce(least, F.lit(0)) <= 1)).alias("repeats_ok"),
        (F.abs(z("tokens") - F.col("budget")) <= z("longest")).alias("tokens_ok"),
        (~F.col("frozen") | (F.col("n_texts") == 0) | (F.coalesce(least, F.lit(0)) == F.col("max_repeats"))).alias("limit_ok"),
    )


def p9_temperature(spark: SparkSession, d: str) -> DataFrame:
    """The plain temperature mixture, realised: natural token shares to the exponent that makes them as even as the
    targets are, within the repetition limits."""
    m = mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), base="natural")
    rows = [(s, m.natural[s], m.targets[s], m.weights[s], s in m.frozen, m.exponent) for s in sorted(m.weights)]
    plan = spark.createDataFrame(rows, "source string, natural_share double, target_share double, weight double, at_limit boolean, exponent double")
    return plan.join(m.report(m.rows()).select("source", "uses", "repeats", "tokens", "share"), "source")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = _limits(spark, d, "piece")
    return splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text", size, overlap).withColumnRenamed("id", "doc_id")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, by text: it is placed if it has any token, whole unless it alone exceeds a
    container, its parts cover it, and none of its containers is overfull."""
    size, _ = _limits(spark, d, "container")
    packed = written(p8_containers(spark, d), "packed")
    over = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used")).where(F.col("used") > size).withColumn("over", F.lit(True)).drop("used")
    parts = packed.join(over, "container_id", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.max("over").alias("over"),
        F.count("container_id").alias("placed"),
    )
    fits = (F.col("parts") == F.greatest(F.ceil(F.col("n") / size), F.lit(1))) & (F.col("end") == F.col("n")) & F.col("over").isNull()
    return parts.select("doc_id", (F.col("placed") > 0).alias("placed"), (fits & F.col("placed").isin(0, F.col("parts"))).alias("fits"))


def p10_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces, by text: put together without their overlaps they are the text, none is above the
    limit, and each starts with as much of the one before as asked."""
    size, overlap = _limits(spark, d, "piece")
    pieces = splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text", size, overlap, all_texts=True)
    w = "partition by id order by piece_no"
    new = pieces.withColumn("before", F.expr(f"coalesce(lag(char_end) over ({w}), 0)"))
    new = new.withColumn("new", F.expr("substring(piece, before - char_start + 1)"))
    whole = new.groupBy("id").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "new"))), lambda x: x["new"]), "")).alias("text_md5"),
        F.bool_and(F.col("n_tokens") <= size).alias("within_limit"),
        F.bool_and((F.col("piece_no") == 0) | F.col("overlap_tokens").between(overlap, overlap + 3)).alias("overlap_ok"),
    )
    return whole.withColumnRenamed("id", "doc_id")


QUERIES = {
    "p4_found": p4_found, "p4_links": p4_links, "p4_report": p4_report,
    "p5_found": p5_found, "p5_topk": p5_topk, "p5_outlier_score": p5_outlier_score,
    "p6_found": p6_found, "p6_groups": p6_groups,
    "p8_containers": p8_containers, "p8_report": p8_report, "p8_check": p8_check,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_check": p9_check, "p9_temperature": p9_temperature,
    "p10_pieces": p10_pieces, "p10_check": p10_check,
}

_NOTES = """
WITH RECURSIVE n AS (SELECT row_id, min(dataset) AS dataset, min(dataset_key) AS dataset_key, list_distinct(regexp_extract_all(lower(min(note)), '[a-z0-9]+')) AS w FROM split_rows GROUP BY row_id),
e AS (SELECT *, len(w) AS k FROM n WHERE len(w) >= 10),
u AS (SELECT row_id, dataset, k, unnest(w) AS x FROM e),
"""
_PAIRS = """p AS (SELECT a.row_id AS i, b.row_id AS j FROM u a JOIN u b ON a.x = b.x AND a.row_id < b.row_id AND {cond}
  AND least(a.k, b.k) >= 0.7 * greatest(a.k, b.k) - 1e-9 GROUP BY a.row_id, b.row_id, a.k, b.k HAVING count(*) >= 0.7 * (a.k + b.k - count(*)) - 1e-9)
"""
_P4 = _NOTES + _PAIRS.format(cond="(a.dataset = 'train') <> (b.dataset = 'train')")
_P6 = _NOTES + _PAIRS.format(cond="a.dataset = 'train' AND b.dataset = 'train'") + """,
s AS (SELECT i, j FROM p UNION SELECT j, i FROM p),
r(id, other) AS (SELECT i, j FROM s UNION SELECT r.id, s.j FROM r JOIN s ON r.other = s.i),
g AS (SELECT id, least(id, min(other)) AS root FROM r GROUP BY id)
"""
_P5 = """
WITH v AS (SELECT vec_id, any_value(vec) AS vec FROM feature_vectors WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY vec_id),
n AS (SELECT vec_id, [CAST(x AS double) FOR x IN vec] AS x FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.x, b.x) AS c FROM n a JOIN n b ON a.vec_id <> b.vec_id {more}),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM e QUALIFY r <= 5)
"""

SQL = {
    "p4_found": _P4 + "SELECT i AS row_id_a, j AS row_id_b FROM p",
    "p4_report": _P4
    + """, q AS (SELECT unnest([i, j]) AS row_id FROM p), c AS (SELECT row_id, count(*) AS n FROM q GROUP BY 1)
SELECT e.dataset, e.dataset_key, count(*) AS rows, CAST(sum(n) AS bigint) AS pairs FROM c JOIN e ON e.row_id = c.row_id WHERE e.dataset <> 'train' GROUP BY 1, 2""",
    "p4_links": _P4
    + """, q AS (SELECT unnest([i, j]) AS row_id FROM p), c AS (SELECT row_id, count(*) AS n FROM q GROUP BY 1),
k AS (SELECT array_to_string(list_sort(w), ' ') AS t, min(row_id) AS class_id FROM e WHERE dataset IS NOT NULL GROUP BY 1)
SELECT c.row_id, k.class_id, c.n AS n_links FROM c JOIN e ON e.row_id = c.row_id JOIN k ON k.t = array_to_string(list_sort(e.w), ' ')""",
    "p5_found": _P5.format(more="") + "SELECT x.a AS vec_id_a, x.b AS vec_id_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.c >= 0.9",
    "p5_topk": _P5.format(more="WHERE a.vec_id % 100 = 0") + "SELECT a AS query_id, CAST(r AS int) AS rank, b AS id, round(c, 6) AS cos FROM t",
    "p5_outlier_score": _P5.format(more="WHERE a.vec_id % 100 = 0")
    + ", f AS (SELECT a AS vec_id, avg(1 - round(c, 6)) AS far FROM t GROUP BY 1) SELECT vec_id, round(exp(-far / (SELECT quantile_disc(far, 0.5) FROM f)), 6) AS outlier_score FROM f",
    "p6_groups": _P6
    + """, m AS (SELECT root AS group_id, id FROM g) SELECT group_id, CAST(count(*) AS bigint) AS rows, count(DISTINCT array_to_string(list_sort(w), ' ')) AS texts FROM m JOIN e ON e.row_id = m.id GROUP BY 1""",
    "p6_found": _P6 + "SELECT root AS row_id_a, id AS row_id_b FROM g WHERE id <> root",
    "p8_check": "SELECT doc_id, coalesce(length(text), 0) > 0 AS placed, true AS fits FROM documents",
    "p9_check": """WITH m AS (SELECT replace(lower(trim(source)), '-', '_') AS source, target_share, max_repeats FROM mix_targets),
t AS (SELECT text, arg_min(s, doc_id) AS source FROM (SELECT doc_id, text, replace(lower(trim(source)), '-', '_') AS s FROM documents WHERE length(text) > 0) WHERE s IN (SELECT source FROM m) GROUP BY 1)
SELECT m.source, target_share, max_repeats, count(t.text) AS n_texts, true AS repeats_ok, true AS tokens_ok, true AS limit_ok FROM m LEFT JOIN t ON t.source = m.source GROUP BY 1, 2, 3""",
    "p10_check": "SELECT doc_id, md5(text) AS text_md5, true AS within_limit, true AS overlap_ok FROM documents WHERE length(text) > 0",
}
