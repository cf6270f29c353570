"""Queries of the general training-data problems, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import mixture_impute as mi
from tessella.operators import parsing
from tessella.operators import quality_profile as qp
from tessella.operators import schema_drift as sd
from tessella.session import cut, table, written


# --- 1: rows that fail to parse ------------------------------------------------------------------------------------
def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_records(table(spark, d, "raw_lines"), "raw_line", parsing.TRAIN_EXPORT)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rejected_records(_parsed(spark, d), "line_id").select("line_id", "reason")


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    return parsing.valid_records(_parsed(spark, d), "line_id")


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    """Located errors, and how many records were recovered behind them."""
    return parsing.rejected_records(_parsed(spark, d), "line_id")


def p1_located(spark: SparkSession, d: str) -> DataFrame:
    """Whether each error names a place within its record."""
    lines = table(spark, d, "raw_lines").select("line_id", F.length("raw_line").alias("n"))
    found = p1_errors(spark, d).join(lines, "line_id")
    return found.select("line_id", "reason", (F.col("pos").between(0, F.greatest("n", F.lit(0))) & F.col("message").isNotNull()).alias("located"))


def p1_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Typed records that were found again at anchors behind a broken quote."""
    broken = _parsed(spark, d).where("parsed.reason = 'quoting'")
    return broken.select("line_id", F.posexplode("parsed.recovered").alias("no", "record")).select("line_id", "no", "record.*")


# --- 2: column profile ---------------------------------------------------------------------------------------------
def _counts(spark: SparkSession, d: str):
    rules = qp.rules_from(table(spark, d, "column_rules"))
    return rules, qp.value_counts(table(spark, d, "split_rows").where("dataset = 'train'"), rules, "load_id", "row_id")


def _profile(spark: SparkSession, d: str):
    rules, counts = _counts(spark, d)
    return rules, qp.states(counts, rules)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rules, counts = _counts(spark, d)
    counts = written(counts, "counts")  # one scan serves the states and the divergence
    state = cut(qp.states(counts, rules))  # a row per load and column; read by every check
    reported = table(spark, d, "profile_statistics").where("dataset = 'train'")
    return qp.findings(
        state, counts, table(spark, d, "loads"), reported, rules,
        range_columns=["battery_v", "yield_g"], js_columns=["channel", "age_band"], pattern_columns=["site_code"],
    )


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    rules, state = _profile(spark, d)
    m = qp.metrics(state, rules)
    return m.select(
        "load_id", "column_name", "row_count", "null_count", "n_unique", F.round("null_rate", 6).alias("null_rate"),
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min_value", "max_value", "out_of_range", "pattern_misses",
    )


def p2_control_limits(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of loads outside the limits that earlier loads of the same drop set."""
    rules, state = _profile(spark, d)
    m = qp.metrics(state, rules)
    long = m.select("load_id", "column_name", F.expr("stack(4, 'null_rate', null_rate, 'n_unique', cast(n_unique as double), 'mean', mean, 'std', std) as (metric, value)"))
    loads = table(spark, d, "loads").select("load_id", "loaded_at", F.regexp_extract("file_name", "^(drop_[0-9]+)", 1).alias("series"))
    out = qp.control_limits(long.where("value is not null").join(loads, "load_id"), "series", ["loaded_at", "load_id"])
    return out.where("anomalous").select("load_id", "column_name", "metric", "history", F.round("value", 4).alias("value"), F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """States of all loads merged per column, as an incremental profile would."""
    _, state = _profile(spark, d)
    return qp.merge_states(state, ["column_name"]).select("column_name", "row_count", "null_count", "min_value", "max_value", "out_of_range", "pattern_misses", "list_misses")


# --- 3: drifting schemas -------------------------------------------------------------------------------------------
FEED_SCHEMA = sd.TargetSchema({"battery_v": "double", "crop": "string", "moisture": "bigint", "is_covered": "boolean"})

#: Every base field of the feeds.
WHOLE_SCHEMA = FEED_SCHEMA.promote({
    "ph": "double", "air_c": "double", "rain_mm": "double", "soil_c": "double", "yield_g": "double", "plant_count": "bigint",
    "light_lux": "bigint", "plot_no": "string", "site_code": "string", "cultivar": "string", "grower_band": "string",
    "is_irrigated": "boolean", "tags": "array<string>", "remark": "string",
})


def _rescued(spark: SparkSession, d: str) -> DataFrame:
    return sd.rescued_records(table(spark, d, "file_records"), "body", "rec_key", ["record_id", "file_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sd.drift_ledger(_rescued(spark, d), table(spark, d, "split_files"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """All files as one table: known fields typed, the rest rescued; then two fields are promoted and replayed."""
    records = table(spark, d, "file_records")
    first = sd.ingest(records, "body", FEED_SCHEMA, ["record_id", "file_id"])
    return sd.replay(first, FEED_SCHEMA.promote({"ph": "double", "air_c": "double"}), ["record_id", "file_id"]).drop("_broken")


def p3_typed(spark: SparkSession, d: str) -> DataFrame:
    """The typed part of the unified table."""
    return p3_unified(spark, d).select("record_id", "file_id", "battery_v", "crop", "moisture", "is_covered", "ph", "air_c")


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """All files as one table: everything but the record key is rescued first, then every base field is promoted, with
    the names that the ledger found for it, and its values are replayed into its typed column; what can't be cast
    without changing what it says stays rescued."""
    rescued = _rescued(spark, d)
    ledger = sd.drift_ledger(rescued, table(spark, d, "split_files"))
    schema = sd.TargetSchema({"rec_key": "string"}).promote(WHOLE_SCHEMA.columns, sd.approved_aliases(ledger, WHOLE_SCHEMA.columns))
    return sd.replay(rescued, schema, ["record_id", "file_id"])


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """Fields with a value of each record of the whole table, typed and rescued together: nothing may be lost."""
    t = p3_table(spark, d)
    typed = [F.col(c).isNotNull().cast("int") for c in ("rec_key", *WHOLE_SCHEMA.columns)]
    return t.select("record_id", (sum(typed[1:], typed[0]) + F.coalesce(F.size(F.json_object_keys("_rescued")), F.lit(0))).cast("bigint").alias("n_fields"))


# --- 7: missing values ---------------------------------------------------------------------------------------------
def _impute(spark: SparkSession, d: str, only_missing: bool, rows: DataFrame | None = None) -> DataFrame:
    rules = {r.column: r for r in qp.rules_from(table(spark, d, "column_rules"))}
    return mi.impute(
        table(spark, d, "split_rows").where("dataset = 'train'") if rows is None else rows, key="row_id", group="device_id", time="observed_at",
        numeric=[mi.NumericField(c, rules[c].min_value, rules[c].max_value) for c in ("soil_c", "moisture")],
        categorical=[mi.CategoryField("crop", rules["crop"].value_list or ())], only_missing=only_missing,
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _impute(spark, d, True).select("row_id", F.explode("filled").alias("column_name"))


def p7_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every train record with its filled fields and marks."""
    return _impute(spark, d, False)


def p7_quality(spark: SparkSession, d: str) -> DataFrame:
    """How good the fills are: every twentieth record by hash has its real values hidden and filled again. Root mean
    square error of numbers and share of wrong crops, beside those of the device's mean and most frequent crop."""
    rules = {r.column: r for r in qp.rules_from(table(spark, d, "column_rules"))}
    rows = table(spark, d, "split_rows").where("dataset = 'train'").select("row_id", "device_id", "observed_at", "crop", "soil_c", "moisture").groupBy("row_id").agg(
        F.min(F.struct("device_id", "observed_at", "crop", "soil_c", "moisture")).alias("r")
    ).select("row_id", "r.*")
    numbers, crops = ("soil_c", "moisture"), mi.CategoryField("crop", rules["crop"].value_list or ())
    real = rows.select("row_id", "device_id", "observed_at", mi.real_category(F.col("crop"), crops).alias("crop"), *[mi.real_number(F.col(c), mi.NumericField(c, rules[c].min_value, rules[c].max_value)).alias(c) for c in numbers])
    real = written(real.withColumn("hidden", F.pmod(F.xxhash64("row_id", F.lit(5)), F.lit(20)) == 0), "real")
    shown = real.where("not hidden")
    model = _impute(spark, d, True, real.select("row_id", "device_id", "observed_at", *[F.when(~F.col("hidden"), F.col(c)).alias(c) for c in ("crop", *numbers)]))
    plain = shown.groupBy("device_id").agg(F.mode("crop").alias("p_crop"), *[F.avg(c).alias(f"p_{c}") for c in numbers])
    x = real.where("hidden").join(model.select("row_id", *[F.col(c).alias(f"m_{c}") for c in ("crop", *numbers)]), "row_id").join(plain, "device_id")
    wrong = lambda a, b: F.avg(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) != F.col(b)).cast("double")))
    rmse = lambda a, b: F.sqrt(F.avg((F.col(a) - F.col(b)) ** 2))
    cells = [F.struct(F.lit("crop").alias("column_name"), F.count("crop").alias("n"), wrong("crop", "m_crop").alias("error"), wrong("crop", "p_crop").alias("device_error"))]
    cells += [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), rmse(c, f"m_{c}").alias("error"), rmse(c, f"p_{c}").alias("device_error")) for c in numbers]
    return x.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.column_name", "c.n", F.round("c.error", 4).alias("error"), F.round("c.device_error", 4).alias("device_error"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every record: its marks, real values unchanged, and all values real where one was filled."""
    rules = {r.column: r for r in qp.rules_from(table(spark, d, "column_rules"))}
    before = table(spark, d, "split_rows").where("dataset = 'train'").select("row_id", *[F.col(c).alias(f"{c}_was") for c in ("crop", "soil_c", "moisture")]).dropDuplicates(["row_id"])
    x = p7_filled(spark, d).join(before, "row_id")
    listed = lambda c: F.lower(F.trim(c)).isin([v.strip().lower() for v in rules["crop"].value_list or ()])
    inside = lambda c, v: F.coalesce(~F.isnan(v.cast("double")) & v.between(rules[c].min_value, rules[c].max_value), F.lit(False))
    marked = lambda c: F.array_contains("filled", c)
    kept = F.coalesce(~listed(F.col("crop_was")) | (F.lower(F.trim("crop_was")) == F.lower(F.trim("crop"))) & ~marked("crop"), F.lit(True))
    real = ~marked("crop") | F.coalesce(listed(F.col("crop")), F.lit(False))
    for c in ("soil_c", "moisture"):
        was = F.col(f"{c}_was")
        kept &= ~inside(c, was) | (was.cast("double") == F.col(c).cast("double")) & ~marked(c)
        real &= ~marked(c) | inside(c, F.col(c))
    return x.select("row_id", F.size("filled").alias("n_filled"), kept.alias("kept"), real.alias("real"))


QUERIES = {
    "p1_found": p1_found, "p1_valid": p1_valid, "p1_errors": p1_errors, "p1_located": p1_located, "p1_recovered": p1_recovered,
    "p2_found": p2_found, "p2_profile": p2_profile, "p2_control_limits": p2_control_limits, "p2_merged": p2_merged,
    "p3_found": p3_found, "p3_unified": p3_unified, "p3_typed": p3_typed, "p3_table": p3_table, "p3_kept": p3_kept,
    "p7_found": p7_found, "p7_filled": p7_filled, "p7_check": p7_check, "p7_quality": p7_quality,
}

_FIELD = r'("([^"]|"")*"|[^",\r\n]*)'
_PARSED_SQL = f"""
WITH q AS (SELECT line_id, raw_line, regexp_full_match(raw_line, '{_FIELD}(,{_FIELD})*') AS ok FROM raw_lines),
f AS (SELECT line_id, ok, CASE WHEN ok THEN regexp_extract_all(',' || raw_line, ',(("([^"]|"")*")|([^",\\r\\n]*))', 1) END AS cells FROM q),
g AS (SELECT line_id, ok, [CASE WHEN c LIKE '"%' THEN replace(c[2:-2], '""', '"') ELSE c END FOR c IN cells] AS v FROM f),
h AS (SELECT line_id, v, CASE WHEN ok IS NULL THEN 'columns' WHEN NOT ok THEN 'quoting' WHEN len(v) <> 8 THEN 'columns'
  WHEN NOT (regexp_full_match(v[1], '[0-9]{{1,18}}') AND regexp_full_match(v[2], '[0-9]{{1,18}}')
    AND (v[3] = '' OR (regexp_full_match(v[3], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AND try_cast(v[3] AS timestamp) IS NOT NULL))
    AND (v[5] = '' OR regexp_full_match(v[5], '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?'))
    AND (v[6] = '' OR (regexp_full_match(v[6], '[0-9]{{1,3}}') AND try_cast(v[6] AS int) <= 100))
    AND v[7] IN ('', 'true', 'false')) THEN 'value' END AS reason FROM g)
"""

_P2_COLUMNS = {"site_code": "txt", "age_band": "txt", "channel": "txt", "crop": "txt", "battery_v": "num", "yield_g": "num", "soil_c": "num", "moisture": "num"}
_P2_SQL = (
    "WITH r AS (SELECT DISTINCT load_id, row_id, " + ", ".join(_P2_COLUMNS) + " FROM split_rows WHERE dataset = 'train'), u AS ("
    + " UNION ALL ".join(
        f"SELECT load_id, '{c}' AS column_name, CAST({c} AS varchar) AS txt, CAST(NULL AS double) AS num FROM r"
        if k == "txt"
        else f"SELECT load_id, '{c}', NULL, CASE WHEN isnan(CAST({c} AS double)) THEN NULL ELSE CAST({c} AS double) END FROM r"
        for c, k in _P2_COLUMNS.items()
    )
    + """), s AS (SELECT u.load_id, u.column_name, count(*) AS n, count(*) FILTER (txt IS NULL AND num IS NULL) AS nulls,
  count(DISTINCT coalesce(txt, CAST(num AS varchar))) AS uniq, avg(num) AS mean, stddev_samp(num) AS sd, min(num) AS lo, max(num) AS hi,
  count(*) FILTER (num < min_value OR num > max_value) AS oor,
  count(*) FILTER (txt IS NOT NULL AND NOT regexp_full_match(txt, value_pattern)) AS bad
  FROM u JOIN column_rules c ON u.column_name = c.column_name GROUP BY 1, 2)
"""
)
_P2_FOUND_SQL = (
    _P2_SQL
    + """, b AS (SELECT s.*, p.nulls / p.n AS b_rate, p.uniq AS b_uniq, p.mean AS b_mean, p.sd AS b_sd FROM s JOIN loads l ON s.load_id = l.load_id
  LEFT JOIN s p ON p.load_id = l.prev_load_id AND p.column_name = s.column_name),
v AS (SELECT load_id, column_name, txt, count(*) AS n FROM u WHERE txt IS NOT NULL AND column_name IN ('channel', 'age_band') GROUP BY 1, 2, 3),
t AS (SELECT load_id, column_name, sum(n) AS n FROM v GROUP BY 1, 2),
k AS (SELECT a.load_id, p.load_id AS prev_id, a.column_name, a.n AS tp, p.n AS tq FROM t a JOIN loads l ON a.load_id = l.load_id JOIN t p ON p.load_id = l.prev_load_id AND p.column_name = a.column_name),
w AS (SELECT k.load_id, k.column_name, x.txt, coalesce(a.n, 0) / k.tp AS p, coalesce(c.n, 0) / k.tq AS q FROM k
  JOIN (SELECT DISTINCT column_name, txt FROM v) x ON x.column_name = k.column_name
  LEFT JOIN v a ON a.load_id = k.load_id AND a.column_name = k.column_name AND a.txt = x.txt
  LEFT JOIN v c ON c.load_id = k.prev_id AND c.column_name = k.column_name AND c.txt = x.txt),
j AS (SELECT load_id, column_name, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js FROM w GROUP BY 1, 2)
SELECT load_id, column_name, 'null_rate' AS check_name FROM b WHERE abs(nulls / n - b_rate) > 0.15
UNION ALL SELECT load_id, column_name, 'distinct_count' FROM b WHERE greatest(uniq, b_uniq) > 0 AND b_uniq IS NOT NULL AND greatest(uniq, b_uniq) >= 3 * least(uniq, b_uniq)
UNION ALL SELECT load_id, column_name, 'range' FROM b WHERE column_name IN ('battery_v', 'yield_g') AND oor > 0
UNION ALL SELECT load_id, column_name, 'mean_drift' FROM b WHERE column_name IN ('battery_v', 'yield_g') AND abs(mean - b_mean) / (b_sd + 1e-8) > 1
UNION ALL SELECT load_id, column_name, 'pattern' FROM b WHERE column_name = 'site_code' AND bad > 0
UNION ALL SELECT load_id, column_name, 'js_divergence' FROM j WHERE js > 0.2
UNION ALL SELECT DISTINCT s.load_id, s.column_name, 'reported_null_count' FROM s JOIN profile_statistics p ON p.dataset = 'train' AND p.load_id = s.load_id AND p.column_name = s.column_name WHERE p.null_count <> s.nulls
UNION ALL SELECT DISTINCT s.load_id, s.column_name, 'reported_n_unique' FROM s JOIN profile_statistics p ON p.dataset = 'train' AND p.load_id = s.load_id AND p.column_name = s.column_name WHERE p.n_unique <> s.uniq
"""
)

_P3_SQL = """
WITH e AS (SELECT file_id, json_extract_string(body, '$.rec_key') AS rec_key, body, unnest(json_keys(body)) AS field FROM file_records),
v AS (SELECT DISTINCT file_id, rec_key, field, CAST(json_extract(body, '$."' || field || '"') AS varchar) AS value,
  CASE json_type(body, '$."' || field || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind
  FROM e WHERE field <> 'rec_key'),
c AS (SELECT file_id, feed_id, seq_no, lag(file_id) OVER (PARTITION BY feed_id ORDER BY seq_no) AS prev_id FROM split_files),
h AS (SELECT v.file_id, v.field, max(kind) AS kind FROM v GROUP BY 1, 2),
gone AS (SELECT c.file_id, c.prev_id, h.field FROM c JOIN h ON h.file_id = c.prev_id WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.file_id = c.file_id AND x.field = h.field)),
new AS (SELECT c.file_id, c.prev_id, h.field FROM c JOIN h ON h.file_id = c.file_id WHERE c.prev_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h x WHERE x.file_id = c.prev_id AND x.field = h.field)),
keys AS (SELECT DISTINCT file_id, rec_key FROM e),
common AS (SELECT c.file_id, c.prev_id, a.rec_key FROM c JOIN keys a ON a.file_id = c.file_id JOIN keys b ON b.file_id = c.prev_id AND b.rec_key = a.rec_key),
cmp AS (SELECT g.file_id, g.field AS old_field, n.field AS new_field,
  bool_and(coalesce(CASE WHEN o.kind IS NOT NULL THEN o.value END, '') = coalesce(CASE WHEN w.kind IS NOT NULL THEN w.value END, '')) AS same, count(o.kind) AS n
  FROM gone g JOIN new n ON n.file_id = g.file_id JOIN common k ON k.file_id = g.file_id
  LEFT JOIN v o ON o.file_id = g.prev_id AND o.rec_key = k.rec_key AND o.field = g.field
  LEFT JOIN v w ON w.file_id = g.file_id AND w.rec_key = k.rec_key AND w.field = n.field GROUP BY 1, 2, 3),
ren AS (SELECT file_id, old_field, new_field FROM cmp WHERE same AND n > 0),
kn AS (SELECT c.file_id, c.prev_id, h.field, h.kind, last_value(h.kind IGNORE NULLS) OVER (PARTITION BY c.feed_id, h.field ORDER BY c.seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM h JOIN c ON c.file_id = h.file_id)
SELECT file_id, 'renamed' AS change_kind, old_field, new_field FROM ren
UNION ALL SELECT file_id, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_id = g.file_id AND r.old_field = g.field)
UNION ALL SELECT file_id, 'added', '', field FROM new n WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_id = n.file_id AND r.new_field = n.field)
UNION ALL SELECT file_id, 'retyped', field, field FROM kn WHERE prev_id IS NOT NULL AND kind <> known
  AND (EXISTS (SELECT 1 FROM h x WHERE x.file_id = kn.prev_id AND x.field = kn.field) OR EXISTS (SELECT 1 FROM ren r WHERE r.file_id = kn.file_id AND r.new_field = kn.field))
"""

_P7_SQL = """
WITH r AS (SELECT DISTINCT row_id, device_id, crop, soil_c, moisture FROM split_rows WHERE dataset = 'train'),
u AS (SELECT row_id, device_id, 'crop' AS column_name, lower(trim(crop)) IN (SELECT lower(trim(unnest(value_list))) FROM column_rules WHERE column_name = 'crop') AS ok FROM r
UNION ALL SELECT row_id, device_id, 'soil_c', NOT isnan(soil_c) AND soil_c BETWEEN (SELECT min_value FROM column_rules WHERE column_name = 'soil_c') AND (SELECT max_value FROM column_rules WHERE column_name = 'soil_c') FROM r
UNION ALL SELECT row_id, device_id, 'moisture', moisture BETWEEN (SELECT min_value FROM column_rules WHERE column_name = 'moisture') AND (SELECT max_value FROM column_rules WHERE column_name = 'moisture') FROM r)
SELECT row_id, column_name FROM u WHERE ok IS NOT TRUE AND EXISTS (SELECT 1 FROM u x WHERE x.device_id = u.device_id AND x.column_name = u.column_name AND x.ok)
"""

_P3_TYPED_SQL = """
SELECT record_id, file_id, """ + ", ".join(
    f"CASE WHEN regexp_full_match(trim(json_extract_string(body, '$.{c}')), '{p}') THEN try_cast(trim(json_extract_string(body, '$.{c}')) AS {t}) END AS {c}"
    if t
    else f"CASE WHEN json_type(body, '$.{c}') = 'VARCHAR' THEN json_extract_string(body, '$.{c}') END AS {c}"
    for c, t, p in (
        ("battery_v", "double", "[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?"),
        ("crop", "", ""),
        ("moisture", "bigint", "[+-]?[0-9]+"),
        ("is_covered", "boolean", "true|false"),
        ("ph", "double", "[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?"),
        ("air_c", "double", "[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?"),
    )
) + " FROM file_records"

_P3_COLUMNS = ("battery_v", "crop", "moisture", "is_covered", "ph", "air_c")
_P3_UNIFIED_SQL = f"""WITH t AS ({_P3_TYPED_SQL}), e AS (SELECT record_id, body, unnest(json_keys(body)) AS k FROM file_records),
v AS (SELECT e.record_id, k, regexp_replace(CAST(json_extract(body, '$."' || k || '"') AS varchar), '^(\\[?-?[0-9]+)[.]0(\\]?)$', '\\1\\2') AS x, CASE k {' '.join(f"WHEN '{c}' THEN {c} IS NOT NULL" for c in _P3_COLUMNS)} ELSE false END AS placed FROM e JOIN t ON t.record_id = e.record_id),
r AS (SELECT record_id, '{{' || string_agg('"' || k || '":' || x, ',' ORDER BY k) || '}}' AS _rescued FROM v WHERE NOT placed AND x <> 'null' GROUP BY 1)
SELECT t.*, _rescued FROM t LEFT JOIN r ON r.record_id = t.record_id"""

SQL = {
    "p1_found": _PARSED_SQL + "SELECT line_id, reason FROM h WHERE reason IS NOT NULL",
    "p1_valid": _PARSED_SQL
    + """SELECT line_id, CAST(v[1] AS bigint) AS row_id, CAST(v[2] AS bigint) AS device_id, CAST(nullif(v[3], '') AS timestamp) AS observed_at, nullif(v[4], '') AS crop,
  CAST(nullif(v[5], '') AS double) AS soil_c, CAST(nullif(v[6], '') AS int) AS moisture, CAST(nullif(v[7], '') AS boolean) AS is_irrigated, nullif(v[8], '') AS note FROM h WHERE reason IS NULL""",
    "p2_found": _P2_FOUND_SQL,
    "p2_profile": _P2_SQL
    + """SELECT load_id, column_name, n AS row_count, nulls AS null_count, uniq AS n_unique, round(nulls / n, 6) AS null_rate, round(mean, 6) AS mean, round(sd, 6) AS std, lo AS min_value, hi AS max_value, oor AS out_of_range, bad AS pattern_misses FROM s""",
    "p2_merged": _P2_SQL
    + """SELECT u.column_name, count(*) AS row_count, count(*) FILTER (txt IS NULL AND num IS NULL) AS null_count, min(num) AS min_value, max(num) AS max_value, count(*) FILTER (num < lo OR num > hi) AS out_of_range,
  count(*) FILTER (NOT regexp_full_match(txt, value_pattern)) AS pattern_misses, count(*) FILTER (NOT list_contains(list_transform(value_list, lambda v: lower(trim(v))), lower(trim(txt)))) AS list_misses
  FROM u JOIN (SELECT column_name, min_value AS lo, max_value AS hi, value_pattern, value_list FROM column_rules) c ON u.column_name = c.column_name GROUP BY 1""",
    "p2_control_limits": _P2_SQL
    + """, m AS (SELECT load_id, column_name, 'null_rate' AS metric, nulls / n AS value FROM s UNION ALL SELECT load_id, column_name, 'n_unique', CAST(uniq AS double) FROM s UNION ALL SELECT load_id, column_name, 'mean', mean FROM s UNION ALL SELECT load_id, column_name, 'std', sd FROM s),
w AS (SELECT m.*, count(value) OVER h AS history, avg(value) OVER h AS c, stddev_samp(value) OVER h AS d FROM m JOIN loads l ON l.load_id = m.load_id WHERE value IS NOT NULL
  WINDOW h AS (PARTITION BY regexp_extract(l.file_name, '^(drop_[0-9]+)', 1), column_name, metric ORDER BY l.loaded_at, l.load_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT load_id, column_name, metric, history, round(value, 4) AS value, round(c - 3 * d, 4) AS lower, round(c + 3 * d, 4) AS upper FROM w WHERE history >= 5 AND (value < c - 3 * d OR value > c + 3 * d)""",
    "p3_found": _P3_SQL,
    "p3_typed": _P3_TYPED_SQL,
    "p3_unified": _P3_UNIFIED_SQL,
    "p3_kept": """SELECT record_id, count(*) FILTER (json_type(body, '$."' || k || '"') <> 'NULL') AS n_fields FROM (SELECT record_id, body, unnest(json_keys(body)) AS k FROM file_records) GROUP BY 1""",
    "p7_found": _P7_SQL,
    "p7_check": f"SELECT r.row_id, CAST(count(f.column_name) AS int) AS n_filled, true AS kept, true AS real FROM (SELECT DISTINCT row_id FROM split_rows WHERE dataset = 'train') r LEFT JOIN ({_P7_SQL}) f ON f.row_id = r.row_id GROUP BY 1",
    "p1_located": _PARSED_SQL + "SELECT line_id, reason, true AS located FROM h WHERE reason IS NOT NULL",
}
