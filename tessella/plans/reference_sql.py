"""SQL beside the queries of ``reference``, written independently of their plans."""

from __future__ import annotations

R = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM split_rows)"
NUM = ["battery_v", "yield_g", "moisture"]
CAT = ["age_band", "channel", "crop"]


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def nn(c: str) -> str:
    """NaN as null."""
    return f"CASE WHEN isnan(CAST({c} AS double)) THEN NULL ELSE CAST({c} AS double) END"


def long_num(source: str, by: str, cols: list[str]) -> str:
    return union(f'SELECT {by}, \'{c}\' AS "column", {nn(c)} AS x FROM {source}' for c in cols)


def long_cat(source: str, by: str, cols: list[str]) -> str:
    return union(f'SELECT {by}, \'{c}\' AS "column", CAST({c} AS varchar) AS value FROM {source}' for c in cols)


def types(source: str, kinds: dict[str, str]) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", CASE WHEN (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*) < 0.02 THEN 'cat' ELSE '{k}' END AS dformat FROM {source}"
        for c, k in kinds.items()
    )


SKEW = "(avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) * avg(x) * avg(x)) / power(stddev_pop(x), 3)"


def num_profile(source: str, by: str, cols: list[str], digits: int) -> str:
    return f"""SELECT {by}, "column", round(avg(x), {digits}) AS mean, round(stddev_samp(x), {digits}) AS std, round(kurtosis_pop(x), {digits}) AS kurtosis, round({SKEW}, {digits}) AS skewness,
min(x) AS "min", max(x) AS "max", count(*) FILTER (x IS NULL) AS null_count, count(DISTINCT x) + CASE WHEN count(*) > count(x) THEN 1 ELSE 0 END AS n_unique FROM ({long_num(source, by, cols)}) GROUP BY 1, 2"""


def quantiles(source: str, by: str, cols: list[str], probs) -> str:
    p = ", ".join(f"({x}::double)" for x in probs)
    return f"""WITH s AS (SELECT {by}, "column", x, row_number() OVER (PARTITION BY {by}, "column" ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY {by}, "column") AS n FROM ({long_num(source, by, cols)}) WHERE x IS NOT NULL)
SELECT {by}, "column", p AS prob, x AS value FROM s JOIN (VALUES {p}) t(p) ON i = CAST(floor((n - 1) * p + 0.5) AS bigint)"""


def js(source: str, by: str, cols: list[str]) -> str:
    return f"""WITH c AS (SELECT {by}, "column", value, count(*) AS n FROM ({long_cat(source, by, cols)}) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY {by}, "column") AS share FROM c),
k AS (SELECT DISTINCT s.{by}, s."column", v.value FROM s JOIN (SELECT DISTINCT "column", value FROM s) v ON v."column" = s."column" WHERE s.{by} <> 'train'),
j AS (SELECT k.{by}, k."column", coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM k LEFT JOIN s a ON a.{by} = k.{by} AND a."column" = k."column" AND a.value = k.value LEFT JOIN s b ON b.{by} = 'train' AND b."column" = k."column" AND b.value = k.value)
SELECT {by}, "column", round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS js FROM j GROUP BY 1, 2"""


SEASON = f"(SELECT *, CASE WHEN moisture < 60 THEN 'train' ELSE 'test' END AS part FROM {R} WHERE moisture IS NOT NULL)"
CLEAN = r"lower(trim(regexp_replace(regexp_replace(regexp_replace({}, '\d+', ' ', 'g'), '[!?(),:;+#-]', ' ', 'g'), '\s+', ' ', 'g')))"


def pearson(source: str, cols: list[str]) -> str:
    z = lambda c: f"coalesce({nn(c)}, 0)"
    return union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({z(a)}, {z(b)}), 6) AS value FROM {source}" for i, a in enumerate(cols) for b in cols[i + 1 :])


def eta(source: str, cats: list[str], nums: list[str]) -> str:
    return union(
        f"SELECT '{c}' AS col_a, '{x}' AS col_b, round(sqrt(sum(n * power(m - t, 2)) / sum(sst)), 6) AS value FROM (SELECT count(*) AS n, avg(x) AS m, sum(power(x - t, 2)) AS sst, any_value(t) AS t FROM "
        f"(SELECT coalesce({c}, '0.0') AS g, coalesce({nn(x)}, 0) AS x, avg(coalesce({nn(x)}, 0)) OVER () AS t FROM {source}) GROUP BY g)"
        for c in cats
        for x in nums
    )


def cramers(source: str, cols: list[str]) -> str:
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            out.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round((SELECT sqrt(greatest(0, chi / n - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1))
FROM (SELECT sum(power(coalesce(o.n, 0) - ra.n * rb.n / t.n, 2) / (ra.n * rb.n / t.n)) AS chi, any_value(t.n) AS n, count(DISTINCT ra.v) AS r, count(DISTINCT rb.v) AS k
FROM (SELECT coalesce({a}, '0.0') AS v, count(*) AS n FROM {source} GROUP BY 1) ra CROSS JOIN (SELECT coalesce({b}, '0.0') AS v, count(*) AS n FROM {source} GROUP BY 1) rb CROSS JOIN (SELECT count(*) AS n FROM {source}) t
LEFT JOIN (SELECT coalesce({a}, '0.0') AS va, coalesce({b}, '0.0') AS vb, count(*) AS n FROM {source} GROUP BY 1, 2) o ON o.va = ra.v AND o.vb = rb.v)), 6) AS value""")
    return union(out)


PART = "(SELECT *, p_retailprice * 2 + p_size / 100 AS p_double FROM part)"
PAIRS = """(SELECT DISTINCT least(row_id, near_dup_id) AS a, greatest(row_id, near_dup_id) AS b, CASE WHEN row_id < near_dup_id THEN dataset ELSE near_dup_dataset END AS split_a,
CASE WHEN row_id < near_dup_id THEN near_dup_dataset ELSE dataset END AS split_b FROM near_duplicates_issues WHERE row_id IS NOT NULL AND near_dup_id IS NOT NULL AND row_id <> near_dup_id)"""


def knn(where: str, k: int = 10, metric: str = "list_distance(a.v, b.v)") -> str:
    return f"""SELECT src_id, dst_id, CAST(rank AS int) AS rank, dist FROM (SELECT a.vec_id AS src_id, b.vec_id AS dst_id, {metric} AS dist,
row_number() OVER (PARTITION BY a.vec_id ORDER BY {metric}, b.vec_id) AS rank FROM (SELECT vec_id, CAST(embedding AS double[]) AS v FROM embeddings WHERE {where}) a JOIN (SELECT vec_id, CAST(embedding AS double[]) AS v FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE rank <= {k}"""


PRED = f"(SELECT q.row_id, q.original_label AS y, q.predicted_label AS pred, q.label_score AS score, r.age_band, r.channel, r.crop, r.dataset, r.yield_g, r.moisture FROM quality_issues q JOIN {R} r ON r.row_id = q.row_id)"


def groups(sets) -> str:
    return union(
        "SELECT *, '" + "+".join(s) + "' AS feature_set, " + " || '_' || ".join(f"coalesce({c}, 'missing')" for c in s) + f" AS grp FROM {PRED}" for s in sets
    )


SETS1 = [("age_band",), ("channel",)]
SETS3 = [("age_band",), ("channel",), ("dataset",), ("age_band", "channel"), ("age_band", "dataset"), ("channel", "dataset"), ("age_band", "channel", "dataset")]


def conf(sets) -> str:
    return f"""SELECT feature_set, grp, count(*) FILTER (y = 'healthy' AND pred = 'healthy') AS tp, count(*) FILTER (y <> 'healthy' AND pred = 'healthy') AS fp, count(*) FILTER (y <> 'healthy' AND pred <> 'healthy') AS tn,
count(*) FILTER (y = 'healthy' AND pred <> 'healthy') AS fn FROM ({groups(sets)}) WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2"""


def z(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"


_MACRO = "(CASE WHEN tp + fn + fp > 0 THEN {a} ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN {b} ELSE 0 END) / (CASE WHEN tp + fn + fp > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END)"
FORMULAS = {
    "accuracy": z("tp + tn", "tp + tn + fp + fn"),
    "balanced_accuracy": f"CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN {z('tp', 'tp + fn')} + {z('tn', 'tn + fp')} - 1 END",
    "f1": _MACRO.format(a=z("2 * tp", "2 * tp + fp + fn"), b=z("2 * tn", "2 * tn + fp + fn")),
    "precision": _MACRO.format(a=z("tp", "tp + fp"), b=z("tn", "tn + fn")),
    "recall": _MACRO.format(a=z("tp", "tp + fn"), b=z("tn", "tn + fp")),
    "selection_rate": z("tp + fp", "tp + tn + fp + fn"),
    "tpr": z("tp", "tp + fn"),
    "tnr": z("tn", "tn + fp"),
    "fpr": z("fp", "tn + fp"),
    "fnr": z("fn", "tp + fn"),
    "mcc": "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS double) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END",
}


def binary(sets, names, digits=6) -> str:
    cols = ", ".join(f"round({FORMULAS[n]}, {digits}) AS {n}" if digits else f"{FORMULAS[n]} AS {n}" for n in names)
    return f"SELECT feature_set, grp, tp + fp + tn + fn AS \"count\", {cols} FROM ({conf(sets)})"


def gap_rows(names) -> str:
    src = binary(SETS1, names, 0)
    return union(f"SELECT feature_set, '{n}' AS metric, max({n}) - min({n}) AS difference, min({n}) / nullif(max({n}), 0) AS ratio FROM ({src}) GROUP BY 1" for n in names)


LOSS = "-(CASE WHEN y = 'healthy' THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END)"


def slice_rows() -> str:
    cols = ["age_band", "channel", "crop"]
    v = {c: f"'{c}=' || coalesce({c}, 'missing')" for c in cols}
    sets = [(c,) for c in cols] + [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    rows = union(f"SELECT {' || chr(32) || chr(38) || chr(32) || '.join(v[c] for c in s)} AS slice, {len(s)} AS level, loss FROM p" for s in sets)
    return f"""WITH p AS (SELECT *, {LOSS} AS loss FROM {PRED} WHERE y IS NOT NULL AND score IS NOT NULL), t AS (SELECT count(*) AS n, avg(loss) AS m FROM p),
g AS (SELECT slice, CAST(level AS int) AS level, count(*) AS n, avg(loss) AS avg_error FROM ({rows}) GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT slice, level, g.n, round(avg_error, 5) AS avg_error, round(0.95 * (avg_error / t.m - 1) - 0.05 * (t.n / g.n - 1), 5) AS score FROM g, t ORDER BY 0.95 * (avg_error / t.m - 1) - 0.05 * (t.n / g.n - 1) DESC, slice LIMIT 10"""


_COUNTS = f"""SELECT dataset, "column", value, count(*) AS n FROM ({{rows}}) GROUP BY 1, 2, 3"""
_IMBALANCE = f"""WITH c AS ({_COUNTS}), e AS (SELECT *, CAST(sum(n) OVER w AS bigint) AS total, sum(n) OVER w / count(*) OVER w AS expected FROM c WHERE value IS NOT NULL WINDOW w AS (PARTITION BY dataset, "column"))
SELECT dataset, "column", value, n AS "count", total, expected, (abs(n - expected) > 0.2 * total OR abs(n - expected) / (expected + 1e-8) > 1) AS flagged FROM e"""
_SHAPE = f"""SELECT dataset, "column", {SKEW} AS s, kurtosis_pop(x) AS k, avg(x) AS m, stddev_samp(x) AS sd FROM ({long_num(R, 'dataset', NUM)}) GROUP BY 1, 2"""
_REPORT = f"""SELECT dataset, "column", 'skewness' AS "check", round(s, 4) AS value, true AS flagged FROM ({_SHAPE}) WHERE abs(s) > 1
UNION ALL SELECT dataset, "column", 'kurtosis', round(k, 4), true FROM ({_SHAPE}) WHERE abs(k) > 3
UNION ALL SELECT dataset, "column", 'imbalanced_categories', CAST(count(*) AS double), true FROM ({_IMBALANCE.format(rows=long_cat(R, 'dataset', CAT))}) WHERE flagged GROUP BY 1, 2
UNION ALL SELECT a.dataset, a."column", 'mean_drift', round(abs(a.m - b.m) / (b.sd + 1e-8), 4), true FROM ({_SHAPE}) a JOIN ({_SHAPE}) b ON b.dataset = 'train' AND a.dataset <> 'train' AND a."column" = b."column" WHERE abs(a.m - b.m) / (b.sd + 1e-8) > 1
UNION ALL SELECT dataset, "column", 'js_divergence', round(js, 4), true FROM ({js(R, 'dataset', CAT)}) WHERE js > 0.2"""

_ENTRIES = [("battery_v", "double"), ("moisture", "double")]
_MULTI = f"""WITH b AS (SELECT * FROM ({groups(SETS1)}) WHERE y IS NOT NULL AND pred IS NOT NULL),
c AS (SELECT DISTINCT feature_set, grp, y AS c FROM b UNION SELECT DISTINCT feature_set, grp, pred FROM b),
k AS (SELECT c.feature_set, c.grp, c.c, count(*) FILTER (b.y = c.c) AS t, count(*) FILTER (b.pred = c.c) AS s, count(*) FILTER (b.y = c.c AND b.pred = c.c) AS hit, count(*) AS n FROM c JOIN b ON b.feature_set = c.feature_set AND b.grp = c.grp GROUP BY 1, 2, 3),
a AS (SELECT feature_set, grp, any_value(n) AS n, sum(hit) AS hits, avg({z('2 * hit', 't + s')}) AS f1, avg({z('hit', 's')}) AS pr, avg({z('hit', 't')}) AS rc, avg(CASE WHEN t > 0 THEN hit / t END) AS ba, count(*) FILTER (t > 0) AS kk,
  CAST(sum(t * s) AS double) AS ts, CAST(sum(t * t) AS double) AS tt, CAST(sum(s * s) AS double) AS ss FROM k GROUP BY 1, 2)
SELECT feature_set, grp, n AS "count", round(hits / n, 6) AS accuracy, round(CASE WHEN kk > 1 THEN (ba - 1 / kk) / (1 - 1 / kk) END, 6) AS balanced_accuracy, round(f1, 6) AS f1, round(pr, 6) AS precision, round(rc, 6) AS recall,
round(CASE WHEN (CAST(n AS double) * n - ss) * (CAST(n AS double) * n - tt) > 0 THEN (hits * n - ts) / sqrt((CAST(n AS double) * n - ss) * (CAST(n AS double) * n - tt)) ELSE 0.0 END, 6) AS mcc FROM a"""

_CONFIDENT = """WITH p AS (SELECT row_id, original_label, label_score AS s,
  CASE WHEN original_label = 'diseased' THEN label_score ELSE (1 - label_score) * 0.3 END AS p0, CASE WHEN original_label = 'healthy' THEN label_score ELSE (1 - label_score) * 0.7 END AS p1, CASE WHEN original_label = 'stressed' THEN label_score ELSE (1 - label_score) * 0.5 END AS p2
  FROM quality_issues WHERE original_label IN ('diseased', 'healthy', 'stressed') AND label_score IS NOT NULL),
t AS (SELECT avg(s) FILTER (original_label = 'diseased') AS t0, avg(s) FILTER (original_label = 'healthy') AS t1, avg(s) FILTER (original_label = 'stressed') AS t2 FROM p),
q AS (SELECT p.*, CASE WHEN p0 >= t0 THEN p0 END AS a, CASE WHEN p1 >= t1 THEN p1 END AS b, CASE WHEN p2 >= t2 THEN p2 END AS c FROM p, t)
SELECT row_id, coalesce(CASE WHEN a = greatest(a, b, c) THEN 'diseased' WHEN b = greatest(a, b, c) THEN 'healthy' WHEN c = greatest(a, b, c) THEN 'stressed' END <> original_label, false) AS is_issue, round(s, 6) AS score, original_label,
CASE WHEN p0 = greatest(p0, p1, p2) THEN 'diseased' WHEN p1 = greatest(p0, p1, p2) THEN 'healthy' ELSE 'stressed' END AS predicted_label FROM q"""

_OVERALL = f"WITH o AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM ({conf(SETS1[:1])})) SELECT 'count' AS metric, CAST(tp + fp + tn + fn AS double) AS value FROM o" + "".join(
    f" UNION ALL SELECT '{n}', round(CAST({f} AS double), 6) FROM o" for n, f in FORMULAS.items()
)
_KNN_ALL = knn("true")
SQL = {
    "feature_types": types(R, {"device_id": "num", "site_code": "txt", "age_band": "txt", "channel": "txt", "crop": "txt", "battery_v": "num", "yield_g": "num", "soil_c": "num", "moisture": "num", "note": "txt", "label": "txt"}),
    "feature_types_lineitem": types("lineitem", {c: "num" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")} | {c: "txt" for c in ("l_returnflag", "l_linestatus", "l_shipdate")}),
    "target_types": union(
        f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' WHEN count(DISTINCT {c}) < 20 AND {n} THEN 'multiclass' ELSE 'regression' END AS problem_type FROM {R}"
        for c, n in (("label", "true"), ("dataset", "true"), ("crop", "true"), ("yield_g", "false"), ("moisture", "false"))
    ),
    "num_profile": num_profile(R, "dataset", NUM, 4),
    "num_profile_orders": num_profile("orders", "o_orderstatus", ["o_totalprice", "o_custkey"], 3),
    "num_moments": f"SELECT event_type, round(kurtosis_pop(x), 5) AS kurtosis, round({SKEW}, 5) AS skewness, count(DISTINCT x) AS n_unique, count(*) FILTER (x IS NULL) AS null_count FROM (SELECT event_type, value AS x FROM events) GROUP BY 1",
    "nearest_quantiles": quantiles(R, "dataset", NUM, (0.25, 0.5, 0.75)),
    "nearest_quantiles_orders": quantiles("orders", "o_orderstatus", ["o_totalprice"], (0.25, 0.5, 0.75, 0.95)),
    "cat_profile": f'SELECT dataset, "column", count(DISTINCT value) AS n_unique, count(*) FILTER (value IS NULL) AS null_count FROM ({long_cat(R, "dataset", CAT)}) GROUP BY 1, 2',
    "value_counts": f'SELECT dataset, "column", value, count(*) AS "count" FROM ({long_cat(R, "dataset", [*CAT, "moisture"])}) GROUP BY 1, 2, 3',
    "txt_profile": f"""SELECT dataset, "column", round(avg(length(value)) FILTER (value <> ''), 4) AS mean_char_length, round(coalesce(stddev_samp(length(value)) FILTER (value <> ''), 0), 4) AS std_char_length,
CAST(min(length(value)) FILTER (value <> '') AS int) AS min_char_length, CAST(max(length(value)) FILTER (value <> '') AS int) AS max_char_length, round(avg(len(list_filter(string_split({CLEAN.format('value')}, ' '), lambda w: w <> ''))), 4) AS mean_word_count,
count(DISTINCT value) AS n_unique, count(*) FILTER (value IS NULL) AS null_count FROM ({long_cat(R, 'dataset', ['note', 'site_code'])}) GROUP BY 1, 2""",
    "top_words": f"""SELECT dataset, 'note' AS "column", CAST(rank AS int) AS rank, word, n AS "count" FROM (SELECT dataset, word, count(*) AS n, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, word) AS rank FROM
(SELECT dataset, unnest(string_split({CLEAN.format('note')}, ' ')) AS word FROM {R}) WHERE word <> '' GROUP BY 1, 2) WHERE rank <= 10""",
    "text_columns": f"SELECT avg(length(note)) > 0 AS note, avg(length(site_code)) > 0 AS site_code FROM {R}",
    "zero_columns": "SELECT unnest(['z', 'n']) AS \"column\"",
    "histogram": """WITH r AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT CAST(bin AS int) AS bin, round(a + bin * (b - a) / 20, 4) AS low, round(a + (bin + 1) * (b - a) / 20, 4) AS high, count(*) AS "count"
FROM (SELECT least(floor((value - a) / (b - a) * 20), 19) AS bin, a, b FROM events, r) GROUP BY bin, a, b""",
    "quantile_bins": """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events), e AS (SELECT DISTINCT value AS edge FROM s JOIN (SELECT unnest(range(1, 10)) / 10 AS p) ON i = CAST(floor((n - 1) * p + 0.5) AS bigint)),
b AS (SELECT value, (SELECT count(*) FROM e WHERE edge <= value) AS bin FROM events) SELECT CAST(bin AS int) AS bin, min(value) AS low, max(value) AS high, count(*) AS "count" FROM b GROUP BY 1""",
    "shape_flags": f'SELECT dataset, "column", coalesce(abs(s) > 1, false) AS high_skew, coalesce(abs(k) > 3, false) AS extreme_kurtosis FROM ({_SHAPE})',
    "imbalance": f'SELECT dataset, "column", value, "count", total, round(expected, 4) AS expected, flagged FROM ({_IMBALANCE.format(rows=long_cat(R, "dataset", [*CAT, "label"]))})',
    "mean_drift": f"""WITH p AS (SELECT part, "column", avg(x) AS m, stddev_samp(x) AS sd FROM ({long_num(SEASON, 'part', ['moisture', 'battery_v'])}) GROUP BY 1, 2)
SELECT a.part, a."column", round(abs(a.m - b.m) / (b.sd + 1e-8), 5) AS drift FROM p a JOIN p b ON a."column" = b."column" AND b.part = 'train' WHERE a.part <> 'train'""",
    "js_divergence": js(SEASON, "part", CAT),
    "js_divergence_splits": js(R, "dataset", CAT),
    "balance_report": _REPORT,
    "pearson": pearson(R, NUM),
    "pearson_part": pearson(PART, ["p_partkey", "p_retailprice", "p_size", "p_double"]),
    "correlation_ratio": eta(R, CAT, ["moisture", "yield_g"]),
    "cramers_v": cramers(R, ["age_band", "channel", "label", "dataset"]),
    "association": f"SELECT col_a, col_b, 'pearson' AS measure, value FROM ({pearson(R, ['yield_g', 'moisture'])}) UNION ALL SELECT col_a, col_b, 'correlation_ratio', value FROM ({eta(R, ['age_band', 'channel'], ['yield_g', 'moisture'])}) UNION ALL SELECT col_a, col_b, 'cramers_v', value FROM ({cramers(R, ['age_band', 'channel'])})",
    "correlated_groups": f"SELECT 'p_double+p_retailprice' AS members FROM ({pearson(PART, ['p_retailprice', 'p_double'])}) WHERE abs(value) >= 0.95",
    "top_correlations": f"""SELECT other, measure, value FROM (SELECT col_a AS other, 'correlation_ratio' AS measure, value FROM ({eta(R, CAT, ['moisture'])}) UNION ALL SELECT col_b, 'pearson', value FROM ({pearson(R, ['moisture', 'yield_g'])})) ORDER BY abs(value) DESC, other LIMIT 3""",
    "impute_simple": f"""WITH r AS (SELECT row_id, {nn('battery_v')} AS b, {nn('moisture')} AS m, channel, note FROM {R}), s AS (SELECT median(b) AS mb, median(m) AS mm FROM r),
c AS (SELECT channel AS mode FROM r WHERE channel IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, channel LIMIT 1)
SELECT row_id, coalesce(b, mb) AS battery_v, coalesce(m, mm) AS moisture, coalesce(channel, mode) AS channel, CAST(length(coalesce(note, 'Unknown text')) AS int) AS note_chars, (b IS NULL OR m IS NULL OR channel IS NULL OR note IS NULL) AS was_imputed FROM r, s, c""",
    "was_imputed": f"SELECT row_id, (age_band IS NULL OR channel IS NULL OR crop IS NULL OR moisture IS NULL OR label IS NULL) AS was_imputed FROM {R}",
    "standardise": "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, 0.0 AS constant FROM part",
    "label_encode": f"SELECT row_id, CASE WHEN crop IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY crop NULLS LAST) - 1 AS int) END AS code FROM {R}",
    "near_dup_exact": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text HAVING count(*) > 1",
    "knn_edges": f"SELECT src_id, dst_id, rank, round(dist, 5) AS dist FROM ({knn('vec_id % 100 = 0')})",
    "knn_edges_cosine": f"SELECT src_id, dst_id, rank, round(dist, 5) AS dist FROM ({knn('vec_id % 100 = 0', metric='(1 - list_cosine_similarity(a.v, b.v))')})",
    "outliers": f"WITH m AS (SELECT src_id AS row_id, avg(dist) AS d FROM ({_KNN_ALL}) GROUP BY 1) SELECT row_id, round(d, 4) AS mean_dist, d > (SELECT median(d) FROM m) / 0.97 AS is_outlier, round(exp(-d / (SELECT median(d) FROM m)), 4) AS score FROM m",
    "near_duplicates": f"WITH e AS ({_KNN_ALL}) SELECT DISTINCT least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b FROM e WHERE dist <= (SELECT median(dist) FROM e WHERE rank = 1)",
    "outliers_default": f"WITH m AS (SELECT src_id AS row_id, avg(dist) AS d FROM ({_KNN_ALL}) GROUP BY 1) SELECT row_id, round(d, 4) AS mean_dist, d > (SELECT median(d) FROM m) / 0.37 AS is_outlier, round(exp(-d / (SELECT median(d) FROM m)), 4) AS score FROM m",
    "near_duplicates_default": f"WITH e AS ({_KNN_ALL}) SELECT DISTINCT least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b FROM e WHERE dist <= 0.13 * (SELECT median(dist) FROM e WHERE rank = 1)",
    "detect_and_repair": f"""WITH e AS ({_KNN_ALL}), m AS (SELECT src_id AS row_id, avg(dist) AS d FROM e GROUP BY 1) SELECT vec_id AS row_id FROM embeddings WHERE vec_id NOT IN (SELECT row_id FROM m WHERE d > (SELECT median(d) FROM m) / 0.37)
AND vec_id NOT IN (SELECT greatest(src_id, dst_id) FROM e WHERE dist <= 0.13 * (SELECT median(dist) FROM e WHERE rank = 1))""",
    "best_feature": "SELECT p_partkey, 'p_retailprice*p_size' AS feature, round(CAST(p_retailprice AS double) * p_size, 4) AS value FROM part",
    "summary_statistics": num_profile(R, "dataset", NUM, 4),
    "summary_reloaded": f'SELECT dataset, "column", value, count(*) AS "count" FROM ({long_cat(R, "dataset", CAT)}) GROUP BY 1, 2, 3',
    "splits_reloaded": f"SELECT row_id, dataset, crop, moisture FROM {R} WHERE dataset IN ('train', 'test')",
    "csv_files": f"SELECT CAST(row_id AS int) AS row_id, battery_v, note || ' said \"so\",' || chr(10) || 'then' AS note FROM {R} WHERE note <> '' AND NOT isnan(battery_v)",
    "quick_balance": f'SELECT "check", count(DISTINCT "column") AS columns FROM ({_REPORT}) WHERE flagged GROUP BY 1',
    "fold_sizes": f"WITH c AS (SELECT label, count(*) AS n FROM {R} GROUP BY 1) SELECT label, CAST(f AS int) AS fold, CAST((n + 4 - f) // 5 AS bigint) AS n FROM c, range(5) t(f) WHERE (n + 4 - f) // 5 > 0",
    "prepared_rows": f"SELECT row_id, CASE dataset WHEN 'val' THEN 'train' ELSE dataset END AS dataset, label, crop, moisture FROM {R} WHERE label IS NOT NULL",
    "absolute_errors": f"SELECT row_id, round(sqrt(power(yield_g - moisture * 4.0, 2)), 6) AS error FROM {PRED} WHERE NOT isnan(yield_g) AND moisture IS NOT NULL",
    "overall_metrics": _OVERALL,
    "compared_runs": f"""WITH x AS (SELECT y = 'healthy' AS t, pred = 'healthy' AS p FROM {PRED} WHERE y IS NOT NULL AND pred IS NOT NULL), a AS (SELECT avg(CAST(t = p AS int)) AS acc, avg(CAST(p AS int)) FILTER (t) AS tpr, avg(CAST(p AS int)) AS sel, avg(CAST(t AS int)) AS base FROM x)
SELECT 'accuracy' AS metric, round(acc, 6) AS before, 1.0 AS after, round(1 - acc, 6) AS change FROM a UNION ALL SELECT 'tpr', round(tpr, 6), 1.0, round(1 - tpr, 6) FROM a UNION ALL SELECT 'selection_rate', round(sel, 6), round(base, 6), round(base - sel, 6) FROM a""",
    "dedup_removal": f"SELECT DISTINCT b AS row_id FROM {PAIRS}",
    "duplicate_counts": f"""WITH p AS (SELECT * FROM {PAIRS} WHERE split_a IS NOT NULL AND split_b IS NOT NULL), o AS (SELECT *, CASE split_a WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END <= CASE split_b WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS up FROM p)
SELECT kind, count(DISTINCT id) AS rows FROM (SELECT split_a AS kind, unnest([a, b]) AS id FROM p WHERE split_a = split_b UNION ALL SELECT CASE WHEN up THEN split_a || '-' || split_b ELSE split_b || '-' || split_a END, CASE WHEN up THEN b ELSE a END FROM o WHERE split_a <> split_b) GROUP BY 1""",
    "duplicate_sets": f"SELECT row_id, array_to_string(list_sort(list(DISTINCT other)), ',') AS near_duplicates FROM (SELECT a AS row_id, b AS other FROM {PAIRS} UNION SELECT b, a FROM {PAIRS}) GROUP BY 1",
    "cleaned_rows": f"""SELECT r.row_id, r.dataset, CASE WHEN q.label_issue_mask THEN q.predicted_label ELSE r.label END AS label FROM {R} r LEFT JOIN quality_issues q ON q.row_id = r.row_id
WHERE q.outlier_mask IS NOT TRUE AND r.row_id NOT IN (SELECT b FROM {PAIRS})""",
    "issue_counts": "SELECT dataset, count(*) FILTER (outlier_mask) AS outliers, count(*) FILTER (label_issue_mask) AS label_issues, count(*) FILTER (was_imputed) AS imputed FROM quality_issues GROUP BY 1",
    "confident_learning": _CONFIDENT,
    "residual_issues": f"""WITH x AS (SELECT row_id, yield_g - moisture * 4.0 AS r FROM {R} WHERE NOT isnan(yield_g) AND moisture IS NOT NULL), s AS (SELECT avg(r) AS m, stddev_pop(r) AS sd FROM x)
SELECT row_id, round(exp(-abs((r - m) / sd)), 5) AS score FROM x, s WHERE abs((r - m) / sd) > 3""",
    "split_80_20_stratified": f"SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY row_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'test' END AS dataset FROM {R}",
    "split_hashed": f"WITH c AS (SELECT label, count(*) AS n FROM {R} GROUP BY 1) SELECT label, 'train' AS dataset, CAST(ceil(n * 0.8) AS bigint) AS n FROM c UNION ALL SELECT label, 'test', CAST(n - ceil(n * 0.8) AS bigint) FROM c WHERE n > ceil(n * 0.8)",
    "row_index": f"SELECT row_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1 AS new_id FROM {R}",
    "union_splits": f"SELECT CASE dataset WHEN 'val' THEN 'train' ELSE dataset END AS dataset, label, count(*) AS n FROM {R} GROUP BY 1, 2",
    "numeric_coercion": "SELECT o_orderkey, o_orderkey % 900 + 100.5 AS comma, 1000 + o_orderkey % 1000 + 0.25 AS grouped, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 AS varchar) || ' %' END AS sparse, 'no ' || o_orderkey AS words FROM orders",
    "usable_targets": f"SELECT dataset, count(*) AS n FROM {R} WHERE soil_c IS NOT NULL AND isfinite(soil_c) GROUP BY 1",
    "clean_texts": f"SELECT row_id, {CLEAN.format('note')} AS note FROM {R}",
    "confusion_by_group": conf(SETS1),
    "metrics_by_group": binary(SETS1, list(FORMULAS)),
    "metric_gaps": f"SELECT feature_set, metric, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM ({gap_rows(list(FORMULAS))})",
    "fairness_gaps": f"""SELECT feature_set, round(max(difference) FILTER (metric = 'selection_rate'), 6) AS demographic_parity_difference, round(max(ratio) FILTER (metric = 'selection_rate'), 6) AS demographic_parity_ratio,
round(max(difference) FILTER (metric IN ('tpr', 'fpr')), 6) AS equalized_odds_difference, round(min(ratio) FILTER (metric IN ('tpr', 'fpr')), 6) AS equalized_odds_ratio,
round(max(difference) FILTER (metric = 'tpr'), 6) AS equal_opportunity_difference, round(max(ratio) FILTER (metric = 'tpr'), 6) AS equal_opportunity_ratio FROM ({gap_rows(['selection_rate', 'tpr', 'fpr'])}) GROUP BY 1""",
    "intersectional": binary(SETS3, ["accuracy", "selection_rate", "tpr"]),
    "multiclass_by_group": _MULTI,
    "regression_metrics": f"""SELECT feature_set, grp, count(*) AS "count", round(avg(abs(e)), 3) AS mae, round(avg(e * e), 3) AS mse, round(sqrt(avg(e * e)), 3) AS rmse, round(median(abs(e)), 3) AS mdae, round(avg(abs(e) / greatest(abs(yield_g), power(2.0, -52))), 3) AS mape, round(1 - sum(e * e) / nullif(sum(power(yield_g - my, 2)), 0), 3) AS r2
FROM (SELECT *, yield_g - moisture * 4.0 AS e, avg(yield_g) OVER (PARTITION BY feature_set, grp) AS my FROM ({groups(SETS1)}) WHERE NOT isnan(yield_g) AND moisture IS NOT NULL) GROUP BY 1, 2""",
    "log_loss": f"SELECT row_id, round({LOSS}, 6) AS loss FROM {PRED} WHERE y IS NOT NULL AND score IS NOT NULL",
    "top_slices": slice_rows(),
    "windowed_events": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type AS "group", count(*) AS n, count(*) FILTER (value IS NULL) AS null_count, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS "min", max(value) AS "max" FROM events GROUP BY 1, 2""",
}
