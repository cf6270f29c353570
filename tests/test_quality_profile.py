import math
import statistics
from fractions import Fraction

import pytest

from tessella.operators import quality_profile as qp

RULES = [qp.ColumnRule("x", "num", 0.0, 10.0), qp.ColumnRule("c", "cat", value_list=("a", "b")), qp.ColumnRule("s", "txt", value_pattern="^[A-Z]$")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, load long, x double, c string, s string, n int, text string")


@pytest.fixture
def data(spark):
    nan = float("nan")
    first = [(i, 1, float(i), "a", "A", 0, "t") for i in range(4)]
    second = [(10, 2, None, "b", "A", 0, "t"), (11, 2, nan, "b", "A\n", 0, "t"), (12, 2, 11.0, None, "B", 0, "t"), (12, 2, 11.0, None, "B", 0, "t")]
    return frame(spark, first + second)


def test_states_findings_and_merge(spark, data):
    counts = qp.value_counts(data, RULES, "load", "id")
    state = qp.states(counts, RULES)
    m = {(r.load_id, r.column_name): r for r in qp.metrics(state, RULES).collect()}
    assert (m[1, "x"].row_count, m[1, "x"].null_count, m[1, "x"].n_unique, m[1, "x"].mean) == (4, 0, 4, 1.5)
    assert math.isclose(m[1, "x"].std, math.sqrt(5 / 3))
    assert (m[2, "x"].row_count, m[2, "x"].null_count, m[2, "x"].out_of_range, m[2, "x"].std) == (3, 2, 1, None)
    assert m[2, "s"].pattern_misses == 1 and m[2, "c"].null_count == 1
    loads = spark.createDataFrame([(1, None), (2, 1)], "load_id long, prev_load_id long")
    said = spark.createDataFrame([(1, "x", 0, 4), (1, "x", None, 5), (2, "c", 3, None), (9, "x", 1, 1)], "load_id long, column_name string, null_count long, n_unique long")
    got = {tuple(r) for r in qp.findings(state, counts, loads, said, RULES).collect()}
    assert got == {
        (2, "x", "null_rate"), (2, "c", "null_rate"), (2, "x", "distinct_count"), (2, "s", "distinct_count"), (2, "x", "range"), (2, "s", "pattern"), (2, "x", "mean_drift"),
        (2, "c", "js_divergence"), (1, "x", "reported_n_unique"), (2, "c", "reported_null_count"),
    }
    merged = {r.column_name: r for r in qp.merge_states(state, ["column_name"]).collect()}
    assert (merged["x"].row_count, merged["x"].null_count, merged["x"].max_value, merged["x"].n_unique) == (7, 2, 11.0, 5)


def test_empty_and_unknown_columns(spark, data):
    for d, rules in ((data.limit(0), RULES), (data, []), (data, [qp.ColumnRule("absent", "num")])):
        counts = qp.value_counts(d, rules, "load", "id")
        assert qp.metrics(qp.states(counts, rules), rules).count() == 0


def test_control_limits(spark):
    rows = [("s", "x", "mean", i, 10.0 + (i % 2)) for i in range(8)] + [("s", "x", "mean", 8, 30.0)]
    out = qp.control_limits(spark.createDataFrame(rows, "series string, column_name string, metric string, at int, value double"), "series", ["at"]).collect()
    assert [r.at for r in out if r.anomalous] == [8] and all(r.anomalous is None for r in out if r.at < 5)


def test_mean_and_deviation_are_of_exact_sums(spark):
    """Means that end in a 5 of the seventh decimal, equal values far from any range, far and tiny ones, infinite ones."""
    rules = [qp.ColumnRule("x", "num", 0.0, 20000.0), qp.ColumnRule("y", "num")]
    cents = [0.1 * i + 277.0 for i in range(319)]
    cents.append(round(320 * 292.2690625 - sum(cents), 4))
    wide = [1e20, 1e20, -1e20, 3.0, 5e-324, 1e300, -1e300, 0.0]
    y = {1: [45000.1] * 320, 2: wide, 3: [1e9, 1e9 + 1, 1e9 + 2], 4: [math.inf, 1.0], 5: [math.inf, -math.inf], 6: [7.5]}
    x = {1: cents}
    rows = [(1000 * k + i, k, x.get(k, [None] * 999)[i], v) for k, vs in y.items() for i, v in enumerate(vs)]
    counts = qp.value_counts(spark.createDataFrame(rows, "id long, load long, x double, y double"), rules, "load", "id")
    state = qp.states(counts, rules)
    m = {(r.load_id, r.column_name): (r.mean, r.std) for r in qp.metrics(state, rules).collect()}
    exact = sum(map(Fraction, cents))
    assert m[1, "x"][0] == float(exact / 320) and math.isclose(m[1, "x"][1], statistics.stdev(cents), rel_tol=1e-14)
    assert m[1, "y"] == (45000.1, 0.0) and m[3, "y"] == (1e9 + 1, 1.0) and m[6, "y"] == (7.5, None)
    assert m[2, "y"][0] == float(sum(map(Fraction, wide)) / 8) and math.isclose(m[2, "y"][1], 1e300 * math.sqrt(2 / 7), rel_tol=1e-14)
    assert m[4, "y"][0] == math.inf and math.isnan(m[4, "y"][1]) and math.isnan(m[5, "y"][0]) and m[2, "x"] == (None, None)
    some = state.where("load_id in (1, 3, 6)")
    merged = {r.column_name: r for r in qp.metrics(qp.merge_states(some, ["column_name"]), rules).collect()}
    want = y[1] + y[3] + y[6]
    assert merged["y"].mean == float(sum(map(Fraction, want)) / len(want)) and math.isclose(merged["y"].std, statistics.stdev(map(Fraction, want)), rel_tol=1e-14)
    assert merged["x"].row_count == merged["y"].row_count == 324 and merged["x"].null_count == 4 and merged["x"].mean == m[1, "x"][0]
