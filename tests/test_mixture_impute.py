import math

import numpy as np

from tessella.operators import mixture_impute as mi

NUM = [mi.NumericField("t", -10, 50)]
CAT = [mi.CategoryField("crop", ("okra", "basil"))]


def run(df, **kw):
    return mi.impute(df, key="id", group="g", numeric=NUM, categorical=CAT, time="at", **kw)


def test_marks_and_unfillable_cells(spark):
    nan = float("nan")
    rows = [
        (1, "a", 20.0, " OKRA ", None, 1), (2, "a", None, "okra", None, 1), (3, "a", nan, "n/a", None, 1), (3, "a", nan, "n/a", None, 1),
        (4, "b", 999.0, "", None, 1), (5, "b", None, "basil", None, 1), (6, None, None, None, None, 1), (7, "c", 5.0, "basil", None, 1),
    ]
    df = spark.createDataFrame(rows, "id long, g string, t double, crop string, at timestamp_ntz, _group int")
    out = {r.id: r for r in run(df).collect()}
    assert len(out) == 7
    assert sorted(out[3].filled) == ["crop", "t"] and out[3].crop == "okra" and abs(out[3].t - 20) < 3
    assert out[1].filled == [] and out[1].crop == "okra"
    assert out[4].filled == ["crop"] and out[4].t is None and out[5].filled == [] and out[6].filled == []
    assert {r.id for r in run(df, only_missing=True).collect()} == {2, 3, 4, 5}
    assert run(df.limit(0)).count() == 0


def test_held_out_accuracy_beats_group_means(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for g in range(200):
        crop = ("okra", "basil")[g % 2]
        level = (10 if crop == "okra" else 25) + rng.normal()
        for i in range(6):
            day = int(rng.integers(0, 100))
            value = float(level + 0.08 * (day - 50) + rng.normal() * 0.5)
            key = g * 10 + i
            hide = i == 0
            truth[key] = (value, crop)
            rows.append((key, g, None if hide else value, None if hide else crop, np.datetime64("2023-01-01") + np.timedelta64(day, "D")))
    df = spark.createDataFrame([(a, b, c, d, e.astype("datetime64[us]").item()) for a, b, c, d, e in rows], "id long, g long, t double, crop string, at timestamp_ntz")
    out = [r for r in run(df, only_missing=True).collect()]
    assert len(out) == 200 and all(r.crop == truth[r.id][1] for r in out)
    means = {}
    for k, g, v, _, _ in rows:
        means.setdefault(g, []).extend([] if v is None else [v])
    mine = math.sqrt(np.mean([(r.t - truth[r.id][0]) ** 2 for r in out]))
    plain = math.sqrt(np.mean([(np.mean(means[r.g]) - truth[r.id][0]) ** 2 for r in out]))
    assert mine < 0.6 * plain


def test_a_hot_group_is_salted(spark, monkeypatch):
    from tessella.operators import skew

    facts = spark.range(30_000).selectExpr("id as k", "cast(if(id % 3 = 0, 1, id) as bigint) as g")
    dims = facts.groupBy("g").count().withColumnRenamed("count", "w")
    monkeypatch.setattr(skew, "HOT_PARTS", 100)
    out = skew.salted_join(facts, dims, ["g"], "w", "k")
    assert out.count() == 30_000 and out.where("g = 1").select("w").distinct().count() == 1
