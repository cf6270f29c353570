import numpy as np
import pytest

from tessella.llm import vectors as v


def data(n=900, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 10):  # families of close vectors, of differing length
        for j in range(1, 4):
            x[i + j] = (x[i] + rng.normal(size=dim) * 0.12) * rng.uniform(0.1, 50)
    return x.astype(np.float32)


def brute(x, ids, k, least=-2.0):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    near = {}
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (-g[i, j], ids[j]))[:k]
        near[ids[i]] = {ids[j] for j in order if g[i, j] >= least}
    return near


def frame(spark, x, ids):
    nan, zero = float("nan"), [0.0] * x.shape[1]
    rows = [(int(i), [float(a) for a in r], 1) for i, r in zip(ids, x, strict=True)]
    odd = [(90_001, None, 1), (90_002, zero, 1), (90_003, [nan] * x.shape[1], 1), (90_004, [1.0], 1), (90_005, [], 1), (90_006, [None] * x.shape[1], 1)]
    return spark.createDataFrame(rows + rows[:5] + odd, "vec_id long, vec array<float>, cell int")


@pytest.mark.parametrize(("cell", "tile"), [(1500, 4096), (40, 30)])
def test_mutual_pairs(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(v, "CELL", cell)
    monkeypatch.setattr(v, "TILE", tile)
    x = data()
    ids = [i * 3 + 1 for i in range(len(x))]
    near = brute(x, ids, 5, 0.9)
    want = {(min(a, b), max(a, b)) for a in near for b in near[a] if a in near[b]}
    df = v.usable(frame(spark, x, ids), "vec_id", "vec", x.shape[1])
    assert df.count() == len(x)
    got = {tuple(r) for r in v.mutual_pairs(df, x.shape[1]).collect()}
    assert len(want) > 200 and got <= want and len(got) >= 0.98 * len(want)


def test_many_copies(spark):
    x = np.vstack([data(50), np.ones((40, 16), np.float32)])
    ids = list(range(len(x)))
    got = {tuple(r) for r in v.mutual_pairs(v.usable(frame(spark, x, ids), "vec_id", "vec", 16), 16).collect()}
    assert {p for p in got if p[0] >= 50} == {(a, b) for a in range(50, 56) for b in range(a + 1, 56)}


def test_top_k_recall(spark):
    x = data(3000)
    ids = list(range(len(x)))
    near = brute(x, ids, 5)
    df = v.usable(frame(spark, x, ids), "vec_id", "vec", 16)
    out = v.top_k(df.where("id % 100 = 0"), df, 16).collect()
    assert len(out) == 5 * 30 and all(r.id != r.query_id for r in out)
    assert sum(r.id in near[r.query_id] for r in out) / len(out) >= 0.9


def test_few_and_none(spark):
    one = v.usable(frame(spark, data(10)[:2], [1, 2]), "vec_id", "vec", 16)
    assert [tuple(r) for r in v.mutual_pairs(one, 16).collect()] == [(1, 2)]
    assert v.top_k(one, one, 16).count() == 2
    assert v.mutual_pairs(one.limit(0), 16).count() == 0 and v.top_k(one.limit(0), one.limit(0), 16).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = v.unit(data(2000))
    errors = []
    for beam in (1, 6):
        aq = v.AdditiveQuantiser.fit(x, 32, 3, 32, beam)
        codes = aq.encode(x)
        made = sum(b[codes[:, m]] for m, b in enumerate(aq.books))
        assert np.allclose(aq.norms(codes), (made * made).sum(1), atol=1e-4)
        errors.append(float(((x - made) ** 2).sum(1).mean()))
        assert np.allclose(aq.scores(x[:3], codes, aq.norms(codes)), x[:3] @ made.T / np.linalg.norm(made, axis=1), atol=1e-4)
    assert errors[1] < errors[0]


@pytest.mark.parametrize("tile", [8192, 500])
def test_dense_group_of_near_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(v, "CELL", 4_000)
    monkeypatch.setattr(v, "TILE", tile)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    near_copies = (centre + rng.normal(size=(2000, 64)) * 0.2) * rng.uniform(0.1, 50, size=(2000, 1))
    x = np.vstack([rng.normal(size=(1000, 64)), near_copies]).astype(np.float32)
    ids = list(range(len(x)))
    near = brute(x, ids, 5, 0.9)
    want = {(min(a, b), max(a, b)) for a in near for b in near[a] if a in near[b]}
    got = {tuple(r) for r in v.mutual_pairs(v.usable(frame(spark, x, ids), "vec_id", "vec", 64), 64).collect()}
    assert len(want) > 1000 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_scaled_copies_prefer_the_smallest_ids(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([data(50), rng.normal(size=16) * rng.uniform(0.1, 50, size=(300, 1))]).astype(np.float32)
    got = {tuple(r) for r in v.mutual_pairs(v.usable(frame(spark, x, list(range(len(x)))), "vec_id", "vec", 16), 16).collect()}
    assert {p for p in got if p[0] >= 50} == {(a, b) for a in range(50, 56) for b in range(a + 1, 56)}


def test_size_of_cells_changes_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 64))
    noise = rng.normal(size=(750, 64))
    noise -= (noise * x[::2]).sum(1, keepdims=True) / (x[::2] ** 2).sum(1, keepdims=True) * x[::2]
    x[1::2] = x[::2] + noise * (np.linalg.norm(x[::2], axis=1) / np.linalg.norm(noise, axis=1) * 0.48)[:, None]  # at a cosine of 0.9015
    df = v.usable(frame(spark, x.astype(np.float32), list(range(1500))), "vec_id", "vec", 64)
    found = []
    for cell in (10_000, 20):
        monkeypatch.setattr(v, "CELL", cell)
        monkeypatch.setattr(v, "TILE", cell)
        found.append({tuple(r) for r in v.mutual_pairs(df, 64).collect()})
    assert len(found[0]) >= 0.95 * 750 and found[0] == found[1]


@pytest.mark.parametrize("how", [{"exact": True}, {"exact": True, "block": 7}, {"block": 11, "cells": 20, "probes": 20}])
def test_top_k_in_blocks_and_exact(spark, how):
    """Blocks of stored vectors and of queries change nothing; an exact search finds what comparing all finds."""
    x = data(600)
    ids = list(range(len(x)))
    near = brute(x, ids, 5)
    df = v.usable(frame(spark, x, ids), "vec_id", "vec", 16)
    out = v.top_k(df.where("id % 10 = 0"), df, 16, **how).collect()
    assert len(out) == 5 * 60 and {(r.query_id, r.id) for r in out} == {(i, j) for i in range(0, 600, 10) for j in near[i]}


def test_binary_round_trip():
    import pyarrow as pa

    rows = np.arange(12, dtype="<f4").reshape(3, 4)
    column = pa.chunked_array([v._binary(rows[:2]), pa.nulls(2, pa.binary()), v._binary(rows[2:]), v._binary(rows[:0])])
    assert (v._rows(column, 4, "<f4") == rows).all() and v._rows(column.slice(1, 4), 4, "<f4").tolist() == rows[1:].tolist()


def test_classes_of_equal_vectors(spark, monkeypatch):
    from tessella.operators import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    x = np.vstack([data(20), np.ones((40, 16), np.float32), data(20)[:3]])
    df = v.usable(frame(spark, x, list(range(len(x)))), "vec_id", "vec", 16)
    got = {r.id: (r.class_id, r.n) for r in v.equal_vectors(df).collect()}
    want = {i: (i, 2 if i < 3 else 1) for i in range(20)} | {i: (20, 40) for i in range(20, 60)} | {60 + i: (i, 2) for i in range(3)}
    assert got == want and v.equal_vectors(df.limit(0)).count() == 0
    # such a vector's list is the smallest ids of its class
    out = v.top_k(df.where("id = 59"), df, 16, exact=True).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.rank)] == [20, 21, 22, 23, 24]


def test_bound_rules_out_nearly_all_pairs_but_no_similar_one():
    """Pairs of a cell that tables and exact vectors must look at are few, however many vectors it holds."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(4000, 64)) * np.linspace(1, 2, 64)
    x[1::2] = x[::2] + rng.normal(size=(2000, 64)) * np.linspace(0.1, 0.9, 2000)[:, None]
    x = v.unit(x)
    aq = v.AdditiveQuantiser.fit(x, 16, 6, 64, 2)
    at = v.nearest(x, aq.books[0], 1)[:, 0]
    x = x[at == np.bincount(at).argmax()]
    cos, most = x @ x.T, (rows := v.bounding(x, aq.axes())) @ rows.T
    assert (most >= cos - 1e-5).all() and rows.shape[1] == 33
    similar = cos >= 0.9
    assert similar.sum() > len(x) and (most >= 0.9 - 1e-4)[similar].all()
    left = ((most >= 0.9 - 1e-4) & ~similar).mean()
    assert left < 0.01 and aq.coded(aq.encode(x)).shape == x.shape


def test_parts_of_a_large_cell_meet_once(spark, monkeypatch):
    """Members of a dense cell in many parts have the neighbours that they have in one part, on both sides of a pair."""
    x = (np.ones(16) + np.random.default_rng(16).normal(size=(300, 16)) * 0.1).astype(np.float32)
    df = v.usable(frame(spark, x, list(range(300))), "vec_id", "vec", 16)
    near = brute(x, list(range(300)), 5, 0.9)
    for cell in (10_000, 20):
        monkeypatch.setattr(v, "CELL", cell)
        monkeypatch.setattr(v, "TILE", cell)
        edges = v.similar_pairs(df, 16).collect()
        assert {(r.a, r.b) for r in edges} == {(a, b) for a in near for b in near[a]} and len(edges) == 1500


def test_usable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    kept = [[1.0, 0.0], [0.0, -2.0], [-1.0, -0.0]]
    odd = [[0.0, -0.0], [1.0, None], [None, None], [None, nan], [nan, 1.0], [inf, 1.0], [1.0, -inf], [1.0], [1.0, 2.0, 3.0], [], None]
    df = spark.createDataFrame(list(enumerate(kept + odd)), "vec_id long, vec array<double>")
    assert sorted(r.id for r in v.usable(df, "vec_id", "vec", 2).collect()) == [0, 1, 2]
