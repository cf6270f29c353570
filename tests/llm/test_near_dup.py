import random

import numpy as np
import pytest

from tessella.llm import near_dup as nd
from tessella.llm import sketches as sk


def sets_of(rng, n, low, high):
    return [rng.integers(0, 2**63, rng.integers(low, high), dtype=np.uint64) for _ in range(n)]


@pytest.mark.parametrize("method", [sk.minwise, sk.fast_similarity])
def test_sketches_estimate_jaccard(method):
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 60, dtype=np.uint64)
    more = rng.integers(0, 2**63, 40, dtype=np.uint64)
    a, b = np.concatenate([shared, more[:20]]), np.concatenate([shared, more[20:]])
    s = method(np.concatenate([a, b]), np.array([0, len(a)]), 2000)
    assert abs((s[0] == s[1]).mean() - 60 / 100) < 0.05
    again = method(np.concatenate([b[::-1], a]), np.array([0, len(b)]), 2000)
    assert (again[0] == s[1]).all() and (again[1] == s[0]).all()


def test_fast_similarity_fills_every_bin_of_tiny_sets():
    v = np.array([5, 9, 11], dtype=np.uint64)
    s = sk.fast_similarity(v, np.array([0, 1]), 300)
    assert not (s == sk.EMPTY).any()
    assert sk.fast_similarity(np.array([], np.uint64), np.array([], np.int64), 4).shape == (0, 4)


def test_pack_round_trip():
    h = np.sort(np.array([1, 2, 2, 2**40 - 1], np.uint64))
    ids, flags = np.array([0, 5, 2**62, 7], np.int64), np.array([0, 1, 2, 3], np.uint8)
    maps, sizes = np.array([1, 2**56 - 1, 0, 9], np.uint64), np.array([30, sk.LONG, 1, 300])
    got = sk.unpack(sk.pack(h, ids, flags, maps, sizes))
    for x, y in zip(got, (h, ids, flags, maps, sizes), strict=True):
        assert x.tolist() == y.tolist()


def notes(seed=5, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = ["the", "a", "of", "and"]
    texts = []
    for _ in range(n):
        texts.append([*rng.sample(vocabulary, 14), *common])
    for i in range(0, n, 4):  # edits
        t = list(texts[i])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(t)
    return texts


def brute(rows, cross):
    sets = {i: (s, frozenset(t.lower().split())) for i, s, t in rows if t and len(set(t.lower().split())) >= 10}
    out = set()
    for i, (a, x) in sets.items():
        for j, (b, y) in sets.items():
            if i < j and (not cross or (a == "train") != (b == "train")) and len(x & y) >= 0.7 * len(x | y) - 1e-9:
                out.add((i, j))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, rng.choice(["train", "train", "val", "test"]), " ".join(t)) for i, t in enumerate(notes())]
    copies = [(9000 + i, "train" if i % 2 else "val", out[3][2].upper()) for i in range(30)]
    return out + copies + [(8000, "train", None), (8001, "val", ""), (8002, "train", "too short"), (8003, "val", "too short")]


@pytest.fixture
def frame(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, dataset string, note string")
    return df.unionByName(df.where("row_id < 50")).selectExpr("*", "1 as id", "'x' as w", "2 as flag")


def test_cross_split_pairs(frame, rows):
    got = [tuple(r) for r in nd.cross_split_pairs(frame, "row_id", "note", "dataset").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, True)


@pytest.mark.parametrize(("star", "limit"), [(64, nd.LIMIT), (2, nd.LIMIT), (2, 3)])
def test_groups(frame, rows, star, limit, monkeypatch):
    monkeypatch.setattr(nd, "STAR", star)
    monkeypatch.setattr(nd, "LIMIT", limit)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in brute(rows, False):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(find(i), i) for i in root}
    got = [(r.group_id, r.id) for r in nd.near_duplicate_groups(frame, "row_id", "note").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("how", ["long", "string"])
def test_keys_of_any_size_and_type(spark, rows, how):
    """No bit of a key is lost, and keys need not be numbers."""
    big = [(2**61 + i if how == "long" else f"k{i:05d}", s, t) for i, s, t in rows]
    df = spark.createDataFrame(big, f"row_id {how}, dataset string, note string")
    got = {tuple(r) for r in nd.cross_split_pairs(df, "row_id", "note", "dataset").collect()}
    assert got == {(big_of(a, how), big_of(b, how)) for a, b in brute(rows, True)}


def big_of(i, how):
    return 2**61 + i if how == "long" else f"k{i:05d}"


def test_parts_and_crowded_buckets(frame, rows, monkeypatch):
    """Many small parts, and buckets that are banded again, change nothing."""
    monkeypatch.setattr(nd, "PART", 500)
    monkeypatch.setattr(nd, "LIMIT", 2)
    monkeypatch.setattr(nd, "STAR", 2)
    monkeypatch.setattr(nd, "BLOCK", 100)
    got = [tuple(r) for r in nd.cross_split_pairs(frame, "row_id", "note", "dataset").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, True)


def test_links_of_rows(frame, rows):
    """One row per row with a partner: its class and the number of its partners, copies included."""
    want = {}
    for a, b in brute(rows, True):
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    got = nd.cross_split_links(frame, "row_id", "note", "dataset").collect()
    assert len(got) == len(want) and {r.key: r.n_links for r in got} == want
    assert all(r.class_id <= r.key for r in got) and {r.class_id for r in got if r.key >= 9000} == {3}


def test_hot_classes_are_joined_in_parts(frame, rows, monkeypatch):
    from tessella.operators import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    got = [tuple(r) for r in nd.cross_split_pairs(frame, "row_id", "note", "dataset").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, True)
    assert nd.near_duplicate_groups(frame, "row_id", "note").where("group_id = 3").count() >= 31


def test_shared_frequent_words_and_few_rare_ones(spark):
    """Pairs that share 24 frequent and 3 rare words, one side holding 5 rare words more: 27 of 32."""
    often = [f"often{i}" for i in range(24)]
    rows = []
    for i in range(20):
        rare = [f"r{i}x{j}" for j in range(3)]
        rows += [(i, "train", " ".join(often + rare)), (100 + i, "val", " ".join(often + rare + [f"m{i}x{j}" for j in range(5)]))]
    rng = random.Random(1)
    rows += [(1000 + i, "train", " ".join(rng.sample(often, 18) + [f"z{i}y{j}" for j in range(12)])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, dataset string, note string")
    got = {tuple(r) for r in nd.cross_split_pairs(df, "row_id", "note", "dataset").collect()}
    want = brute(rows, True)
    assert {(i, 100 + i) for i in range(20)} <= got <= want and len(got) >= 0.995 * len(want)


def test_empty(spark, frame):
    assert nd.cross_split_pairs(frame.limit(0), "row_id", "note", "dataset").count() == 0
    assert nd.near_duplicate_groups(frame.where("row_id = 8000"), "row_id", "note").count() == 0


def test_large_texts_of_frequent_words_are_sketched_whole(spark):
    base = [f"k{i}" for i in range(40)]
    df = spark.createDataFrame([(i, " ".join([*base, *(f"v{i}_{j}" for j in range(i % 3))])) for i in range(60)], "row_id long, note string")
    got = nd.near_duplicate_groups(df, "row_id", "note").collect()
    assert len(got) == 60 and {r.group_id for r in got} == {0}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    got = {r.id: r.root for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}


def hot_rows():
    """A note copied into a third of the rows, beside copies of it with 8 or more new words and unrelated notes."""
    rng = random.Random(4)
    hot = [f"h{i}" for i in range(40)]
    out = [(i, "train" if i % 2 else "val", " ".join(hot)) for i in range(100)]
    out += [(200 + i, "train" if i % 2 else "val", " ".join([*hot, *(f"e{i}x{j}" for j in range(8 + i % 5))])) for i in range(60)]
    out += [(400 + i, "train" if i % 2 else "val", " ".join(rng.sample([f"w{j}" for j in range(3000)], 20))) for i in range(140)]
    return out


def test_edited_copies_of_a_hot_note(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "row_id long, dataset string, note string")
    got = {tuple(r) for r in nd.cross_split_pairs(df, "row_id", "note", "dataset").collect()}
    want = brute(rows, True)
    assert got <= want and len(got) >= 0.995 * len(want)
    assert any(a >= 200 for a, b in want) and {p for p in got if p[0] < 100 <= p[1]} == {p for p in want if p[0] < 100 <= p[1]}
    groups = nd.near_duplicate_groups(df, "row_id", "note").collect()
    assert {r.id for r in groups if r.group_id == 0} == {i for i, _, _ in rows if i < 400}


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for _ in range(200):
        a, b = rng.choice(pool, 30, replace=False), rng.choice(pool, 25, replace=False)
        maps = sk.parity(np.concatenate([a, b]), np.array([0, 30]))
        assert np.bitwise_count(maps[0] ^ maps[1]) <= len(set(a.tolist()) ^ set(b.tolist()))
