import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import mixing as mx
from tessella.llm import packing as pk
from tessella.llm import splitting as sp
from tessella.llm import tokens

ENC = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
LENGTHS = tokens.lengths(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")


# --- packing ---------------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=5), st.integers(1, 40))
def test_fullest_is_optimal(counts, target):
    items = [n for n, c in counts.items() for _ in range(c)]
    best = max(sum(s) for k in range(len(items) + 1) for s in itertools.combinations(items, k) if sum(s) <= target)
    chosen = pk.fullest(counts, target)
    assert sum(n * k for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 1000), max_size=12))
def test_patterns_use_up_the_histogram(counts):
    patterns = pk.minimum_bin_slack(counts, 50)
    used = {}
    for p in patterns:
        assert 0 < p.filled <= 50
        for n, k in p.lengths.items():
            used[n] = used.get(n, 0) + k * p.times
    assert used == counts


def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["soil", "plot", "logger", "überprüft", "列"]) for _ in range(rng.randint(1, 60))), "s", 1) for i in range(300)]
    rows += [(1000 + i, "same text", "s", 1) for i in range(100)]
    return spark.createDataFrame([*rows, (5000, None, None, 1), (5001, "", "s", 1), (5002, "word " * 3000, "s", 1), (1, "again", "s", 1)], "doc_id long, text string, source string, n_tokens int")


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(pk, "RANKED", 7)
    out = pk.fill_containers(docs(spark), "doc_id", "text", 64).collect()
    filled = {}
    for r in out:
        if r.container_id is None:
            assert r.n_tokens == 0 and r.id in (5000, 5001)
        else:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
    total = sum(len(ENC.encode_ordinary(r.text or "")) for r in docs(spark).collect())
    assert max(filled.values()) <= 64 and sum(filled.values()) == total
    assert len(filled) <= math.ceil(total / 64) + 1
    big = sorted((r.part_no, r.token_start, r.n_tokens) for r in out if r.id == 5002)
    assert all(n == 64 for _, _, n in big[:-1]) and sum(n for _, _, n in big) == len(ENC.encode_ordinary("word " * 3000))
    assert len([r for r in out if r.id == 1]) == 2 and pk.fill_containers(docs(spark).limit(0), "doc_id", "text", 64).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------
def test_targets_and_frozen_sources():
    free = {"a": 9.0, "b": 9.0, "c": 9.0}
    like = {"a": 0.5, "b": 0.25, "c": 0.25}
    e, w, frozen = mx.temperature(like, like=like, most=free)
    assert e == pytest.approx(1, abs=1e-6) and w == pytest.approx(like) and not frozen
    e, w, frozen = mx.temperature(like, like=like, most=free | {"a": 0.2})  # the others take over in proportion
    assert w == pytest.approx({"a": 0.2, "b": 0.4, "c": 0.4}) and frozen == {"a"}
    _, w, frozen = mx.temperature({"a": 0.5, "b": 0.5}, like={"a": 0.5, "b": 0.5}, most={"a": 0.0, "b": 0.3})
    assert w == {"a": 0.0, "b": 0.3} and frozen == {"a", "b"}


def test_temperature():
    shares = {"a": 0.9, "b": 0.09, "c": 0.01, "d": 0.0}
    like = {"a": 0.6, "b": 0.3, "c": 0.1, "d": 0.0}
    e, w, _ = mx.temperature(shares, like=like, most={})
    assert mx.entropy(w) == pytest.approx(mx.entropy(like), abs=1e-6) and 0 < e < 1 and w["d"] == 0
    e, w, frozen = mx.temperature(shares, like=like, most={"c": 0.05})
    assert w["c"] == pytest.approx(0.05) and frozen == {"c"} and sum(w.values()) == pytest.approx(1)
    assert mx.entropy(mx.normalised({s: w[s] for s in "ab"})) == pytest.approx(mx.entropy(mx.normalised({s: like[s] for s in "ab"})), abs=1e-6)
    even = {s: 1 / 3 for s in "abc"}
    assert mx.temperature(shares, like=even, most={})[0] == 0.0
    assert mx.temperature({}, like={}, most={}) == (1.0, {}, set())


def test_natural_mixture(spark):
    df = spark.createDataFrame([(i, f"t{i} " + "x " * 20, "big" if i % 10 else "small") for i in range(400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 3), ("small", 0.3, 4)], "source string, target_share double, max_repeats int")
    m = mx.Mixture(df, targets, base="natural")
    assert m.weights == pytest.approx({"big": 0.7, "small": 0.3}, abs=1e-6) and 0 < m.exponent < 1
    shares = {r.source: r.share for r in m.report(m.rows()).collect()}
    assert shares == pytest.approx(m.weights, abs=0.02)
    with pytest.raises(ValueError):
        mx.Mixture(df, targets, base="else")


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, f"text {i} " + "word " * rng.randint(5, 30), "Big-One" if i % 3 else " big_one") for i in range(300)]
    rows += [(1000 + i, f"rare {i} " + "plot " * 10, "rare") for i in range(5)] + [(2000 + i, rows[0][1], "rare") for i in range(40)]
    rows += [(3000, None, "rare"), (3001, "unlisted words here", None), (3002, "", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big_one", 0.6, 2), ("rare", 0.3, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mx.Mixture(df, targets)
    used = m.rows().collect()
    by_id = {}
    for r in used:
        by_id[r.id] = by_id.get(r.id, 0) + 1
    assert max(n for i, n in by_id.items() if i < 1000) <= 2 and {by_id[1000 + i] for i in range(5)} == {4}
    assert not any(i >= 2000 for i in by_id)  # copies of a text count once, under its smallest key
    rep = {r.source: r for r in m.report(m.rows()).collect()}
    assert rep["rare"].tokens == rep["rare"].held_tokens * 4 and rep["none"].tokens == 0
    assert abs(rep["big_one"].tokens - rep["big_one"].budget_tokens) <= 40 and abs(sum(r.tokens for r in rep.values()) - m.total) < 0.05 * m.total
    blocks = {}
    for r in used:
        blocks.setdefault((r.source, r.block), []).append(r.id)
    assert all(len(b) == len(set(b)) for b in blocks.values())
    empty = mx.Mixture(df.limit(0), targets)
    assert empty.rows().count() == 0 and empty.report(empty.rows()).count() == 3


def test_hot_source_prefix_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mx, "PREFIX", 3)
    df = spark.createDataFrame([(i, f"t{i} " + "x " * (i % 7)) for i in range(200)], "doc_id long, text string").selectExpr("*", "'s' as source")
    m = mx.Mixture(df, spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int"), total=1000)
    assert abs(sum(r.n_tokens for r in m.rows().collect()) - 1000) <= 8


# --- splitting -------------------------------------------------------------------------------------------------
def check(text, limit, overlap):
    codes = ENC.encode_ordinary(text)
    out = sp.Splitter(ENC, LENGTHS, limit, overlap).pieces(text, codes)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for a, b, size, _, _ in out:
        assert 0 < size <= limit and size == len(ENC.encode_ordinary(text[a:b]))
    for (a0, b0, *_), (a1, b1, _, shared, _) in zip(out, out[1:], strict=False):
        assert a0 <= a1 <= b0 < b1 and overlap <= shared <= overlap + 3
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t.#'s7é列、🎉-\u3000\x1c"), min_size=80, max_size=400), st.integers(8, 30))
def test_pieces_cover_any_text(text, limit):
    if len(ENC.encode_ordinary(text)) > limit:
        check(text, limit, min(3, limit - 5))


def test_natural_boundaries_come_first():
    para = "Soil was dry. The logger stopped again. Nobody came."
    text = "\n\n".join([para] * 12)
    out = check(text, 60, 8)
    assert all(k in ("paragraph", "end") for *_, k in out)
    flat = check(" ".join([para] * 12), 60, 8)
    assert all(k in ("sentence", "end") for *_, k in flat)
    assert {k for *_, k in check("plot " * 400, 60, 8)} <= {"word", "end"}
    assert {k for *_, k in check("列" * 900, 60, 8)} <= {"character", "end"}
    md = "# One\n" + para + "\n# Two\n" + para
    assert check(md, 24, 4)[0][4] == "section"


def test_split_frame(spark):
    out = sp.split_oversized(docs(spark), "doc_id", "text", 50, 10).collect()
    assert {r.id for r in out} >= {5002} and not {5000, 5001} & {r.id for r in out}
    assert max(r.n_tokens for r in out) <= 50
    every = sp.split_oversized(docs(spark), "doc_id", "text", 50, 10, all_texts=True)
    assert every.select("id").distinct().count() == 401 and sp.split_oversized(docs(spark).limit(0), "doc_id", "text", 50, 10).count() == 0
