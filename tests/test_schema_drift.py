import json

from tessella.operators import schema_drift as sd


def records(spark, files):
    rows = [(i, f, json.dumps(r) if isinstance(r, dict) else r) for f, rs in files.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "record_id long, file_id long, body string")


def feed(spark, n):
    return spark.createDataFrame([(i, 1, i, "train") for i in range(1, n + 1)], "file_id long, feed_id long, seq_no int, file string")


def ledger(records, files):
    return sd.drift_ledger(sd.rescued_records(records, "body", "rec_key", ["file_id"]), files)


def test_renames_that_qualify_and_keys_that_are_no_texts(spark):
    """Two names with the same values both qualify; a new field that differs in one common key doesn't. A field that is
    renamed to a name once held with another kind is retyped as well, one that comes back after a gap isn't."""
    r = records(spark, {
        1: [{"rec_key": 1, "a": "v", "b": 2, "k": 1}, {"rec_key": 2, "a": "w", "b": None, "k": 1}],
        2: [{"rec_key": 1, "c": "v", "d": "v", "b": 2}, {"rec_key": 2, "c": "w", "d": "w", "e": "x"}],
        3: [{"rec_key": 2, "c": "w", "d": "w", "e": "x", "a": "w", "k": "1"}],
    })
    got = {tuple(x) for x in ledger(r, feed(spark, 3)).collect()}
    assert got == {
        (2, "renamed", "a", "c"), (2, "renamed", "a", "d"), (2, "removed", "k", ""), (2, "added", "", "e"),
        (3, "removed", "b", ""), (3, "added", "", "a"), (3, "added", "", "k"),
    }


def test_ledger(spark):
    r = records(spark, {
        1: [{"rec_key": "a", "x": 1, "t": "1", "gone": 5}, {"rec_key": "b", "x": None, "t": None}, {"rec_key": "b", "x": None, "t": None}],
        2: [{"rec_key": "a", "X": 1, "t": 1, "new": 6}, {"rec_key": "b", "t": 2}, {"rec_key": "z", "X": 9}],
        3: [{"rec_key": "q", "X": None, "t": None}],
        4: [{"rec_key": "q", "X": [1], "t": True, "x": True}, None, "{broken", "[1]"],
    })
    got = {tuple(x) for x in ledger(r, feed(spark, 5)).collect()}
    assert got == {
        (2, "renamed", "x", "X"), (2, "retyped", "t", "t"), (2, "removed", "gone", ""), (2, "added", "", "new"),
        (3, "removed", "new", ""), (4, "retyped", "X", "X"), (4, "retyped", "t", "t"), (4, "added", "", "x"),
        (5, "removed", "X", ""), (5, "removed", "t", ""), (5, "removed", "x", ""),
    }


def test_empty(spark):
    assert ledger(records(spark, {1: [{"rec_key": "a"}]}).limit(0), feed(spark, 2)).count() == 0


def test_rescue_promote_replay_keeps_everything(spark):
    r = records(spark, {1: [{"rec_key": "a", "n": 5, "s": 'q"uote', "k": "7", "deg": 1.5}, {"rec_key": "b", "n": "five", "s": 3, "deg": None}, "oops", None]})
    schema = sd.TargetSchema({"n": "bigint", "s": "string", "file_id": "bigint"})
    first = sd.ingest(r, "body", schema, ["record_id", "file_id"])
    a, b, broken, none = sorted(first.collect(), key=lambda x: x.record_id)
    assert (a.n, a.s, a.source_file_id, json.loads(a._rescued)) == (5, 'q"uote', 1, {"rec_key": "a", "k": "7", "deg": 1.5})
    assert (b.n, b.s, json.loads(b._rescued)) == (None, None, {"rec_key": "b", "n": "five", "s": 3})
    assert (broken._broken, broken._rescued, none._broken) == ("oops", None, None)
    again = sd.replay(first, schema.promote({"k": "bigint", "temp": "double"}, {"deg": "temp"}), ["record_id"])
    a = next(x for x in again.collect() if x.record_id == 0)
    assert (a.n, a.s, a.k, a.temp, json.loads(a._rescued)) == (5, 'q"uote', 7, 1.5, {"rec_key": "a"})


def test_aliases_follow_unambiguous_renames(spark):
    pairs = [("air_c", "AirC"), ("AirC", "t2"), ("lux", "light_lux"), ("air_c", "col_1"), ("col_1", "light_lux"), ("x", "y")]
    ledger = spark.createDataFrame([(1, "renamed", a, b) for a, b in pairs] + [(1, "added", "", "air_c")], "file_id long, change_kind string, old_field string, new_field string")
    assert sd.approved_aliases(ledger, {"air_c": "double", "light_lux": "bigint"}) == {"AirC": "air_c", "t2": "air_c", "lux": "light_lux"}


def test_whole_table_types_every_field_under_all_its_names(spark, tmp_path):
    from tessella.plans import problems

    body = {1: {"air_c": 1.5, "tags": ["a", "b"], "rain_mm": 2.0}, 2: {"AirC": 1.5, "tags": "a", "rain_mm": [2.0]}, 3: {"AirC": 7.0, "air_c": 8.0, "plot_no": "4"}}
    records(spark, {f: [{"rec_key": "k"} | b] for f, b in body.items()}).write.parquet(str(tmp_path / "file_records.parquet"))
    feed(spark, 3).write.parquet(str(tmp_path / "split_files.parquet"))
    got = {r.file_id: r for r in problems.p3_table(spark, str(tmp_path)).collect()}
    assert (got[1].air_c, got[1].tags, got[1].rain_mm, got[1]._rescued, got[1].rec_key) == (1.5, ["a", "b"], 2.0, None, "k")
    assert (got[2].air_c, got[2].tags, json.loads(got[2]._rescued)) == (1.5, None, {"tags": "a", "rain_mm": [2]})
    # of two names in one record the other value stays rescued
    assert (got[3].air_c, got[3].plot_no, json.loads(got[3]._rescued)) == (8.0, "4", {"AirC": 7})
    assert len(problems.WHOLE_SCHEMA.columns) == 18
