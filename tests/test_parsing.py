import csv
import random
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import parsing as p

G = p.RecordGrammar(p.TRAIN_EXPORT)
GOOD = '1,2,2023-01-01 00:00:00,okra,1.5e-1,100,true,"a ""b"", c"'


def first(text):
    return next(G.parse(text)).reason


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (GOOD, None),
        ("1,2,,,,,,", None),
        ('"1","2","","","","","",""', None),
        ("1,2,,,,,", "columns"),
        ("", "columns"),
        ("1,2,,,,,,,", "columns"),
        ('1,2,,,,,,"open', "quoting"),
        ('1,2,,,,,,a"b', "quoting"),
        ('1,2,,,,,,"a"b', "quoting"),
        ("1,2,,,,,,a\nb", "quoting"),
        ('1,2,,,,,,"a\nb"', None),
        ('"1,2', "quoting"),
        (",2,,,,,,", "value"),
        ("1,,,,,,,", "value"),
        ("1234567890123456789,2,,,,,,", "value"),
        ("1,2,2023-02-29 00:00:00,,,,,", "value"),
        ("1,2,2023-01-01 24:00:00,,,,,", "value"),
        ("1,2,2023-01-01 00:00:60,,,,,", "value"),
        ("1,2,2023-1-01 00:00:00,,,,,", "value"),
        ("1,2,,,1.,,,", "value"),
        ("1,2,,,+1.0E5,,,", None),
        ("1,2,,,2 ,,,", "value"),
        ("1,2,,,,101,,", "value"),
        ("1,2,,,,007,,", None),
        ("1,2,,,,,True,", "value"),
        ("１,2,,,,,,", "value"),
    ],
)
def test_reasons(text, reason):
    assert first(text) == reason


def test_errors_are_located():
    assert next(G.parse('1,"2",,,2 ,,,')).pos == 8 and next(G.parse('1,2,,,,,,a"b')).pos == 10


def test_recovery_resumes_at_a_valid_record_start():
    text = '1,2,,,,,,"open\nnot a start\n3,4,,,,,,x\n5,6,,,,,,y'
    found = list(G.parse(text))
    assert [r.reason for r in found] == ["quoting", None, None]
    assert found[0].pos == 9 and [r.fields[0] for r in found[1:]] == ["3", "5"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a",\n\r é0', max_size=6), min_size=1, max_size=5))
def test_round_trip_with_a_writer(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    got, end = G.record(out.getvalue(), 0)
    assert got == fields and end == len(out.getvalue())


def test_rows_with_nulls_long_texts_and_clashing_names(spark):
    long = "1,2,,,,,," + "x" * 300_000
    df = spark.createDataFrame([(1, GOOD, 7), (2, None, 7), (3, "", 7), (4, long, 7), (4, long, 7)], "row_id long, raw string, parsed int")
    out = p.parse_records(df, "raw", p.TRAIN_EXPORT)
    good = p.valid_records(out, "row_id").collect()
    assert sorted(r.key_row_id for r in good) == [1, 4, 4]
    assert next(r for r in good if r.key_row_id == 1).note == 'a "b", c'
    assert sorted((r.row_id, r.reason) for r in p.rejected_records(out, "row_id").collect()) == [(2, "columns"), (3, "columns")]
    assert p.valid_records(p.parse_records(df.limit(0), "raw", p.TRAIN_EXPORT), "row_id").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(GOOD + '\n2,3,,,,,,"broken\n4,5,,,,,,z\n')
    out = p.parse_files(spark, str(tmp_path), p.TRAIN_EXPORT).collect()
    assert sorted((r.reason or "", r.record.row_id if r.record else 0) for r in out) == [("", 1), ("", 4), ("quoting", 0)]


def test_files_in_splits(spark, tmp_path):
    """Records that cross the ends of splits, broken quotes and splits without any anchor change nothing."""
    rng = random.Random(3)
    rows, want = [], 0
    for i in range(1, 400):
        kind = rng.random()
        note = "plain" if kind < 0.5 else '"two\nlines ""of"" it"' if kind < 0.7 else '"' + "long\n" * rng.randint(50, 200) + '"' if kind < 0.75 else '"broken' if kind < 0.85 else "x"
        rows.append(f"{i},{i % 7},,,,,,{note}" if kind < 0.95 else f"{i},7,a")
        want += kind < 0.75 or 0.85 <= kind < 0.95
    (tmp_path / "a.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "b.csv").write_text(rows[0])
    (tmp_path / "c.csv").write_text("")

    def found():
        return sorted(((r.path[-5:], r.reason, r.record) for r in p.parse_files(spark, str(tmp_path), p.TRAIN_EXPORT).collect()), key=repr)

    whole = found()
    assert sum(r.reason is None for r in p.parse_files(spark, str(tmp_path / "a.csv"), p.TRAIN_EXPORT).collect()) == want
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("200", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert found() == whole
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
