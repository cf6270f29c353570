"""Rows that fail to parse: a delimited-record grammar that recovers from errors.

The grammar is a recursive descent over one text::

    record := field ("," field)* end
    field  := quoted | bare
    quoted := '"' ( char | '""' )* '"'          # must be followed by "," or the end
    bare   := ( any but '"' "," CR LF )*

A broken quote is a located syntax error.  The parser then looks for the next *anchor*: a line start at which the
required leading fields of the schema validate, and resumes there, so that records swallowed by a broken quote are
still recovered.  Each record gets the first reason that applies: ``quoting``, ``columns``, ``value``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import written

BARE = re.compile(r'[^",\r\n]*')
LINE = re.compile(r"\r\n|\n|\r")
OPEN = "quote is never closed"


def _real_datetime(text: str) -> bool:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", text):
        return False
    try:
        datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return False
    return not text.endswith(("60", "61"))


_DECIMAL = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_KEY = re.compile(r"[0-9]{1,18}")
_PERCENT = re.compile(r"[0-9]{1,3}")

#: kind -> (check of a non-empty value, Spark type of the typed field)
KINDS = {
    "key": (lambda s: _KEY.fullmatch(s) is not None, T.LongType()),
    "datetime": (_real_datetime, T.TimestampNTZType()),
    "decimal": (lambda s: _DECIMAL.fullmatch(s) is not None, T.DoubleType()),
    "percent": (lambda s: _PERCENT.fullmatch(s) is not None and int(s) <= 100, T.IntegerType()),
    "bool": (lambda s: s in ("true", "false"), T.BooleanType()),
    "text": (lambda s: True, T.StringType()),
}


@dataclass(frozen=True)
class FieldRule:
    name: str
    kind: str = "text"
    required: bool = False

    def accepts(self, value: str) -> bool:
        return not self.required if value == "" else KINDS[self.kind][0](value)


class SyntaxFault(Exception):
    def __init__(self, message: str, pos: int):
        super().__init__(message)
        self.message, self.pos = message, pos


@dataclass
class Parsed:
    """One record of a text, or one located error."""

    start: int
    fields: list[str] | None = None
    reason: str | None = None
    message: str | None = None
    pos: int | None = None


class RecordGrammar:
    def __init__(self, rules: list[FieldRule]):
        self.rules = rules
        lead = 0
        while lead < len(rules) and rules[lead].required:
            lead += 1
        self.lead = max(1, lead)

    # --- the grammar -------------------------------------------------------------------------------------------
    def record(self, text: str, pos: int) -> tuple[list[str], int]:
        value, pos = self.field(text, pos)
        fields = [value]
        while pos < len(text) and text[pos] == ",":
            value, pos = self.field(text, pos + 1)
            fields.append(value)
        return fields, pos

    def field(self, text: str, pos: int) -> tuple[str, int]:
        return self.quoted(text, pos) if text.startswith('"', pos) else self.bare(text, pos)

    def bare(self, text: str, pos: int) -> tuple[str, int]:
        end = BARE.match(text, pos).end()
        if text.startswith('"', end):
            raise SyntaxFault("quote inside an unquoted field", end)
        return text[pos:end], end

    def quoted(self, text: str, opened: int) -> tuple[str, int]:
        parts, pos = [], opened + 1
        while True:
            end = text.find('"', pos)
            if end < 0:
                raise SyntaxFault(OPEN, opened)
            parts.append(text[pos:end])
            if not text.startswith('"', end + 1):
                break
            parts.append('"')
            pos = end + 2
        end += 1
        if end < len(text) and text[end] not in ",\r\n":
            raise SyntaxFault("text after a closing quote", end)
        return "".join(parts), end

    # --- recovery ----------------------------------------------------------------------------------------------
    def anchor(self, text: str, pos: int) -> int | None:
        """Start of the next line whose required leading fields validate."""
        for brk in LINE.finditer(text, pos):
            at, ok = brk.end(), True
            try:
                for rule in self.rules[: self.lead]:
                    value, at = self.field(text, at)
                    ok = ok and rule.accepts(value) and text.startswith(",", at)
                    at += 1
            except SyntaxFault:
                ok = False
            if ok:
                return brk.end()
        return None

    def parse(self, text: str, single: bool = True) -> Iterator[Parsed]:
        """All records of ``text``. ``single``: the text ought to be one record, so a line break outside quotes is
        an error of the record."""
        pos: int | None = 0
        while pos is not None:
            start = pos
            try:
                fields, pos = self.record(text, start)
                if pos < len(text) and single:
                    raise SyntaxFault("line break outside quotes", pos)
            except SyntaxFault as fault:
                yield Parsed(start, None, "quoting", fault.message, fault.pos)
                pos = self.anchor(text, start)
                single = False  # what follows a broken record are lines
                continue
            yield self.validated(text, start, fields)
            pos = LINE.match(text, pos).end() if pos < len(text) else None
            if pos is not None and pos >= len(text):
                pos = None

    def validated(self, text: str, start: int, fields: list[str]) -> Parsed:
        if len(fields) != len(self.rules):
            return Parsed(start, fields, "columns", f"{len(fields)} fields, not {len(self.rules)}", start)
        for i, (rule, value) in enumerate(zip(self.rules, fields, strict=True)):
            if not rule.accepts(value):
                return Parsed(start, fields, "value", f"{rule.name} is not a {rule.kind}", self.place(text, start, i))
        return Parsed(start, fields)

    def place(self, text: str, start: int, field: int) -> int:
        """Where a field of a well-formed record begins; walked again only for records with an error."""
        pos = start
        for _ in range(field):
            pos = self.field(text, pos)[1] + 1
        return pos


def parse_records(df: DataFrame, text: str, rules: list[FieldRule]) -> DataFrame:
    """Parse one record per row of ``df[text]``.

    Adds ``parsed``, a struct of ``reason`` (null for a valid record), ``message``, ``pos`` (character of the
    error), ``record`` (the typed fields, null unless valid) and ``recovered`` (typed records found at anchors after a
    broken quote). All other input columns stay, whatever their names; one called ``parsed`` is replaced. A null text holds no field and so fails as
    ``columns``; an empty text is one empty field. Numbers beyond double range become infinite. No row is dropped.
    """
    names = [r.name for r in rules]
    raw = T.ArrayType(T.StringType())
    out = T.StructType(
        [
            T.StructField("reason", T.StringType()),
            T.StructField("message", T.StringType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("fields", raw),
            T.StructField("recovered", T.ArrayType(raw)),
        ]
    )

    @F.pandas_udf(out)
    def run(texts: pd.Series) -> pd.DataFrame:
        grammar = RecordGrammar(rules)
        rows = []
        for t in texts:
            if t is None:
                rows.append(("columns", "no text", 0, None, []))
                continue
            first, *rest = grammar.parse(t)
            found = [p.fields for p in rest if p.reason is None]
            rows.append((first.reason, first.message, first.pos, None if first.reason else first.fields, found))
        done = pd.DataFrame(rows, columns=out.names)
        done["pos"] = done["pos"].astype("Int32")
        return done

    def typed(fields: Column) -> Column:
        cells = []
        for i, rule in enumerate(rules):
            cell = F.nullif(F.get(fields, F.lit(i)), F.lit(""))
            cells.append(cell.cast(KINDS[rule.kind][1]).alias(names[i]))
        return F.struct(*cells)

    one = df.withColumn("parsed", run(F.col(f"`{text}`")))
    p = F.col("parsed")
    return one.withColumn(
        "parsed",
        F.struct(
            p["reason"].alias("reason"),
            p["message"].alias("message"),
            p["pos"].alias("pos"),
            F.when(p["fields"].isNotNull(), typed(p["fields"])).alias("record"),
            F.transform(p["recovered"], typed).alias("recovered"),
        ),
    )


def valid_records(parsed: DataFrame, key: str) -> DataFrame:
    """Typed rows of the valid records, beside their key, which is called ``key_<name>`` if a field has its name."""
    fields = [f.name.lower() for f in parsed.schema["parsed"].dataType["record"].dataType]
    name = f"key_{key}" if key.lower() in fields else key
    return parsed.where("parsed.reason is null").select(F.col(f"`{key}`").alias(name), "parsed.record.*")


def rejected_records(parsed: DataFrame, key: str) -> DataFrame:
    """Records that break the contract with reason, message and place of the error."""
    return parsed.where("parsed.reason is not null").select(
        F.col(f"`{key}`"), "parsed.reason", "parsed.message", "parsed.pos", F.size("parsed.recovered").alias("n_recovered")
    )


def parse_files(spark, paths: str | list[str], rules: list[FieldRule]) -> DataFrame:
    """Parse export files of many records each, UTF-8, of any size. One row per record or located error: ``path,
    block, start, pos, reason, message, record``; ``start`` and ``pos`` count characters within the block, which is the
    byte the split begins at.

    A file is read in splits. Within a split the records from its first anchor on are parsed at once; what stands before
    it belongs to a record of the split before, and a quote that is still open at the end, without any anchor behind it,
    to the split after. These ends, one pair a split, are put together per file and parsed in a second step. Lines that
    hold nothing are no records. An empty file gives no row."""
    lines = spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    out = "path string, block long, start long, pos long, reason string, message string, fields array<string>"
    names = ["path", "block", "start", "pos", "reason", "message", "fields"]

    def rows_of(grammar, text, path, block, offset):
        for p in grammar.parse(text, single=False):
            if p.reason is None and p.fields == [""]:
                continue
            yield path, block, p.start + offset, None if p.pos is None else p.pos + offset, p.reason, p.message, None if p.reason else p.fields

    def blocks(batches):
        key, held = None, []
        for pdf in batches:
            for value, path, block in zip(pdf["value"], pdf["path"], pdf["block"], strict=True):
                if key != (path, block):
                    if key is not None:
                        yield *key, "\n".join(held)
                    key, held = (path, block), []
                held.append(value)
        if key is not None:
            yield *key, "\n".join(held)

    def frame(rows, *ends):
        """Parsed rows, and the ends of a split as one more."""
        done = pd.DataFrame([(*r, None, None, True) for r in rows] + [(path, block, *[None] * 5, head, tail, anchored) for path, block, head, tail, anchored in ends], columns=[*names, "head", "tail", "anchored"])
        return done.astype({"start": "Int64", "pos": "Int64"})

    def first(batches):
        grammar = RecordGrammar(rules)
        for path, block, text in blocks(batches):
            at = 0 if block == 0 else grammar.anchor("\n" + text, 0)
            if at is None:
                yield frame([], (path, block, text, None, False))
                continue
            at = max(0, at - 1) if block else 0
            rows, tail = [], None
            for row in rows_of(grammar, text[at:], path, block, at):
                rows.append(row)
                if len(rows) == 10_000:
                    yield frame(rows[:-1])
                    rows = rows[-1:]
            # the grammar goes on at an anchor; only an open quote without one is the last thing it reports
            if rows and rows[-1][5] == OPEN:
                tail = text[rows.pop()[2] :]
            yield frame(rows, (path, block, text[:at].removesuffix("\n") if at else None, tail, True))

    parsed = written(lines.mapInPandas(first, f"{out}, head string, tail string, anchored boolean"), "parsed")
    whole = parsed.where("start is not null").select(*names)

    def second(pdf):
        grammar, rows, carry, since = RecordGrammar(rules), [], [], 0
        for r in pdf.sort_values("block").itertuples():
            carry += [] if r.head is None else [r.head]
            if not r.anchored:
                continue
            if carry:
                rows += rows_of(grammar, "\n".join(carry), r.path, since, 0)
            carry, since = ([] if r.tail is None else [r.tail]), r.block
        if carry:
            rows += rows_of(grammar, "\n".join(carry), pdf["path"].iloc[0], since, 0)
        return pd.DataFrame(rows, columns=names).astype({"start": "Int64", "pos": "Int64"})

    ends = parsed.where("start is null").select("path", "block", "head", "tail", "anchored")  # one row a split
    cells = [
        F.nullif(F.get("fields", F.lit(i)), F.lit("")).cast(KINDS[r.kind][1]).alias(r.name) for i, r in enumerate(rules)
    ]
    return whole.unionByName(ends.groupBy("path").applyInPandas(second, out)).select(
        "path", "block", "start", "pos", "reason", "message", F.when(F.col("fields").isNotNull(), F.struct(*cells)).alias("record")
    )


TRAIN_EXPORT = [
    FieldRule("row_id", "key", True),
    FieldRule("device_id", "key", True),
    FieldRule("observed_at", "datetime"),
    FieldRule("crop"),
    FieldRule("soil_c", "decimal"),
    FieldRule("moisture", "percent"),
    FieldRule("is_irrigated", "bool"),
    FieldRule("note"),
]
