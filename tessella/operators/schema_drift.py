"""Schemas that drift between files: rescue-column ingestion and a ledger of changes.

``rescue`` enforces a target schema on JSON records. What the schema doesn't know, or what can't be cast to its type, is
kept per record in ``_rescued``; nothing is lost. ``ingest`` gives the same with the rescued fields as JSON text.
``promote`` adds approved fields (and renames) to the schema and ``replay`` moves rescued values into their typed
columns without reading the files again.

``drift_ledger`` compares each file with the one before it in its feed, by the fields that were rescued from it under a
schema of the record key alone. Renames are found from order-free fingerprints of (record key, value) over the keys
both files hold, so no pairs of records or fields are built; only fields that are gone or new are looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import cut, written


@dataclass(frozen=True)
class TargetSchema:
    """``columns``: name -> Spark type. ``aliases``: name in files -> column, for approved renames."""

    columns: dict[str, str]
    aliases: dict[str, str] = field(default_factory=dict)

    def promote(self, columns: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> TargetSchema:
        return replace(self, columns=self.columns | (columns or {}), aliases=self.aliases | (aliases or {}))

    def names(self, column: str) -> list[str]:
        """Names under which files hold the column, its own first."""
        return [column, *sorted(a for a, c in self.aliases.items() if c == column and a != column)]


def _clean(value: Column, type_name: str) -> Column:
    """The JSON text of one field as the type, or null where that would change what it says."""
    is_string = value.startswith('"')
    plain = F.when(is_string, F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    if type_name == "string":
        return F.when(is_string, plain)
    if type_name == "boolean":
        return F.when(F.lower(F.trim(plain)).isin("true", "false"), F.trim(plain).try_cast("boolean"))
    if type_name == "array<string>":
        return F.when(value.rlike(r'\A\[("([^"\\]|\\.)*"(,"([^"\\]|\\.)*")*)?\]\z'), F.from_json(value, type_name))
    number = F.trim(plain)
    ok = number.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z")
    if type_name in ("bigint", "int"):
        ok = number.rlike(r"\A[+-]?[0-9]+\z")
    return F.when(ok, number.try_cast(type_name))


def json_map(body: Column) -> Column:
    """Map field -> canonical JSON text (strings keep their quotes, so kinds stay apart); null for a broken body. Of a
    key that stands twice in one object nothing can be told, so such a body is rescued whole."""
    as_map = F.try_parse_json(body).try_cast("map<string,variant>")
    return F.transform_values(as_map, lambda _, v: F.to_json(v))


def _place(df: DataFrame, fields: Column, schema: TargetSchema, keep: list[str], as_map: bool = False) -> DataFrame:
    df = df.withColumn("_fields", fields)
    cells, used = [], []
    for name, kind in schema.columns.items():
        options = []
        for held in schema.names(name):
            value = _clean(F.col("_fields")[held], kind)
            used.append((held, value.isNotNull() & F.coalesce(*options).isNull() if options else value.isNotNull()))
            options.append(value)
        cells.append(F.coalesce(*options).alias(name))
    placed = F.array_compact(F.array(*[F.when(fills, F.lit(h)) for h, fills in used]))
    # a generator again: within the filter below the casts would be made anew for every field
    typed = df.select("*", F.explode(F.array(F.struct(F.struct(*cells).alias("typed"), placed.alias("placed")))).alias("_t"))
    unplaced = lambda k: ~F.array_contains("_t.placed", k)
    if as_map:
        rest = F.map_filter("_fields", lambda k, v: unplaced(k))
        return typed.withColumn("_rescued", rest).select(*[F.col(f"`{c}`") for c in keep], "_t.typed.*", "_rescued")
    left = F.map_filter("_fields", lambda k, v: unplaced(k) & (v != "null"))
    rescued = F.concat(
        F.lit("{"),
        F.array_join(F.transform(F.array_sort(F.map_entries(left)), lambda e: F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), e["value"])), ","),
        F.lit("}"),
    )
    return typed.withColumn("_rescued", F.when(F.size(left) > 0, rescued)).select(*[F.col(f"`{c}`") for c in keep], "_t.typed.*", "_rescued")


def rescue(records: DataFrame, body: str, schema: TargetSchema, keep: list[str], as_map: bool = True) -> DataFrame:
    """Records as one consistent table: columns ``keep`` (``source_<name>`` where a target column has the name), the
    typed columns, ``_broken`` (the body itself where it isn't a JSON object) and ``_rescued``, a map of field -> JSON
    text in which fields that are null stay. A field that is absent or null is null in its column. If a column stands
    in a record under several of its names, the first that casts fills it and the others stay in ``_rescued``."""
    b = F.col(f"`{body}`")
    taken = {c.lower() for c in schema.columns}
    named = {c: f"source_{c}" if c.lower() in taken else c for c in keep}
    # a generator, as a plain column would be parsed again wherever it is used
    base = records.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], b.alias("_body"), F.explode(F.array(json_map(b))).alias("_map"))
    base = base.withColumn("_broken", F.when(F.col("_map").isNull(), F.col("_body")))
    return _place(base, F.col("_map"), schema, [*named.values(), "_broken"], as_map)


def ingest(records: DataFrame, body: str, schema: TargetSchema, keep: list[str]) -> DataFrame:
    """``rescue`` with the rescued fields as one JSON text, without those that are null."""
    return rescue(records, body, schema, keep, as_map=False)


def replay(table: DataFrame, schema: TargetSchema, keep: list[str]) -> DataFrame:
    """Fill typed columns from ``_rescued``, be it text or a map, after fields were promoted. Values already typed
    stay; what is still rescued comes out as text."""
    held = F.col("_was") if isinstance(table.schema["_rescued"].dataType, T.MapType) else json_map(F.col("_was"))
    old = [c for c in schema.columns if c in table.columns]
    again = _place(
        table.select(*[F.col(f"`{c}`") for c in keep], "_broken", "_rescued", *[F.col(c).alias(f"_old_{c}") for c in old]).withColumnRenamed("_rescued", "_was"),
        F.coalesce(held, F.create_map().cast("map<string,string>")),
        schema,
        [*keep, "_broken", *[f"_old_{c}" for c in old]],
    )
    cells = [F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in old else F.col(c) for c in schema.columns]
    return again.select(*[F.col(f"`{c}`") for c in keep], "_broken", *cells, "_rescued")


def kind_of(json: Column) -> Column:
    """JSON kind of a value's text; null for null."""
    return (
        F.when(json.startswith('"'), "string")
        .when(json.startswith("["), "array")
        .when(json.startswith("{"), "object")
        .when(json.isin("true", "false"), "boolean")
        .when(json != "null", "number")
    )


def rescued_records(records: DataFrame, body: str, key_field: str, keep: list[str]) -> DataFrame:
    """The records with everything but their key rescued, written as a table: bodies are parsed once, the ledger is
    read from it and promoted fields are replayed from it. The key may be of any kind."""
    found = rescue(records, body, TargetSchema({key_field: "string"}), keep)
    return written(found.withColumn("_key", F.coalesce(F.to_json(F.col(f"`{key_field}`").cast("variant")), F.col("_rescued")[key_field])), "rescued")


def drift_ledger(
    rescued: DataFrame, files: DataFrame, *, file_id: str = "file_id", feed: str = "feed_id", seq: str = "seq_no", key_field: str = "rec_key"
) -> DataFrame:
    """Changes (file_id, change_kind, old_field, new_field) of each file against the one before it in its feed, from
    ``rescued_records``.

    Files whose records are all broken, or that have none, hold no field. ``renamed`` needs at least one record key
    common to both files, equal values (kind included) for all common keys, and a value that isn't null among them;
    if several pairs of names qualify, each is reported. ``retyped`` compares with the last known kind of the name
    in the feed; of a file that mixes kinds the most frequent counts, on a tie the first by name. A field that comes
    back after it was removed is ``added`` and nothing else.
    """
    order = Window.partitionBy("feed").orderBy("seq", "file_id")
    chain = files.select(F.col(f"`{file_id}`").alias("file_id"), F.col(f"`{feed}`").alias("feed"), F.col(f"`{seq}`").alias("seq")).dropDuplicates(["file_id"])
    chain = chain.withColumn("prev_file", F.lag("file_id").over(order)).withColumn("next_file", F.lead("file_id").over(order)).withColumn("place", F.row_number().over(order))
    records = rescued.select(F.col(f"`{file_id}`").alias("at"), F.col("_key").alias("rec_key"), "_rescued")

    # which fields each file holds, and of which kind: partial aggregates, however large a file is
    rows = records.select(F.col("at").alias("file_id"), F.explode("_rescued").alias("field", "value")).where(F.col("field") != key_field)
    counted = rows.groupBy("file_id", "field", kind_of(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    held = counted.groupBy("file_id", "field").agg(
        F.min_by("kind", F.when(F.col("kind").isNotNull(), F.struct(-F.col("n"), F.col("kind")))).alias("kind")
    )
    held = held.join(chain, "file_id")
    # the same field in the file before: places are dense per feed, so a gap in them is an absence
    per_field = Window.partitionBy("feed", "field").orderBy("place")
    seen = cut(held.select(
        "file_id", "field", "place", "kind", "prev_file", "next_file",
        F.last("kind", ignorenulls=True).over(per_field.rowsBetween(Window.unboundedPreceding, -1)).alias("known"),
        F.lag("place").over(per_field).alias("last_place"), F.lead("place").over(per_field).alias("next_place"),
    ))  # a row per file and field
    is_new = F.col("prev_file").isNotNull() & (F.col("last_place").isNull() | (F.col("last_place") < F.col("place") - 1))
    is_gone = F.col("next_file").isNotNull() & (F.col("next_place").isNull() | (F.col("next_place") > F.col("place") + 1))
    # a change is filed under the later of the two files
    new = seen.where(is_new).select("file_id", "field", F.col("file_id").alias("at"), F.lit(1).alias("side"))
    gone = seen.where(is_gone).select(F.col("next_file").alias("file_id"), "field", F.col("file_id").alias("at"), F.lit(0).alias("side"))
    doubtful = cut(gone.unionByName(new))

    # fingerprints of gone and new fields over the keys common to both files, where there are both kinds of them
    both = doubtful.groupBy("file_id").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("file_id")
    sought = doubtful.join(both, "file_id").groupBy("at").agg(F.collect_list(F.struct("file_id", "side", "field")).alias("asked"))
    asked = records.where("rec_key is not null").join(sought, "at").select("rec_key", "_rescued", F.explode("asked").alias("a"))
    value = F.nullif(F.col("_rescued")[F.col("a.field")], F.lit("null"))
    cells = asked.select("a.file_id", "rec_key", F.struct("a.side", "a.field", value.alias("value")).alias("cell"))
    common = cells.groupBy("file_id", "rec_key").agg(F.collect_set("cell").alias("cells"))  # a few fields of one key
    common = common.where(F.exists("cells", lambda c: c["side"] == 0) & F.exists("cells", lambda c: c["side"] == 1))
    prints = (
        common.select("file_id", "rec_key", F.explode("cells").alias("c")).where("c.value is not null")
        .groupBy("file_id", F.col("c.side").alias("side"), F.col("c.field").alias("field"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("rec_key", "c.value").cast("decimal(20,0)")).alias("f1"),
            F.sum(F.xxhash64("c.value", "rec_key", F.lit("again")).cast("decimal(20,0)")).alias("f2"),
        )
    )
    alike = prints.groupBy("file_id", "n", "f1", "f2").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("field"))).alias("old"), F.collect_list(F.when(F.col("side") == 1, F.col("field"))).alias("new")
    )
    renamed = cut(alike.select("file_id", F.explode("old").alias("old_field"), "new").select("file_id", "old_field", F.explode("new").alias("new_field")))

    ends = renamed.select("file_id", F.col("old_field").alias("field"), F.lit(0).alias("side")).unionByName(renamed.select("file_id", F.col("new_field").alias("field"), F.lit(1).alias("side")))
    other = doubtful.select("file_id", "field", "side").join(ends.distinct().withColumn("named", F.lit(True)), ["file_id", "field", "side"], "left").where("named is null")
    is_old, empty = F.col("side") == 0, F.lit("")
    plain = other.select(
        "file_id", F.when(is_old, "removed").otherwise("added").alias("change_kind"),
        F.when(is_old, F.col("field")).otherwise(empty).alias("old_field"), F.when(is_old, empty).otherwise(F.col("field")).alias("new_field"),
    )
    changed = seen.where("prev_file is not null and kind is not null and known is not null and kind <> known").select("file_id", "field")
    retyped = changed.join(other.where("side = 1").select("file_id", "field"), ["file_id", "field"], "left_anti").select(
        "file_id", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field")
    )
    return renamed.select("file_id", F.lit("renamed").alias("change_kind"), "old_field", "new_field").unionByName(plain).unionByName(retyped)


def approved_aliases(ledger: DataFrame, columns: dict[str, str]) -> dict[str, str]:
    """Name in files -> column, from the renames of a ledger: names that lead, over renames in either direction and
    other names, to exactly one of ``columns``. A name that leads to several stays rescued. The renames that reach the
    driver are bounded by the names of fields."""
    near: dict[str, set[str]] = {}
    for r in ledger.where("change_kind = 'renamed'").select("old_field", "new_field").distinct().collect():
        near.setdefault(r.old_field, set()).add(r.new_field)
        near.setdefault(r.new_field, set()).add(r.old_field)
    leads: dict[str, set[str]] = {}
    for column in columns:
        seen, todo = set(), [column]
        while todo:
            new = {n for n in near.get(todo.pop(), ()) if n not in columns} - seen
            seen |= new
            todo += sorted(new)
        for name in seen:
            leads.setdefault(name, set()).add(column)
    return {name: min(to) for name, to in leads.items() if len(to) == 1}
