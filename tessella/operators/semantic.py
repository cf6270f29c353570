"""Semantic names of columns: an evidence table and a pluggable namer with a rule-based default."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from tessella.operators.split import sample_values

#: Samples per column by accuracy.
ACCURACY = {"low": 10, "mid": 20, "high": 20}

#: Names by what values look like; the first that ``SHARE`` of the samples match counts.
RULES = (
    ("uuid", r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
    ("email", r"[^@\s]+@[^@\s]+\.[a-z]{2,}"),
    ("url", r"(https?|ftp)://\S+"),
    ("ip address", r"(\d{1,3}\.){3}\d{1,3}(/\d{1,2})?|([0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}"),
    ("timestamp", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?"),
    ("date", r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"),
    ("time", r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[ap]m)?"),
    ("currency", r"[$€£¥₹]\s?[\d.,]+|[\d.,]+\s?([$€£¥₹]|usd|eur|gbp)"),
    ("percentage", r"[+-]?[\d.,]+\s?%"),
    ("coordinates", r"[+-]?\d{1,2}\.\d+\s*,\s*[+-]?\d{1,3}\.\d+"),
    ("boolean", r"true|false|yes|no|y|n|t|f|on|off"),
    ("measurement", r"[+-]?\d+([.,]\d+)?\s?(mm|cm|m|km|g|kg|t|l|ml|v|mv|a|w|kw|hz|pa|hpa|°?c|°?f|k|s|ms|min|h|d)"),
    ("phone number", r"\+\d[\d ()/-]{6,18}\d"),
    ("version", r"v?\d+(\.\d+){2,3}([-+][\w.]+)?"),
    ("hash", r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}"),
    ("file path", r"(/|[a-z]:\\|\./|\.\./)[^\s]+|[\w-]+\.(csv|json|txt|parquet|png|jpe?g|pdf|xml|html)"),
    ("structured value", r"[{\[].*[}\]]"),
    ("range", r"[<>]=?\s?\d+([.,]\d+)?|\d+([.,]\d+)?\s?(-|–|to|\+)\s?(\d+([.,]\d+)?)?"),
    ("code", r"[A-Za-z]{1,5}[-_ ]?\d{2,}([-_][A-Za-z0-9]+)*"),
    ("number", r"[+-]?\d+([.,]\d+)*([eE][+-]?\d+)?"),
)
#: Names by words of the column's own name, where the values say nothing.
WORDS = (
    ("identifier", {"id", "key", "uid", "guid", "code", "index", "no"}), ("age", {"age"}), ("gender", {"gender", "sex"}), ("price", {"price", "cost", "amount", "fee", "salary", "income", "revenue"}),
    ("latitude", {"lat", "latitude"}), ("longitude", {"lon", "lng", "longitude"}), ("country", {"country", "nation"}), ("city", {"city", "town"}), ("region", {"region", "state", "province", "district", "site"}),
    ("name", {"name", "firstname", "lastname", "surname"}), ("address", {"address", "street"}), ("channel", {"channel", "medium"}), ("label", {"label", "target", "class"}), ("score", {"score", "rating", "grade"}),
    ("duration", {"duration", "elapsed", "minutes", "hours", "days"}), ("weight", {"weight", "mass"}), ("temperature", {"temp", "temperature"}), ("count", {"count", "qty", "quantity", "num"}), ("comment", {"comment", "note", "notes", "remark", "description", "text"}),
)
SHARE = 0.9
_COMPILED = tuple((name, re.compile(pattern, re.I | re.S)) for name, pattern in RULES)


def name_by_rules(column: str, kind: str, samples: list[str]) -> str:
    """The first rule that ``SHARE`` of the samples match; else a name by a word of the column's name; else one by the
    range of numbers or the type."""
    held = [s.strip() for s in samples if s and s.strip()]
    if held and kind != "num":
        for name, pattern in _COMPILED:
            if sum(pattern.fullmatch(s) is not None for s in held) >= SHARE * len(held):
                return name
    words = {w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", column).lower()) if w}
    for name, known in WORDS:
        if words & known:
            return name
    if kind == "num" and held:
        numbers = [float(s) for s in held]
        whole = all(x == int(x) for x in numbers if abs(x) < 1e15)
        if whole and all(1800 <= x <= 2200 for x in numbers):
            return "year"
        if set(numbers) <= {0.0, 1.0}:
            return "flag"
        if not whole and all(0 <= x <= 1 for x in numbers):
            return "proportion"
    return {"num": "quantity", "cat": "category"}.get(kind, "text")


def evidence(df: DataFrame, types: dict[str, str], key: str, accuracy: str = "low") -> dict[str, list[str]]:
    """At most ``ACCURACY`` sample values per column."""
    if accuracy not in ACCURACY:
        raise ValueError(f"unknown accuracy {accuracy}")
    return {c: [str(r.value) for r in sample_values(df, c, t, ACCURACY[accuracy], key=key).collect()] for c, t in types.items()}


def parse_names(answer: str) -> dict[str, str]:
    """Lines ``column: name``, split at the first colon; lines without colon are skipped."""
    pairs = (line.split(":", 1) for line in answer.splitlines() if ":" in line)
    return {a.strip(): b.strip() for a, b in pairs}


def semantic_types(df: DataFrame, types: dict[str, str], key: str, accuracy: str = "low", namer: Callable[[str, str, list[str]], str] = name_by_rules) -> DataFrame:
    """(column, dformat, semantic_type)."""
    found = evidence(df, types, key, accuracy)
    return df.sparkSession.createDataFrame([(c, t, namer(c, t, found[c])) for c, t in types.items()], "column string, dformat string, semantic_type string")
