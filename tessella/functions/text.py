"""Text cleaning and number parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Digits and punctuation to spaces, runs of white space to one, outer spaces off, lower case."""
    x = F.regexp_replace(c, r"\d+", " ")
    x = F.regexp_replace(x, r"[!?(),:;+#-]", " ")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def words(c: Column) -> Column:
    """Words of a cleaned text; none for null and blank."""
    return F.filter(F.split(clean_text(c), " "), lambda w: w != "")


def parse_number(c: Column) -> Column:
    """A number written with currency or percent signs, thousands separators or a decimal comma; null if it is none.

    Signs are taken off. One kind of separator: a single comma is a decimal comma unless exactly three digits follow
    (then it groups thousands, as in 1,234), several commas group; a point is a decimal point, several points group.
    Both kinds: the last one is the decimal separator, the other groups.
    """
    s = F.trim(F.regexp_replace(c, r"[$€£¥₹%\s]", ""))
    commas, points = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    no_comma, no_point = F.replace(s, F.lit(","), F.lit("")), F.replace(s, F.lit("."), F.lit(""))
    last_is_comma = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    grouped = s.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+$")
    plain = (
        F.when((commas > 0) & (points > 0) & last_is_comma, F.replace(no_point, F.lit(","), F.lit(".")))
        .when((commas > 0) & (points > 0), no_comma)
        .when(grouped | (commas > 1), no_comma)
        .when(commas == 1, F.replace(s, F.lit(","), F.lit(".")))
        .when(points > 1, no_point)
        .otherwise(s)
    )
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def group_key(columns: list[Column]) -> Column:
    """Values as one key, missing ones named."""
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("missing")) for c in columns])
