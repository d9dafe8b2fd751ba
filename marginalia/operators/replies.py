"""What models and services reply: times, dates and JSON of loose shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: what a highlight may be about, and what it counts as otherwise
CATEGORIES, DEFAULT_CATEGORY = ("grammar", "clarity", "transitions", "word_choice", "structure", "evidence"), "grammar"

#: A date, or a date and a time to the minute at least, with or without an offset.
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def parse_time(x) -> Column:
    """Instant of an ISO time; null for anything else.  Without an offset it
    is the session's time zone's."""
    value = F.regexp_replace(x, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.when(x.rlike(_ISO), F.when(x.rlike(r"[T ].*[+-][0-9]{4}$"), value).otherwise(x).try_cast("timestamp"))


def wall_clock(x) -> Column:
    """The time as it is written, whatever its offset; null for anything else."""
    return F.when(parse_time(x).isNotNull(), F.regexp_extract(x, r"^([0-9-]{10}(?:[T ][0-9:.]+)?)", 1).try_cast("timestamp_ntz"))


def due_time(due, time) -> Column:
    """ISO time of a due date (year, month, day) and a time (hours, minutes);
    what is missing counts as 2000, 1, 1, 23 and 59; null without a date."""
    part = lambda c, name, other: F.coalesce(c[name].cast("int"), F.lit(other))
    made = F.format_string(
        "%04d-%02d-%02dT%02d:%02d:00Z", part(due, "year", 2000), part(due, "month", 1), part(due, "day", 1), part(time, "hours", 23), part(time, "minutes", 59)
    )
    return F.when(due.isNotNull(), made)


def _kind(v) -> Column:
    return F.schema_of_variant(v)


def items(raw, keys: list[str], single: str | None = None) -> Column:
    """Objects of a reply as an array of JSON: a bare array, the first filled
    array under one of ``keys``, or the object itself if it has ``single``.
    Anything else, and what is no JSON, gives an empty array."""
    v = T.lenient_json(raw)
    array = lambda path: F.try_variant_get(v, path, "array<variant>")
    filled = lambda a: F.when(F.size(a) > 0, a)
    tries = [filled(array(f"$.{k}")) for k in keys]
    if single:
        tries.append(F.when(F.try_variant_get(v, f"$.{single}", "variant").isNotNull(), F.array(v)))
    found = F.when(_kind(v).startswith("ARRAY"), array("$")).when(_kind(v).startswith("OBJECT"), reduce(lambda a, b: F.coalesce(a, b), tries))
    return F.coalesce(F.transform(found, lambda x: F.to_json(x)), F.array().cast("array<string>"))


def highlights(raw) -> Column:
    """Highlights of a reply (quote, category, suggestion): those without a
    quote or a suggestion in words go, unknown categories become the default.
    A reply whose ``highlights`` are no array has none."""

    def word(x, name):
        v = F.try_variant_get(x, f"$.{name}", "variant")
        return F.when(_kind(v) == "STRING", F.try_variant_get(x, f"$.{name}", "string"))

    listed = F.try_variant_get(T.lenient_json(raw), "$.highlights", "array<variant>")
    each = F.transform(listed, lambda x: F.struct(word(x, "quote").alias("quote"), word(x, "category").alias("category"), word(x, "suggestion").alias("suggestion")))
    kept = F.filter(each, lambda h: F.coalesce((F.trim(h["quote"]) != "") & (F.trim(h["suggestion"]) != ""), F.lit(False)))
    known = lambda c: F.when(F.coalesce(c.isin(*CATEGORIES), F.lit(False)), c).otherwise(DEFAULT_CATEGORY)
    valid = F.transform(kept, lambda h: F.struct(h["quote"].alias("quote"), known(h["category"]).alias("category"), h["suggestion"].alias("suggestion")))
    return F.coalesce(valid, F.array().cast("array<struct<quote:string,category:string,suggestion:string>>"))
