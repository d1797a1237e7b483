"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_name(name: str) -> str:
    """A dotted name without empty segments."""
    return ".".join(p for p in name.split(".") if p)


def clean_name(column: Column) -> Column:
    """The same for a string column."""
    return F.array_join(F.filter(F.split(column, r"\."), lambda x: x != ""), ".")


def name_of(column: Column) -> Column:
    """A dotted name from a column of name segments."""
    return F.array_join(column, ".")


def quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def tags_key(tags: Column) -> Column:
    """A string that is equal for equal maps: their entries by key, as JSON; null values are kept."""
    entries = F.array_sort(F.map_entries(tags))
    parts = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(quoted(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def key_of(tags: dict[str, str | None]) -> str:
    """The tags_key of a Python dict."""

    def quote(x: str) -> str:
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'

    return "{" + ",".join(f"{quote(k)}:{'null' if v is None else quote(str(v))}" for k, v in sorted(tags.items())) + "}"


ENTRIES = "array<struct<key:string,value:string>>"


def entries(tags: Column, keys: tuple[str, ...], known: tuple[str, ...] | None = None) -> Column:
    """The entries under ``keys`` in order of key; a present null stays, a missing key doesn't appear.

    ``tags`` is a map, or a struct with the fields ``known``, all of which are present;
    of a struct only the fields asked for are read.
    """
    if known is None:
        return F.array_sort(F.map_entries(F.map_filter(tags, lambda k, _: k.isin(*keys) if keys else F.lit(False))))
    found = [F.struct(F.lit(k).alias("key"), tags[k].cast("string").alias("value")) for k in sorted(set(keys) & set(known))]
    return F.array(*found).cast(ENTRIES)


def take_present(tags: Column, keys: tuple[str, ...], known: tuple[str, ...] | None = None) -> Column:
    """The same as a map, without null values."""
    if known is None:
        return F.map_filter(tags, lambda k, v: (k.isin(*keys) if keys else F.lit(False)) & v.isNotNull())
    return F.map_from_entries(F.filter(entries(tags, keys, known), lambda e: e["value"].isNotNull()))


def as_map(values: Column, known: tuple[str, ...] | None) -> Column:
    """A struct with the fields ``known`` as a map; a map as it is."""
    if known is None:
        return values
    pairs = [c for k in known for c in (F.lit(k), values[k])]
    return F.when(values.isNotNull(), F.create_map(*pairs))


def fields_of(kind: T.DataType) -> tuple[str, ...] | None:
    """The field names of a struct type; None for a map."""
    return tuple(kind.names) if isinstance(kind, T.StructType) else None


def seconds(ts: Column) -> Column:
    """Whole unix seconds of a timestamp, with or without time zone; the session runs in UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def from_accumulated(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from stored sums; 0 for one report, never below 0."""
    spread = (squares - total * total / n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(F.lit(0.0))


def number_text(value: Column) -> Column:
    """A whole number without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
