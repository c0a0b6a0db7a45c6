"""JSON to structs and back, with the coercions of message types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse(json: Column, schema: T.StructType, required: tuple[str, ...] = (), base64_fields: tuple[str, ...] = ()) -> Column:
    """struct(ok, value): unknown members and mistyped optional fields are ignored; a required field must be there.

    64-bit integers may come as strings; base64 fields become binary.
    """
    loose = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.LongType) or f.name in base64_fields else f.dataType) for f in schema])
    raw = F.from_json(json, loose, {"mode": "PERMISSIVE"})
    fields = []
    for f in schema:
        v = raw[f.name]
        if f.name in base64_fields:
            v = F.try_to_binary(v, F.lit("base64"))
        elif isinstance(f.dataType, T.LongType):
            v = F.when(v.rlike("^-?[0-9]+$"), v.try_cast("long"))
        fields.append(v.alias(f.name))
    ok = F.lit(True)
    for name in required:
        ok = ok & raw[name].isNotNull()
    return F.struct((raw.isNotNull() & ok).alias("ok"), F.struct(*fields).alias("value"))


def emit(value: Column, pretty: bool = False) -> Column:
    """JSON of a struct without its nulls; binary comes out as base64."""
    return F.to_json(value, {"ignoreNullFields": "true", "pretty": "true" if pretty else "false"})


def entries_to_map(entries: Column) -> Column:
    """repeated {key, value} to a map, the last of equal keys winning."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def map_to_entries(m: Column) -> Column:
    return F.map_entries(m)


def rows_to_columns(rows: Column, fields: tuple[str, ...]) -> Column:
    """Array of structs to struct of arrays."""

    def column(name: str) -> Column:
        return F.transform(rows, lambda r: r[name]).alias(name)

    return F.struct(*[column(f) for f in fields])


def columns_to_rows(columns: Column, fields: tuple[str, ...]) -> Column:
    return F.arrays_zip(*[columns[f].alias(f) for f in fields])


def zip_by_position(a: Column, b: Column) -> Column:
    """Array of (a, b) with the elements of one place together; the shorter is filled up with nulls."""
    return F.arrays_zip(a.alias("a"), b.alias("b"))


def map_ignoring_case(entries: Column) -> Column:
    """A map of (key, value) entries by lower-case key, the last of equal keys winning."""
    return entries_to_map(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def get_ignoring_case(m: Column, key: Column) -> Column:
    return F.element_at(m, F.lower(key))
