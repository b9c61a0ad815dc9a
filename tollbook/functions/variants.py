"""Reading loosely typed JSON held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def node(v: Column, path: str) -> Column:
    """Value at ``path``; a JSON null counts as absent."""
    found = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(~F.is_variant_null(found), found)


def kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, OBJECT<..>, ARRAY<..>, ... as text."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def as_text(v: Column) -> Column:
    """The string itself; NULL for any other kind."""
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def text(v: Column, path: str) -> Column:
    return as_text(node(v, path))


def filled(v: Column, path: str) -> Column:
    """A non-empty string, else NULL."""
    return F.nullif(text(v, path), F.lit(""))


def shown(v: Column, path: str) -> Column:
    """Any scalar as text."""
    return F.try_variant_get(node(v, path), "$", "string")


def whole(v: Column, path: str) -> Column:
    """An integer; fractions are cut, truth values are not numbers."""
    found = node(v, path)
    return F.when(kind(found) != "BOOLEAN", F.try_variant_get(found, "$", "double").cast("long"))


def flag(v: Column, path: str) -> Column:
    """Truth of a value: absent, false, 0 and '' are false."""
    found = node(v, path)
    plain = F.coalesce(F.try_variant_get(found, "$", "string"), F.lit(""))
    return found.isNotNull() & ~F.lower(plain).isin("", "false", "0", "[]", "{}")


def items(v: Column, path: str) -> Column:
    """A list as array<variant>; NULL for any other kind."""
    found = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(is_list(found), F.try_variant_get(found, "$", "array<variant>"))


def dump(v: Column) -> Column:
    """Compact JSON text."""
    return F.to_json(v)


def size_of(v: Column) -> Column:
    """Size of a payload: characters of a string, bytes of the compact JSON of anything else."""
    return F.when(v.isNull() | F.is_variant_null(v), 0).when(is_text(v), F.length(as_text(v))).otherwise(
        F.octet_length(dump(v))).cast("long")
