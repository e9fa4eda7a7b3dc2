"""Defensive reads from loosely typed JSON (VARIANT) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def child(value: Column, path: str) -> Column:
    """The sub-value at ``path`` as a variant; NULL where it is absent."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """Type name of a scalar variant; walks the whole value, so not for large ones."""
    return F.schema_of_variant(value)


def items(value: Column) -> Column:
    """The list held by a variant, one level deep; NULL for every other type."""
    return F.try_variant_get(value, "$", "array<variant>")


def members(value: Column) -> Column:
    """The object held by a variant, one level deep; NULL for every other type."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def members_of(value: Column, struct: str) -> Column:
    """The members of an object that a struct type names, read at once; NULL for every other type."""
    return F.try_variant_get(value, "$", struct)


def is_object(value: Column) -> Column:
    return members(value).isNotNull()


def is_null(value: Column) -> Column:
    """An explicit JSON null, as opposed to an absent value."""
    return value.isNotNull() & F.is_variant_null(value)


def is_absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def string(value: Column) -> Column:
    """The string held by a variant; NULL for every other type."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def whole_number(value: Column) -> Column:
    """The number held by a variant if it has no fraction and fits an int, else NULL."""
    number = F.when(kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    return F.when(number == F.floor(number), F.try_variant_get(value, "$", "int"))


def string_list(value: Column) -> Column:
    """A string or a list becomes a list of strings; anything else an empty list."""
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.when(is_string(value), F.array(F.try_variant_get(value, "$", "string"))),
        F.try_variant_get(value, "$", "array<string>"),
        none,
    )


def display(value: Column) -> Column:
    """Strings as they are, everything else as JSON text; NULL for null."""
    return F.coalesce(string(value), F.when(~is_absent(value), F.to_json(value)))


def is_truthy(value: Column) -> Column:
    """False for null, empty strings, lists and objects, zero and false."""
    return F.coalesce(~F.to_json(value).isin("{}", "[]", '""', "0", "0.0", "false", "null"), F.lit(False))
