"""Payload text: Python literals, JSON paths, patterns and packed details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_to_json(text: Column) -> Column:
    """Turn the text of a Python dict into JSON: quotes, None, True and False as words."""
    quoted = F.replace(text.cast("string"), F.lit("'"), F.lit('"'))
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        quoted = F.regexp_replace(quoted, rf"\b{word}\b", json_word)
    return quoted


def json_number(text: Column, path: str, kind: str = "double") -> Column:
    """Scalar at `path`, null where it does not parse as `kind`."""
    return F.get_json_object(text, path).try_cast(kind)


def first_json_number(text: Column, paths: Sequence[str], kind: str = "double") -> Column:
    """The first of several alternative keys that holds a number."""
    return F.coalesce(*[json_number(text, path, kind) for path in paths])


def payload_value(text: Column, key: str) -> Column:
    """Value of `key` in a loosely written payload: `key: 'v'`, `key=v`, `key":"v"`."""
    return F.nullif(F.regexp_extract(text, key + r"[:=]['\"]?([^'\"]+)['\"]?", 1), F.lit(""))


def payload_number(text: Column, key: str) -> Column:
    """Unsigned decimal written directly after `key` and one of colon, equals or blank."""
    return F.nullif(F.regexp_extract(text, key + r"[:= ]([0-9.]+)", 1), F.lit("")).try_cast("double")


def model_details(text: Column) -> Column:
    """Struct of `{type:version:date:path:file}`; absent parts are null."""
    parts = F.split(F.regexp_replace(text, r"[{}]", ""), ":")
    names = ("model_type", "version", "date", "file_path", "file_name")
    return F.struct(*[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)])


def number_or_null(text: Column) -> Column:
    """Double, with unparsable text and NaN as null."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number)


def product_of(name: Column) -> Column:
    """Product family from a model name."""
    return (
        F.when(name.like("%sil%"), F.lit("SIL"))
        .when(name.like("%cash%"), F.lit("CASH"))
        .otherwise(F.lit("ALL"))
    )


def without_leading_code(text: Column) -> Column:
    """Drop a leading `123 - ` code."""
    return F.regexp_replace(text, r"^\d+\s*-\s*", "")


def id_suffix(identifier: Column, length: int = 25) -> Column:
    return F.right(identifier.cast("string"), F.lit(length))
