"""Fields of JSON that is parsed once and kept as VARIANT.

A text becomes a variant when it is stored, and fields are read from that, by path and type, as often as they are asked for. Defined
cases: a text that does not parse is kept as it is, marked, and has no fields; a path that is not there, or a value that cannot be
read as the type, is null; so is a null text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, text: str, name: str = "value") -> DataFrame:
    """rows with the variant of a text, whether it parsed, and the text where it did not, in place of the text."""
    value = F.try_parse_json(F.col(text))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (text, name, f"{name}_ok", f"{name}_text")]
    ok = F.col(text).isNull() | value.isNotNull()
    return rows.select(*kept, value.alias(name), ok.alias(f"{name}_ok"), F.when(~ok, F.col(text)).alias(f"{name}_text"))


def fields(value: str | Column, wanted: dict[str, tuple[str, str]]) -> list[Column]:
    """A column for each name: of the path and type it is given."""
    v = F.col(value) if isinstance(value, str) else value
    return [F.try_variant_get(v, path, kind).alias(name) for name, (path, kind) in wanted.items()]

