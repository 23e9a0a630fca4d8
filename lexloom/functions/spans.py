"""Texts of span lists in their various encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_json(raw: Column) -> Column:
    """A VARIANT of JSON text, after mending doubled quotes where needed; null if it can't be read."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(_mended(raw)))


def _mended(raw: Column) -> Column:
    return F.replace(F.replace(raw, F.lit("''"), F.lit('"')), F.lit('""'), F.lit('"'))


def spans_text(raw: Column, any_key: bool = True) -> Column:
    """The spans joined with nothing between; null if the list can't be read.

    An item is a list (its first element), an object (``text``, ``span``, ``0`` or else its first value) or a scalar.
    With ``any_key`` False only lists and the key ``0`` count.
    """
    parsed = lenient_json(raw)
    items = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))

    def text_of(item: Column) -> Column:
        first, zero = F.try_variant_get(item, "$[0]", "string"), F.try_variant_get(item, "$['0']", "string")
        if not any_key:
            return F.coalesce(first, zero)
        named = F.coalesce(F.try_variant_get(item, "$.text", "string"), F.try_variant_get(item, "$.span", "string"))
        nested = F.schema_of_variant(item).rlike("^(ARRAY|OBJECT)")
        return F.coalesce(first, named, zero, F.when(~nested, F.try_variant_get(item, "$", "string")))

    if not any_key:
        return F.array_join(F.transform(items, text_of), "")
    # a VARIANT sorts the keys of an object, so a first value is taken from the text, where an object has no known key
    texts = F.from_json(F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(_mended(raw)), "array<string>")
    other = lambda item: F.schema_of_variant(item).startswith("OBJECT") & text_of(item).isNull()
    with_first = F.transform(items, lambda item, i: F.coalesce(text_of(item), F.when(other(item), F.get(F.map_values(F.from_json(F.get(texts, i), "map<string,string>")), F.lit(0)))))
    return F.array_join(F.when(F.exists(items, other), with_first).otherwise(F.transform(items, text_of)), "")
