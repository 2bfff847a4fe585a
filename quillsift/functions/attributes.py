"""Attribute values that a catalog's texts and prices state, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions import vocabulary as V
from quillsift.functions.text import blank

#: Case does not matter, and words and blanks are Unicode's.
FLAGS = "(?iU)"


def first_value(pattern: str, *texts: Column, group: int = 0) -> Column:
    """The first match in the first text that has one; null if none has."""
    return F.coalesce(*(F.nullif(F.regexp_extract(blank(t), FLAGS + pattern, group), F.lit("")) for t in texts))


def named_value(attribute: str, *texts: Column) -> Column:
    """The first of an attribute's words, lower-cased."""
    return F.lower(first_value(rf"\b({V.CATALOG_VALUES[attribute]})\b", *texts))


def size_value(text: Column) -> Column:
    """The size that a text states, as it states it."""
    return F.coalesce(*(first_value(p, text, group=1) for p in V.SIZE_PATTERNS))


def price_bucket(price: Column) -> Column:
    """One of four ranges; null for no price."""
    return F.when(price < 20, "<$20").when(price < 50, "$20-$50").when(price < 100, "$50-$100").when(price.isNotNull(), ">$100")


def attribute_values(searchable: Column, features: Column, details: Column, price: Column) -> Column:
    """All seven attributes of a product, each null where nothing states it."""
    found = {
        "material": named_value("material", searchable),
        "color": named_value("color", searchable),
        "size": size_value(searchable),
        "style": named_value("style", searchable),
        "use_case": named_value("use_case", searchable),
        "feature": named_value("feature", features, details),
        "budget": price_bucket(price),
    }
    return F.struct(*(found[a].alias(a) for a in V.ATTRIBUTES))
