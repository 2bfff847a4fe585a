"""Tokenisers and text projections, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions import vocabulary as V


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no function. Null stays null."""
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def blank(text: Column) -> Column:
    """Null texts are empty ones."""
    return F.coalesce(text, F.lit(""))


def joined(values: Column) -> Column:
    """Values of an array of strings, with a blank between; nulls are left out, a null array is empty."""
    return blank(F.array_join(values, " "))


def map_values_text(values: Column) -> Column:
    """Values of a map, in its order."""
    return joined(F.map_values(values))


def map_pairs_text(values: Column) -> Column:
    """Keys and values of a map, in its order."""
    return joined(F.transform(F.map_entries(values), lambda e: F.concat_ws(" ", e["key"], e["value"])))


def price(text: Column) -> Column:
    """A finite number, or null."""
    value = text.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def whole_number(text: Column) -> Column:
    """The number before the point, or null."""
    return price(text).cast("long")


def ascii_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(blank(text)), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(text: Column, most: int = 40) -> Column:
    """Distinct tokens of two characters or more that are no stop words, in order of first occurrence, the first `most`."""
    stop = F.lit(list(V.QUERY_STOPWORDS))
    return F.slice(F.array_distinct(F.filter(ascii_tokens(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))), 1, most)


def match_expression(text: Column, most: int = 40) -> Column:
    """Query terms as alternatives, each quoted."""
    return F.array_join(F.transform(query_terms(text, most), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def diversity_tokens(text: Column) -> Column:
    """Set of tokens by which products are compared with one another."""
    stop = F.lit(list(V.DIVERSITY_STOPWORDS))
    return F.array_distinct(F.filter(ascii_tokens(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def value_tokens(text: Column) -> Column:
    """Set of tokens of two characters or more by which an attribute's value is matched."""
    return F.array_distinct(F.filter(ascii_tokens(text), lambda t: F.length(t) > 1))


def profile_tokens(text: Column) -> Column:
    """Set of all tokens."""
    return F.array_distinct(ascii_tokens(text))


def expanded_tags(tags: Column) -> Column:
    """Tokens of an array of preference tags, and the wordings that catalogs use for some of them."""
    own = profile_tokens(joined(tags))
    more = [F.when(F.array_contains(own, tag), F.lit(list(words))).otherwise(F.lit([]).cast("array<string>")) for tag, words in V.PROFILE_SYNONYMS.items()]
    return F.array_distinct(F.concat(own, *more))


def sentence(*parts: Column) -> Column:
    """Parts that are neither null nor empty, with a point and a blank between."""
    return F.concat_ws(". ", *(F.nullif(p, F.lit("")) for p in parts))


def identity_text(title: Column, categories: Column, store: Column) -> Column:
    """What names a product."""
    return sentence(title, joined(categories), store)


def attribute_text(features: Column, details: Column, description: Column, most: int = 1200) -> Column:
    """What describes a product, cut at `most` characters as the encoder takes no more."""
    return F.substring(sentence(joined(features), map_pairs_text(details), description), 1, most)


def product_text(identity: Column, attributes: Column, most: int = 300) -> Column:
    """Both, for an encoder of one text."""
    return sentence(identity, F.substring(attributes, 1, most))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is named; Spark would write it out each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def last(values: Column, n: int | Column) -> Column:
    """The last n elements, or all if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), n)


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is part of the text."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found
