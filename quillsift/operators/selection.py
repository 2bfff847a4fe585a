"""Valid recommendations, and samples for evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import blank, joined

# Shares of the scenarios among samples.
SCENARIOS = (("buying", 0.40), ("browsing", 0.40), ("intent_override", 0.15), ("boundary", 0.05))


def valid(recommended: DataFrame, catalog: DataFrame, top: int = 10) -> DataFrame:
    """query_id, doc_id, rank (from 1): the first `top` distinct ids that the catalog has, trimmed, in order of position
    (of equal positions by id)."""
    rows = recommended.select("query_id", "position", F.btrim(F.col("doc_id").cast("string")).alias("doc_id")).where("doc_id <> ''")
    known = rows.join(catalog.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
    first = known.groupBy("query_id", "doc_id").agg(F.min("position").alias("position"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "doc_id"))).where(F.col("rank") <= top).select("query_id", "doc_id", "rank")


def eligible(products: DataFrame, *excluded: DataFrame) -> DataFrame:
    """Products with a title and a category that none of the excluded tables (doc_id) has."""
    rows = products.where((blank(F.col("title")) != "") & (joined(F.col("categories")) != ""))
    for table in excluded:
        rows = rows.join(table.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows


def draw(rows: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """n rows without replacement, in an order that follows from the key and the seed alone; place counts from 0."""
    order = (F.xxhash64(F.lit(seed), key), F.col(key))
    picked = rows.orderBy(*order).limit(n)
    return picked.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def scenario(place: Column, n: int) -> Column:
    """The scenario of a place among n, by the fixed shares; what rounding leaves goes to the last."""
    kind, upto = F.lit(SCENARIOS[-1][0]), 0.0
    bounds = []
    for name, share in SCENARIOS[:-1]:
        upto += share
        bounds.append((name, int(round(upto * n))))
    for name, bound in reversed(bounds):
        kind = F.when(place < bound, F.lit(name)).otherwise(kind)
    return kind


def unseen_samples(products: DataFrame, n: int, seed: int, *excluded: DataFrame) -> DataFrame:
    """sample_id, scenario_type, target, turn (of an override): n samples whose targets are in none of the excluded tables."""
    rows = draw(eligible(products, *excluded).select("doc_id"), n, seed)
    name = F.format_string("sample-%06d", F.col("place"))
    turn = F.when(scenario(F.col("place"), n) == "intent_override", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit("turn")), F.lit(2)).cast("int") + 3)
    return rows.select(name.alias("sample_id"), scenario(F.col("place"), n).alias("scenario_type"), F.col("doc_id").alias("target"), turn.alias("override_turn"))
