"""Fusing ranked lists of lexical and dense candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import blank
from quillsift.operators.lexical import ranked
from quillsift.session import plain_unions

RRF_K = 60


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """What a place in a list is worth; the first is 0."""
    return 1.0 / (k + 1 + rank)


def confidence(found: DataFrame, head: int = 10) -> DataFrame:
    """(query_id, confidence): how far the first and the last of a list's head lie apart, from 0 to 1; under two, 0."""
    high, low, n = F.max("score"), F.min("score"), F.count("*")
    spread = (high - low) / (F.abs(high) + 1e-9)
    return found.where(F.col("rank") < head).groupBy("query_id").agg(F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), spread))).alias("confidence"))


def stage_weight(slots: Column, base: float = 0.75, stages: tuple[float, ...] = (0.50, 0.60)) -> Column:
    """The lexical weight for a number of slots: of the first stages, else the base."""
    weight = F.lit(base)
    for n, w in reversed(list(enumerate(stages))):
        weight = F.when(slots == n, F.lit(w)).otherwise(weight)
    return weight


def adaptive_weight(slots: Column, fallback: Column, lexical: Column, dense: Column) -> Column:
    """The lexical weight from the number of slots, and from which list is more confident; between 0.35 and 0.90."""
    prior = F.when(slots == 0, fallback).when(slots == 1, F.greatest(fallback, F.lit(0.60))).otherwise(0.75)
    return F.greatest(F.lit(0.35), F.least(F.lit(0.90), prior + 0.10 * (lexical - dense)))


def gate(rows: Column, slots: Column, category: Column, confident: Column, least: int = 20, most: float = 0.12) -> Column:
    """Whether dense candidates are needed: few lexical ones, or a broad query whose list is not confident."""
    broad = (blank(category) == "") & (slots <= 1)
    return (rows < least) | (broad & (confident <= most))


def fuse(lexical: DataFrame, dense: DataFrame, weights: DataFrame | tuple[float, float] = (0.75, 0.25), top_k: int = 100, k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, rank, score: both lists' places, weighted and summed.

    weights: two numbers, or (query_id, lexical_weight, dense_weight). One union and one aggregation; of equal scores
    those of the lexical list come first, in its order.
    """
    plain_unions(lexical.sparkSession)
    sides = lexical.select("query_id", "doc_id", F.col("rank").alias("l"), F.lit(None).cast("int").alias("d")).unionByName(dense.select("query_id", "doc_id", F.lit(None).cast("int").alias("l"), F.col("rank").alias("d")))
    both = sides.groupBy("query_id", "doc_id").agg(F.min("l").alias("l"), F.min("d").alias("d"))
    if isinstance(weights, DataFrame):
        both = both.join(weights.select("query_id", "lexical_weight", "dense_weight"), "query_id")
        a, b = F.col("lexical_weight"), F.col("dense_weight")
    else:
        a, b = map(F.lit, weights)
    score = F.coalesce(a * rrf(F.col("l"), k), F.lit(0.0)) + F.coalesce(b * rrf(F.col("d"), k), F.lit(0.0))
    return ranked(both.withColumn("score", score), top_k, F.col("l").asc_nulls_last(), F.col("d").asc_nulls_last()).drop("l", "d", "lexical_weight", "dense_weight")
