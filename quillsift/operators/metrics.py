"""Scores of simulated sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns in a session, recommendations in a turn, and the turn that a session without a hit counts as.
TURNS, TOP, MISSED = 10, 10, 11


def outcomes(recommended: DataFrame, samples: DataFrame, turns: int = TURNS, top: int = TOP) -> DataFrame:
    """sample_id, scenario_type, hit, first_hit_turn, best_rank, reciprocal_rank for each sample.

    recommended: sample_id, turn, doc_id, rank (from 1). samples: sample_id, scenario_type, target, credit_from (the first
    turn whose hits count). The first turn that names the target counts, with its rank there.
    """
    named = recommended.where((F.col("turn") <= turns) & (F.col("rank") <= top)).join(samples.select("sample_id", "target", "credit_from"), "sample_id")
    hit = named.where((F.col("doc_id") == F.col("target")) & (F.col("turn") >= F.coalesce("credit_from", F.lit(1))))
    first = hit.groupBy("sample_id").agg(F.min("turn").alias("first_hit_turn"), F.min_by("rank", F.struct("turn", "rank")).alias("best_rank"))
    return samples.join(first, "sample_id", "left").select(
        "sample_id", "scenario_type", F.col("first_hit_turn").isNotNull().alias("hit"), "first_hit_turn", "best_rank",
        F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def efficiency(mttc: Column) -> Column:
    """1 for a hit in the first turn, 0 for none in ten; null for no sessions."""
    return F.when(mttc.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11.0 - mttc) / 10.0)))


def summary(sessions: DataFrame, by_scenario: bool = True) -> DataFrame:
    """scenario_type (null: all), sample_count, hit_rate_at_10, mrr, mttc, efficiency, score.

    Rates are rounded to six places before efficiency and score follow from them. Without sessions, by scenario there is
    no row, and otherwise one with no mttc, efficiency or score.
    """
    turn = F.coalesce("first_hit_turn", F.lit(MISSED))
    measures = (
        F.count("*").alias("sample_count"), F.round(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)), 6).alias("hit_rate_at_10"),
        F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 6).alias("mrr"), F.round(F.avg(turn), 6).alias("mttc"),
    )
    rows = sessions.rollup("scenario_type").agg(*measures, F.grouping("scenario_type").alias("all")) if by_scenario else sessions.agg(*measures).withColumn("scenario_type", F.lit(None).cast("string")).withColumn("all", F.lit(1))
    good = efficiency(F.col("mttc"))
    score = 0.5 * F.col("hit_rate_at_10") + 0.3 * F.col("mrr") + 0.2 * good
    return rows.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("scenario_type")).alias("scenario_type"), "sample_count", "hit_rate_at_10", "mrr", "mttc", good.alias("efficiency"), score.alias("score"))


def near_misses(sessions: DataFrame, low: int = 6, high: int = 10) -> DataFrame:
    """Sessions that hit, but at a late rank."""
    return sessions.where(F.col("hit") & F.col("best_rank").between(low, high))


def complete_misses(sessions: DataFrame) -> DataFrame:
    return sessions.where(~F.col("hit"))


def usage(turns: DataFrame, *columns: str) -> DataFrame:
    """Sums of token counts; negative and unknown ones count as none."""
    return turns.agg(*(F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0)).alias(c) for c in columns))


def counts(samples: DataFrame) -> DataFrame:
    """Samples of each scenario."""
    return samples.groupBy("scenario_type").agg(F.count("*").alias("n"))
