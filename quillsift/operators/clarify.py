"""Which attribute to ask for next, by what the answer would tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import vocabulary as V

#: Values from which observed entropy stands alone.
MIN_POOL = 10
STOP = 0.3


def entropies(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, n, entropy: of the n non-null values of each group, in bits, as a share of log2(n); under two values, 0."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    groups = counts.groupBy(*keys).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("s"))
    return groups.select(*keys, "n", F.when(F.col("n") < 2, 0.0).otherwise(1 - F.col("s") / F.col("n") / F.log2("n")).alias("entropy"))


def catalog_entropy(attribute: Column) -> Column:
    """An attribute's entropy over the whole catalog, a fixed number."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in V.GLOBAL_ENTROPY.items() for x in kv)), attribute), F.lit(0.5))


def blended(n: Column, entropy: Column, overall: Column, least: int = MIN_POOL) -> Column:
    """Observed entropy, with the catalog's in place of what is missing to `least` values."""
    share = F.least(n / least, F.lit(1.0))
    observed = F.when(n >= 2, entropy).otherwise(overall)
    return F.when(n == 0, overall).otherwise(share * observed + (1 - share) * overall)


def attribute_scores(pool: DataFrame, least: int = MIN_POOL) -> DataFrame:
    """query_id, attribute, ord, n, coverage, score for each query's pool (query_id, doc_id, attrs) and each attribute.

    score is coverage times entropy; ord is the attribute's place, which breaks ties.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(a).alias("attribute"), F.nullif(F.col("attrs")[a], F.lit("")).alias("value")) for k, a in enumerate(V.ATTRIBUTES))))
    long = pool.select("query_id", each.alias("x")).select("query_id", "x.*")
    sizes = long.groupBy("query_id", "attribute", "ord").agg(F.count("*").alias("pool"), F.count("value").alias("n"))
    known = entropies(long, ["query_id", "attribute"]).drop("n")
    joined = sizes.join(known, ["query_id", "attribute"], "left")
    coverage = F.col("n") / F.col("pool")
    score = coverage * blended(F.col("n"), F.coalesce("entropy", F.lit(0.0)), catalog_entropy(F.col("attribute")), least)
    return joined.select("query_id", "attribute", "ord", "n", coverage.alias("coverage"), score.alias("score"))


def eligible(slots: Column, confidence: Column, asked: Column) -> Column:
    """Attributes neither asked for nor known with confidence of 0.5, in their order."""
    known = F.filter(F.map_keys(slots), lambda s: F.coalesce(confidence[s], F.lit(1.0)) >= 0.5)
    return F.array_except(F.lit(list(V.ATTRIBUTES)), F.concat(known, asked))


def ask(sessions: DataFrame, pool: DataFrame, threshold: float = STOP, early_stop: bool = True, dynamic: bool = True, least: int = MIN_POOL) -> DataFrame:
    """query_id, ask, ask_score for sessions (query_id, slots, confidence, asked) and their pools.

    "other" where no attribute is left, the pool is empty or no score reaches the threshold; otherwise the attribute with
    the largest score, the first of equals. Without early stop, null where none is left; without dynamic scores or
    without a pool, half the catalog's entropy stands for a score.
    """
    left = sessions.select("query_id", eligible(F.col("slots"), F.col("confidence"), F.col("asked")).alias("left"))
    options = left.select("query_id", F.explode("left").alias("attribute"))
    scored = options.join(attribute_scores(pool, least), ["query_id", "attribute"], "left")
    ordinal = F.array_position(F.lit(list(V.ATTRIBUTES)), F.col("attribute"))
    fixed = 0.5 * catalog_entropy(F.col("attribute"))
    value = F.coalesce("score", fixed) if dynamic else fixed
    best = scored.withColumn("value", value).withColumn("place", -ordinal).groupBy("query_id").agg(
        F.max_by("attribute", F.struct("value", "place")).alias("best"), F.max("value").alias("ask_score"), F.max("score").alias("top"), F.count("score").alias("pooled")
    )
    joined = left.select("query_id").join(best, "query_id", "left")
    stop = F.col("best").isNull() | (F.col("pooled") == 0) | (F.col("top") < threshold)
    chosen = F.when(stop, F.lit("other")).otherwise(F.col("best")) if early_stop else F.col("best")
    return joined.select("query_id", chosen.alias("ask"), "ask_score")


def pool_limit(slots: Column, size: Column, few: int = 2, large: int = 50, cut: int = 20) -> Column:
    """How many candidates a model is shown: few of a large pool while little is known."""
    return F.when((slots < few) & (size >= large), cut).otherwise(size)


def truncated(pool: DataFrame, sessions: DataFrame, few: int = 2, large: int = 50, cut: int = 20) -> DataFrame:
    """pool (query_id, rank, ...) within pool_limit() of sessions (query_id, slots)."""
    sized = pool.join(sessions.select("query_id", F.size("slots").alias("n_slots")), "query_id").withColumn("pool_size", F.count("*").over(Window.partitionBy("query_id")))
    return sized.where(F.col("rank") < pool_limit(F.col("n_slots"), F.col("pool_size"), few, large, cut)).drop("n_slots", "pool_size")
