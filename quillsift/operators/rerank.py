"""Reranking a query's best candidates: profile, features, diversity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.operators.compat import compatibility
from quillsift.session import plain_unions

#: Candidates that are reranked, those returned, and the most that relevance may weigh against diversity.
POOL, TOP, LAMBDA = 20, 10, 0.70

# The weights of the features.
WEIGHTS = {"base": 1.0, "attribute": 1.6, "negative": 1.4, "slot": 0.8, "category": 1.0, "popularity": 0.15, "price": 0.4}
#: Weights that count where only some are given.
PARTIAL = {"base": 1.0, "attribute": 1.6, "negative": 1.4, "slot": 2.2, "category": 1.8, "popularity": 0.3, "price": 0.6}


def profile_boost(pool: DataFrame, products: DataFrame, sessions: DataFrame, weight: float = 0.15) -> DataFrame:
    """pool with the share of the session's preference tags that a product's text has added to its score."""
    tags = sessions.select("query_id", X.expanded_tags(F.col("tags")).alias("wanted"))
    text = F.concat_ws(" ", "title120", X.joined(F.col("categories")), "profile_text")
    own = products.select("doc_id", X.profile_tokens(text).alias("own"))
    share = F.size(F.array_intersect("wanted", "own")) / F.size("wanted")
    rows = pool.join(tags, "query_id", "left").join(own, "doc_id", "left")
    more = F.when(F.size("wanted") > 0, weight * F.coalesce(share, F.lit(0.0))).otherwise(0.0) if weight > 0 else F.lit(0.0)
    return rows.withColumn("score", F.col("score") + more).select(*pool.columns)


def popularity(count: Column) -> Column:
    """Logarithm of the number of ratings, as a share of the largest in the pool."""
    value = F.log1p(F.coalesce(count, F.lit(0)).cast("double"))
    return value / F.coalesce(F.nullif(F.max(value).over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(1.0))


def closeness(price: Column, budget: Column) -> Column:
    """From 0 to 1, how near a price is to a budget; 0 where either is unknown."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(price - budget) / F.greatest(budget, F.lit(1.0))), F.lit(0.0))


def coverage(wanted: Column, title: Column, every: Column, field_aware: bool = True) -> Column:
    """Share of the slots' tokens that a product has in any field; or their overlap with title and category alone."""
    if field_aware:
        return F.size(F.array_intersect(wanted, every)) / F.greatest(F.size(wanted), F.lit(1))
    return F.size(F.array_intersect(wanted, title)) / F.greatest(F.size(F.array_union(wanted, title)), F.lit(1))


def features(pool: DataFrame, products: DataFrame, sessions: DataFrame, weights: dict[str, float] | None = None, dynamic: bool = True, field_aware: bool = True) -> DataFrame:
    """pool (query_id, doc_id, rank, score) with `relevance`, its features weighted, and `tokens` to compare products by.

    Dynamic relevance is score, compatibility, risk and popularity; where nothing is known of a session, as in static
    relevance, slot coverage, category and price closeness take their place only if `dynamic` is off, since a session
    without evidence fits every product alike. Relevance is rounded to nine places, so that equal products tie.
    """
    w = WEIGHTS if weights is None else PARTIAL | weights
    title = X.diversity_tokens(F.concat_ws(" ", "title120", X.joined(F.col("categories"))))
    own = products.select("doc_id", "categories", "price", "rating_number", title.alias("title_tokens"), F.array_union(title, X.diversity_tokens(F.col("profile_text"))).alias("tokens"))
    side = sessions.select(
        "query_id", X.diversity_tokens(X.joined(F.map_values("slots"))).alias("wanted"), F.col("slots")["budget"].try_cast("double").alias("budget"),
        F.get(F.filter(F.transform(F.split(X.blank(F.col("slots")["category"]), "/"), lambda p: F.lower(F.btrim(p))), lambda p: p != ""), F.lit(0)).alias("anchor"),
    )
    rows = pool.join(side, "query_id").join(own, "doc_id", "left")
    base = F.col("score") / F.coalesce(F.nullif(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("base", base).withColumn("popularity", popularity(F.col("rating_number")))
    if dynamic:
        rows = rows.join(compatibility(pool, products, sessions), ["query_id", "doc_id"], "left")
        relevance = w["base"] * F.col("base") + w["attribute"] * F.coalesce("compatibility", F.lit(0.0)) - w["negative"] * F.coalesce("risk", F.lit(0.0)) + w["popularity"] * F.col("popularity")
    else:
        fits = F.coalesce(F.exists("categories", lambda c: F.contains(F.lower(c), F.col("anchor"))), F.lit(False)).cast("double")
        near = closeness(F.col("price"), F.col("budget"))
        relevance = w["base"] * F.col("base") + w["slot"] * coverage(F.col("wanted"), F.col("title_tokens"), F.col("tokens"), field_aware) + w["category"] * fits + w["popularity"] * F.col("popularity") + w["price"] * near
    return rows.select("query_id", "doc_id", "rank", "score", F.round(relevance, 9).alias("relevance"), "tokens")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def diversify(scored: DataFrame, k: int = TOP, weight: float = LAMBDA) -> DataFrame:
    """query_id, doc_id, rank, score: greedily the candidate with the largest weighted difference of relevance and its
    likeness to any chosen before; of equals the one that stood first.

    scored: query_id, doc_id, rank, score, relevance, tokens, of at most POOL candidates a query, which makes the greedy
    choice a fold over an array of that length. rank is the new order; score stays as it was.
    """
    item = F.struct(F.col("rank").alias("at"), "doc_id", "score", "relevance", "tokens")
    pools = scored.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("pool"))
    none = F.slice("pool", 1, 0)

    def choose(state: Column, _: Column) -> Column:
        def gain(x: Column) -> Column:
            worst = F.coalesce(F.array_max(F.transform(state["chosen"], lambda c: jaccard(x["tokens"], c["tokens"]))), F.lit(0.0))
            value = F.when(F.size(state["chosen"]) == 0, x["relevance"]).otherwise(weight * x["relevance"] - (1 - weight) * worst)
            return F.struct(value.alias("value"), (-x["at"]).alias("first"))

        best = -F.array_max(F.transform(state["left"], gain))["first"]
        return F.when(F.size(state["left"]) == 0, state).otherwise(
            F.struct(F.concat(state["chosen"], F.filter(state["left"], lambda x: x["at"] == best)).alias("chosen"), F.filter(state["left"], lambda x: x["at"] != best).alias("left"))
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.struct(none.alias("chosen"), F.col("pool").alias("left")), choose, lambda s: s["chosen"])
    return pools.select("query_id", F.posexplode(done).alias("rank", "x")).select("query_id", F.col("x.doc_id").alias("doc_id"), "rank", F.col("x.score").alias("score"))


def rerank(pool: DataFrame, products: DataFrame, sessions: DataFrame, settings: dict | None = None, k: int = TOP) -> DataFrame:
    """The k best of each query's first candidates: profile, features, diversity.

    Only the first `rerank_top_n` of the pool are looked at, however long it is. A configured weight of relevance above
    0.70 counts as 0.70.
    """
    s = {"rerank_top_n": POOL, "profile_weight": 0.15, "mmr_lambda": 1.0, "use_dynamic_attribute_scoring": True, "use_field_aware_slot_coverage": True} | (settings or {})
    head = pool.where(F.col("rank") < s["rerank_top_n"]).select("query_id", "doc_id", "rank", "score")
    boosted = profile_boost(head, products, sessions, s["profile_weight"])
    scored = features(boosted, products, sessions, s.get("feature_weights"), s["use_dynamic_attribute_scoring"], s["use_field_aware_slot_coverage"])
    return diversify(scored, k, min(s["mmr_lambda"], LAMBDA))


def merge_order(pool: DataFrame, order: DataFrame, k: int = TOP) -> DataFrame:
    """The k first of pool (query_id, doc_id, rank, score), those that order (query_id, doc_id, position) names first.

    Documents that order names but the pool lacks are ignored, and of a document named twice the first place counts.
    """
    named = order.groupBy("query_id", "doc_id").agg(F.min("position").alias("position"))
    window = Window.partitionBy("query_id").orderBy(F.col("position").asc_nulls_last(), "rank")
    rows = pool.join(named, ["query_id", "doc_id"], "left").withColumn("new", F.row_number().over(window) - 1)
    return rows.where(F.col("new") < k).select("query_id", "doc_id", F.col("new").alias("rank"), "score")


def model_order(pool: DataFrame, prompt: Column, model: Callable[[str], list[str] | None], k: int = TOP, fallback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k first of pool in the order that a model gives for each query's prompt; where it gives none, fallback's.

    model is called once for each query, on the executors; null, an exception or no list means no order.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for query, text in zip(batch["query_id"], batch["prompt"], strict=True):
                try:
                    named = model(text)
                except Exception:  # noqa: BLE001 - whatever a model raises, the query keeps the fallback's order
                    named = None
                out += [(query, str(d), p) for p, d in enumerate(named)] if isinstance(named, list) else []
            yield pd.DataFrame(out, columns=["query_id", "named", "position"]).astype({"query_id": batch["query_id"].dtype})

    plain_unions(pool.sparkSession)
    prompts = pool.groupBy("query_id").agg(prompt.alias("prompt"))
    order = prompts.mapInPandas(run, f"query_id {dict(pool.dtypes)['query_id']}, named string, position long")
    order = order.select("query_id", F.col("named").cast(dict(pool.dtypes)["doc_id"]).alias("doc_id"), "position")
    ordered = merge_order(pool.join(order.select("query_id").distinct(), "query_id", "left_semi"), order, k)
    rest = pool.join(order.select("query_id").distinct(), "query_id", "left_anti")
    return ordered.unionByName(fallback(rest) if fallback else rest.where(F.col("rank") < k).select("query_id", "doc_id", "rank", "score"))
