"""How well candidates fit what a session knows: attribute matches, weights, rescoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.functions import vocabulary as V
from quillsift.operators.lexical import ranked

#: Confidence where none is recorded, for a wanted value and for one that is only excluded.
WANTED, EXCLUDED = 0.80, 0.70
MATCHED = 0.60
NO_VALUE_SELECTIVITY = 0.65


def catalog_text(title: Column, categories: Column, attribute_text: Column, profile_text: Column, store: Column) -> Column:
    """All that is known of a product, as one text."""
    return F.concat_ws(" ", X.blank(title), X.joined(categories), F.coalesce(F.nullif(attribute_text, F.lit("")), X.blank(profile_text)), X.blank(store))


def with_tokens(products: DataFrame) -> DataFrame:
    """products with the token sets that matching reads: every_token, category_token."""
    text = catalog_text(*(F.col(c) for c in ("title120", "categories", "attribute_text", "profile_text", "store")))
    return products.withColumn("every_token", X.value_tokens(text)).withColumn("category_token", X.value_tokens(X.joined(F.col("categories"))))


def cached(attribute: Column) -> Column:
    """The product's own value of an attribute."""
    value = F.lit(None).cast("string")
    for a in V.ATTRIBUTES:
        value = F.when(attribute == a, F.col("attrs")[a]).otherwise(value)
    return value


def budget_match(value: Column, price: Column) -> Column:
    budget = value.try_cast("double")
    return F.when(budget.isNull(), 0.0).when(price.isNull(), 0.25).when(price <= budget, 1.0).when(price == 0, 0.0).otherwise(F.greatest(F.lit(0.0), budget / price - 0.25))


def match(attribute: Column, value: Column) -> Column:
    """From 0 to 1, how far a product (columns of with_tokens()) has an attribute's value.

    Five quarters of the share of the value's tokens that the product's text has, at most 1; a category looks at
    categories alone, a budget at the price.
    """
    wanted = X.value_tokens(value)
    own = F.when(attribute == "category", F.col("category_token")).otherwise(F.array_union("every_token", X.value_tokens(cached(attribute))))
    share = F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, own)) / F.size(wanted))
    return F.when(attribute == "budget", budget_match(value, F.col("price"))).otherwise(F.least(F.lit(1.0), 1.25 * share))


def attributes_of(slots: Column, negative: Column, no_preference: Column) -> Column:
    """Attributes that a session says something about, sorted."""
    against = F.map_keys(F.map_filter(negative, lambda k, v: F.size(v) > 0))
    return F.array_sort(F.array_except(F.array_union(F.map_keys(slots), against), no_preference))


def evidence(pool: DataFrame, products: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row for each candidate (query_id, doc_id) and attribute: matched, violated, weight (not yet in shares).

    sessions: query_id, slots, confidence, slot_turns, negative, no_preference, turn. An attribute weighs more when it is
    explicit, recent and selective in the pool.
    """
    said = sessions.withColumn("attribute", F.explode(attributes_of(F.col("slots"), F.col("negative"), F.col("no_preference"))))
    value = F.nullif(F.col("slots")[F.col("attribute")], F.lit(""))
    trust = F.coalesce(F.col("confidence")[F.col("attribute")], F.when(value.isNotNull(), WANTED).otherwise(EXCLUDED))
    age = F.greatest(F.lit(0), F.col("turn") - F.coalesce(F.col("slot_turns")[F.col("attribute")], F.lit(1)))
    prior = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in V.ATTRIBUTE_PRIORS.items() for x in kv)), F.col("attribute")), F.lit(1.0))
    said = said.select("query_id", "attribute", value.alias("value"), F.coalesce(F.col("negative")[F.col("attribute")], F.array().cast("array<string>")).alias("excluded"), (trust * F.greatest(F.lit(0.75), 1 - 0.04 * age) * prior).alias("strength"))
    rows = pool.select("query_id", "doc_id").join(said, "query_id").join(with_tokens(products).select("doc_id", "every_token", "category_token", "attrs", "price"), "doc_id")
    rows = rows.withColumn("matched", F.when(F.col("value").isNull(), 1.0).otherwise(match(F.col("attribute"), F.col("value"))))
    rows = rows.withColumn("violated", F.coalesce(F.array_max(F.transform("excluded", lambda v: match(F.col("attribute"), v))), F.lit(0.0)))
    share = F.avg((F.col("matched") >= MATCHED).cast("double")).over(Window.partitionBy("query_id", "attribute"))
    selective = F.when(F.col("value").isNull(), NO_VALUE_SELECTIVITY).otherwise(1 - share)
    return rows.withColumn("weight", F.col("strength") * (0.55 + 0.45 * selective)).select("query_id", "doc_id", "attribute", "matched", "violated", "weight")


def compatibility(pool: DataFrame, products: DataFrame, sessions: DataFrame) -> DataFrame:
    """(query_id, doc_id, compatibility, risk) for candidates of queries that anything is known of."""
    rows = evidence(pool, products, sessions)
    total = F.sum("weight")
    good = F.sum(F.col("weight") * F.col("matched") * (1 - F.col("violated"))) / total
    return rows.groupBy("query_id", "doc_id").agg(good.alias("compatibility"), (F.sum(F.col("weight") * F.col("violated")) / total).alias("risk"))


def evidence_weight(slots: Column, confidence: Column, negative: Column, most: float = 0.52) -> Column:
    """How much evidence counts against the lexical score."""
    units = F.aggregate(F.transform(F.map_keys(slots), lambda s: F.coalesce(confidence[s], F.lit(0.75))), F.lit(0.0), lambda a, c: a + c)
    against = F.size(F.map_filter(negative, lambda k, v: F.size(v) > 0))
    return F.least(F.lit(most), 0.18 + 0.10 * (units + 0.70 * against))


def rescore(pool: DataFrame, products: DataFrame, sessions: DataFrame, top_k: int = 100, most: float = 0.52) -> DataFrame:
    """pool (query_id, doc_id, rank, score, ...) by score and compatibility together; what it was made of stays.

    Candidates of queries without evidence keep their score and place. Scores are rounded to nine places, so that equal
    products tie. Adds lexical_score, compatibility, risk.
    """
    fit = compatibility(pool, products, sessions)
    weight = sessions.select("query_id", evidence_weight(F.col("slots"), F.col("confidence"), F.col("negative"), most).alias("e"))
    rows = pool.join(fit, ["query_id", "doc_id"], "left").join(weight, "query_id", "left")
    base = F.col("score") / F.coalesce(F.nullif(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(1.0))
    new = (1 - F.col("e")) * base + F.col("e") * (F.col("compatibility") - F.col("risk"))
    rows = rows.withColumn("lexical_score", F.col("score")).withColumn("score", F.round(F.when(F.col("compatibility").isNull(), F.col("score")).otherwise(new), 9))
    return ranked(rows.withColumnRenamed("rank", "before"), top_k, "before").drop("before", "e")
