"""Earlier ways of searching, fusing and asking, where their results differ from those of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.functions import vocabulary as V
from quillsift.functions.session import close, new_state, query, track
from quillsift.operators import clarify, dense, fusion, lexical
from quillsift.operators.lexical import Index
from quillsift.session import plain_unions

# Field weights of the first baseline.
STARTER_WEIGHTS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}


def search(index: Index, products: DataFrame, queries: DataFrame, top_k: int = 100) -> DataFrame:
    """Lexical candidates with fixed weights; only the budget filters, on every track, and nothing is rescored."""
    pool = lexical.ranked(lexical.bm25(index, queries), 3 * top_k)
    side = queries.select("query_id", F.col("slots")["budget"].try_cast("double").alias("limit"))
    rows = pool.join(side, "query_id").join(products.select("doc_id", "price"), "doc_id")
    kept = rows.where(F.col("limit").isNull() | F.col("price").isNull() | (F.col("price") <= F.col("limit")))
    return lexical.ranked(kept.select("query_id", "doc_id", "score", F.col("rank").alias("before")), top_k, "before").drop("before")


def fuse(found: DataFrame, near: DataFrame, queries: DataFrame, top_k: int = 100) -> DataFrame:
    """Both lists with weights by the number of slots alone; buying queries keep their lexical list."""
    plain_unions(queries.sparkSession)
    browsing = queries.where("track <> 'buying'")
    weight = fusion.stage_weight(F.size("slots"))
    weights = browsing.select("query_id", weight.alias("lexical_weight"), (1 - weight).alias("dense_weight"))
    fused = fusion.fuse(found.join(weights.select("query_id"), "query_id", "left_semi"), near.join(weights.select("query_id"), "query_id", "left_semi"), weights, top_k)
    rest = found.join(weights.select("query_id"), "query_id", "left_anti").select("query_id", "doc_id", "rank", "score")
    return rest.unionByName(fused.select("query_id", "doc_id", "rank", "score"))


def nearest(queries: DataFrame, encoded: DataFrame, k: int = 100) -> DataFrame:
    """Dense candidates by one vector; fewer documents than k are no error."""
    return dense.top_k(queries, encoded, k)


def ask(sessions: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, ask): always a question. Slots count as known whatever their confidence, and "other" is what is left."""
    certain = sessions.withColumn("confidence", F.transform_values("slots", lambda k, v: F.lit(1.0)))
    found = clarify.ask(certain, pool, early_stop=False)
    return found.select("query_id", F.coalesce("ask", F.lit("other")).alias("ask"))


def step(state: dict, message: str | None) -> dict:
    """A session without purification, confidence, snapshot or "looking for": an override clears slots and questions."""
    import re

    from quillsift.functions.dialogue import IGNORE, listed_slots, stated_slots

    message = message or ""
    if re.search(V.OVERRIDE, message, IGNORE):
        state |= {"scenario": "intent_override", "override_applied": True, "slots": {}, "asked": []}
    elif re.search(V.BOUNDARY, message, IGNORE):
        state["boundary"] = True
    elif not state["history"]:
        state["scenario"] = "buying" if re.search(V.BUYING, message, IGNORE) else "browsing"
    state["last_query"] = message
    lists = re.search(V.MATTERS, message, IGNORE) or re.search(V.NEED, message, IGNORE) or re.search(V.REQUIREMENT, message, IGNORE)
    free = {k: v for k, v in stated_slots(message).items() if k not in state["slots"]}
    state["slots"] |= listed_slots(lists[1]) if lists else free
    return {"query": query(state, message), "track": track(state), "turn": len(state["history"]) + 1}


def run(messages: list[str | None]) -> list[dict]:
    """step() over a session's messages."""
    state, out = new_state(), []
    for message in messages:
        out.append(step(state, message) | {"slots": dict(state["slots"])})
        close(state, message)
    return out


def starter(index: Index, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """The first baseline: the message's terms alone, fixed weights that favour details over descriptions, no session."""
    return lexical.ranked(lexical.bm25(index, queries, {f: STARTER_WEIGHTS[f] for f in index.fields}), top_k)


def folded(text):
    """Text without marks on letters, for an index that is to find them without."""
    marked, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
    return F.translate(X.blank(text), marked, plain)


def pass_through(pool: DataFrame, top_k: int = 10) -> DataFrame:
    """The first candidates as they are, as a ranker without a model gives them."""
    return pool.where(F.col("rank") < top_k).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
