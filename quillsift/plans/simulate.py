"""Simulated shoppers: up to ten turns of all sessions together, and how they end."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import dialogue as D
from quillsift.functions import vocabulary as V
from quillsift.functions.session import close, new_state, step
from quillsift.operators import metrics
from quillsift.plans.lineage import forget, gathered, settled
from quillsift.plans.search import Engine
from quillsift.session import plain_unions

SESSION = (
    "sample_id string, state string, query string, track string, slots map<string,string>, confidence map<string,double>, slot_turns map<string,int>, "
    "negative map<string,array<string>>, no_preference array<string>, asked array<string>, turn int, tags array<string>"
)


def shoppers(samples: DataFrame, products: DataFrame) -> DataFrame:
    """samples (sample_id, scenario_type, target, override_turn, tags) with what each shopper wants and first says.

    products: doc_id with the fields of a catalog (features an array, details a map). Adds constraints, hard, soft,
    message, disclosed, override_message and credit_from, the first turn whose hits count.
    """
    fields = {f: F.col(f"p.{f}") for f in ("title", "categories", "features", "details", "description", "store", "price")}
    rows = samples.join(products.select(F.col("doc_id").alias("target"), F.struct(*fields_of(products)).alias("p")), "target")
    rows = rows.withColumn("card", D.intent_card(fields)).withColumn("category", D.coarse_category(F.col("p.categories")))
    hard, soft = F.col("card.hard_constraints"), F.col("card.soft_preferences")
    old = F.element_at(soft, -1)
    override = F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), F.get(hard, F.lit(0)), F.lit("."))
    changing = F.col("scenario_type") == "intent_override"
    return rows.select(
        "sample_id", "scenario_type", "target", "tags", F.when(changing, F.coalesce("override_turn", F.lit(3))).alias("override_turn"), F.concat(hard, soft).alias("constraints"),
        D.opening(F.col("scenario_type"), F.col("category"), hard, old).alias("message"), F.when(changing, override).alias("override_message"),
        F.when(F.col("scenario_type") == "buying", F.slice(hard, 1, 1)).otherwise(F.slice(hard, 1, 0)).alias("disclosed"),
        F.when(changing, F.coalesce("override_turn", F.lit(3))).otherwise(1).alias("credit_from"), F.lit(False).alias("declined"),
    )


def fields_of(products: DataFrame) -> list[Column]:
    return [F.col(f) for f in ("title", "categories", "features", "details", "description", "store", "price")]


def reply(rows: DataFrame, turn: int) -> DataFrame:
    """rows with the next message, after the question `ask` of this turn, and what is disclosed by it.

    At its turn an override is announced whatever was asked. A boundary shopper declines once. Otherwise the first two
    constraints of the asked kind that were not disclosed yet; of any kind if the question is "other" or of no known kind.
    """
    kind = F.when(F.col("ask").isin(*V.ASKABLE), F.col("ask")).otherwise("other")
    fits = lambda c: ~F.array_contains("disclosed", c) & ((kind == "other") | (D.kind_column(c, V.SHORT_COLORS) == kind))
    told = F.slice(F.filter("constraints", fits), 1, 2)
    overriding = F.coalesce(F.col("override_turn") == turn + 1, F.lit(False))
    declining = (F.col("scenario_type") == "boundary") & ~F.col("declined") & F.col("ask").isNotNull() & ~overriding
    answering = F.col("ask").isNotNull() & ~overriding & ~declining
    message = (
        F.when(overriding, F.col("override_message"))
        .when(declining, F.concat(F.lit("I don't have a preference for "), F.col("ask"), F.lit("; please use your judgment.")))
        .when(F.col("ask").isNull(), F.lit("Those options are not quite right yet. Ask me about one specific attribute."))
        .when(F.size(told) == 0, F.concat(F.lit("I don't have an additional preference for "), kind, F.lit(".")))
        .otherwise(F.concat(F.lit("For that, what matters is: "), F.array_join(told, "; "), F.lit(".")))
    )
    return rows.withColumn("told", told).withColumn("next", message).withColumn("declined", F.col("declined") | declining).withColumn("disclosed", F.when(answering, F.array_union("disclosed", "told")).otherwise(F.col("disclosed"))).drop("told")


def step_all(rows: DataFrame, settings: dict) -> DataFrame:
    """Each session's state (text) after its message, with what the turn searches with; one row a session, so no shuffle."""
    how = settings["use_override_detection"], settings["use_reply_purification"], settings["override_carryover_confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sample, text, message, tags in zip(batch["sample_id"], batch["state"], batch["message"], batch["tags"], strict=True):
                state = json.loads(text) if text else new_state()
                done = step(state, message, *how)
                kept = {k: dict(state[k]) for k in ("slots", "confidence", "slot_turns", "negative")}
                out.append({"sample_id": sample, "state": json.dumps(state), "query": done["query"], "track": done["track"], **kept, "no_preference": state["no_preference"], "asked": state["asked"], "turn": done["turn"], "tags": tags})
            yield pd.DataFrame(out, columns=["sample_id", "state", "query", "track", "slots", "confidence", "slot_turns", "negative", "no_preference", "asked", "turn", "tags"])

    return rows.select("sample_id", "state", "message", "tags").mapInPandas(run, SESSION)


def close_all(rows: DataFrame) -> DataFrame:
    """(sample_id, state) after each turn's question and first recommendation went into the history."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sample, text, message, ask, top in zip(batch["sample_id"], batch["state"], batch["message"], batch["ask"], batch["top"], strict=True):
                state = json.loads(text)
                close(state, message, top, ask)
                out.append((sample, json.dumps(state)))
            yield pd.DataFrame(out, columns=["sample_id", "state"])

    return rows.select("sample_id", "state", "message", "ask", "top").mapInPandas(run, "sample_id string, state string")


def play(engine: Engine, samples: DataFrame, catalog: DataFrame, turns: int = metrics.TURNS, top: int = metrics.TOP) -> DataFrame:
    """(sample_id, turn, doc_id, rank) of all recommendations until each session's hit, or to the last turn.

    One batch of all sessions that go on is answered in each turn; between turns lineage is cut. samples: as shoppers()
    takes them, sample_id text. catalog: the products with the fields that shoppers look at.
    """
    plain_unions(samples.sparkSession)
    engine = engine.loop()
    going = gathered(shoppers(samples, catalog).withColumn("state", F.lit(None).cast("string")), wide=True)
    shown_before = None
    for turn in range(1, turns + 1):
        stepped = gathered(step_all(going, engine.settings))
        shown, asked = engine.turn(stepped.withColumnRenamed("sample_id", "query_id"), top)
        shown = gathered(shown.select(F.col("query_id").alias("sample_id"), F.lit(turn).alias("turn"), "doc_id", (F.col("rank") + 1).alias("rank")))
        shown_before = shown if shown_before is None else shown_before.unionByName(shown)
        if turn == turns:
            break
        hit = shown.join(going.where(F.col("credit_from") <= turn).select("sample_id", "target"), "sample_id").where(F.col("doc_id") == F.col("target")).select("sample_id").distinct()
        first = shown.where("rank = 1").select("sample_id", F.col("doc_id").cast("string").alias("top"))
        kept = going.drop("state").join(hit, "sample_id", "left_anti").join(stepped.select("sample_id", "state"), "sample_id")
        kept = kept.join(asked.select(F.col("query_id").alias("sample_id"), "ask"), "sample_id", "left").join(first, "sample_id", "left")
        kept = gathered(reply(kept, turn))
        before = going, stepped, kept
        going = gathered(kept.drop("state", "message", "ask", "top").withColumnRenamed("next", "message").join(close_all(kept), "sample_id"))
        forget(going.sparkSession, *before)
        if going.isEmpty():
            break
    return shown_before


def evaluate(engine: Engine, samples: DataFrame, catalog: DataFrame, turns: int = metrics.TURNS) -> tuple[DataFrame, DataFrame]:
    """Outcomes of all sessions, and their summary overall and by scenario."""
    credit = F.when(F.col("scenario_type") == "intent_override", F.coalesce("override_turn", F.lit(3))).otherwise(1)
    sessions = settled(metrics.outcomes(play(engine, samples, catalog, turns), samples.withColumn("credit_from", credit)))
    return sessions, metrics.summary(sessions)
