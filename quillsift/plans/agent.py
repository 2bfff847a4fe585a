"""One session at a time: reset, then a response to each message. Many sessions together are what Engine is for."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillsift.functions.session import close, new_state, step
from quillsift.plans.search import Engine

KINDS = (
    "query_id string, query string, track string, slots map<string,string>, confidence map<string,double>, slot_turns map<string,int>, "
    "negative map<string,array<string>>, no_preference array<string>, asked array<string>, tags array<string>, turn int"
)


class Agent:
    """Keeps its sessions' states on the driver; an unknown session starts anew with every message and is not kept."""

    def __init__(self, spark: SparkSession, engine: Engine):
        self.spark, self.engine, self.sessions = spark, engine, {}

    def reset(self, session_id: str, profile: dict[str, Any] | None = None) -> None:
        """Begins a session, or begins it again."""
        self.sessions[session_id] = new_state(), list((profile or {}).get("preference_tags") or [])

    def respond(self, session_id: str, message: str, top_k: int = 10) -> dict[str, Any]:
        """message, ask_attribute (or None), recommendations (id and score, best first) and usage."""
        settings = self.engine.settings
        state, tags = self.sessions.get(session_id, (new_state(), []))
        done = step(state, message, settings["use_override_detection"], settings["use_reply_purification"], settings["override_carryover_confidence"])
        kept = tuple(dict(state[k]) for k in ("slots", "confidence", "slot_turns", "negative"))
        row = (session_id, done["query"], done["track"], *kept, list(state["no_preference"]), list(state["asked"]), tags, done["turn"])
        shown, asked = self.engine.turn(self.spark.createDataFrame([row], KINDS), top_k)
        best = [(r["doc_id"], r["score"]) for r in shown.orderBy("rank").limit(top_k).collect()]
        ask = (asked.select("ask").first() or [None])[0]
        close(state, message, str(best[0][0]) if best else None, ask)
        return {
            "message": said(ask, bool(best)), "ask_attribute": ask, "recommendations": [{"parent_asin": str(d), "score": s} for d, s in best],
            "usage": {"prompt_tokens": 0, "completion_tokens": 0},
        }


def said(ask: str | None, ranked: bool) -> str:
    """The agent's words; the same as dialogue.answer() gives as a column."""
    if ask:
        return f"Here are some options. Could you tell me your preference for {ask}?"
    return "Here are my top picks based on your request." if ranked else "I couldn't find a match. Could you describe what you're looking for?"


def trace(engine: Engine, samples, catalog, turns: int = 10):
    """sample_id, turn, shown (titles in order), target_rank (null: not among them): how sessions went, turn by turn."""
    from quillsift.plans.simulate import play

    titles = engine.products.select("doc_id", F.col("title120").alias("title"))
    rows = play(engine, samples, catalog, turns).join(titles, "doc_id").join(samples.select("sample_id", "target"), "sample_id")
    found = rows.groupBy("sample_id", "turn").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("shown"), F.min(F.when(F.col("doc_id") == F.col("target"), F.col("rank"))).alias("target_rank"))
    return found.select("sample_id", "turn", F.transform("shown", lambda x: x["title"]).alias("shown"), "target_rank")


def ablation(engine: Engine, samples, catalog, toggles: dict[str, dict[str, Any]], turns: int = 10) -> dict[str, Any]:
    """The overall summary of each named change of settings, as a row."""
    from quillsift.plans.simulate import evaluate

    out = {}
    for name, change in toggles.items():
        _, summary = evaluate(Engine(engine.products, engine.index, engine.encoded, engine.settings | change), samples, catalog, turns)
        out[name] = summary.where("scenario_type = 'overall'").first()
    return out
