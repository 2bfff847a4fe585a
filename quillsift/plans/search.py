"""One turn of many sessions: retrieval, the next question, and the ranking that is shown."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.operators import clarify, compat, dense, fusion, lexical, rerank
from quillsift.operators.lexical import Index
from quillsift.plans.lineage import gathered, settled
from quillsift.session import plain_unions
from quillsift.sources import config

FIELDS = ("title", "categories", "features", "description", "store", "details")


def product_index(products: DataFrame, terms: DataFrame | None = None) -> Index:
    """The index over a catalog's six fields, of all terms or of these alone; categories as one text."""
    columns = {f: X.joined(F.col(f)) if f == "categories" else F.col(f) for f in FIELDS}
    return lexical.build_index(products, columns, terms=terms)


@dataclass
class Engine:
    """What turns are answered from. encoded: doc_id with vectors (vector, or identity and attribute), if there are any."""

    products: DataFrame
    index: Index
    encoded: DataFrame | None = None
    settings: dict = field(default_factory=config.load)
    #: Applied to what several later steps read: gathered() where turns follow one another, else nothing.
    keep: Callable[..., DataFrame] | None = None

    #: A function of a prompt that names ids in a better order; none is shipped.
    model: Callable[[str], list[str] | None] | None = None

    def loop(self) -> Engine:
        """The same engine with all that every turn reads computed once."""
        index = Index(settled(self.index.postings), settled(self.index.terms), settled(self.index.corpus), self.index.fields)
        return Engine(settled(self.products), index, self.encoded, self.settings, gathered, self.model)

    def kept(self, df: DataFrame, wide: bool = False) -> DataFrame:
        return self.keep(df, wide) if self.keep else df

    def near(self, found: DataFrame) -> DataFrame:
        """The products that found names, as a table of their own where tables are kept; else all."""
        return self.keep(self.products.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), wide=True) if self.keep else self.products

    def lexical(self, sessions: DataFrame) -> DataFrame:
        """Candidates by BM25 and, if set, by what the session knows."""
        s = self.settings
        queries = sessions.withColumn("terms", X.query_terms(F.col("query")))
        dynamic = s["use_dynamic_attribute_scoring"]
        weights = lexical.field_weights(queries, s["field_weights"], s["dynamic_field_gain"]) if dynamic else s["field_weights"]
        k = s["retrieval_top_k"]
        pool = self.kept(lexical.ranked(lexical.bm25(self.index, queries, weights), 3 * k), wide=True)
        products = self.near(pool)
        if not dynamic:
            return lexical.fitting(pool, products, queries, k)
        found = lexical.fitting(pool, products, queries, 3 * k)
        return compat.rescore(found, products, sessions, k, s["dynamic_attribute_max_weight"])

    def retrieve(self, sessions: DataFrame) -> DataFrame:
        """query_id, doc_id, rank, score: lexical candidates, fused with dense ones where the gate opens.

        sessions: as turn() takes them, with `vector`, or `identity` and `attribute`, if there are encoded products. Only
        queries behind the gate meet the vectors.
        """
        plain_unions(sessions.sparkSession)
        s, found = self.settings, self.kept(self.lexical(sessions))
        if self.encoded is None or not s["use_dense"]:
            return found
        trust = fusion.confidence(found)
        sizes = found.groupBy("query_id").agg(F.count("*").alias("rows"))
        state = sessions.select("query_id", "track", F.size("slots").alias("n_slots"), F.col("slots")["category"].alias("category")).join(sizes, "query_id", "left").join(trust, "query_id", "left")
        state = state.withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        needed = fusion.gate(F.col("rows"), F.col("n_slots"), F.col("category"), F.col("confidence"), s["dense_gate_min_bm25"], s["dense_gate_max_confidence"]) if s["use_dense_risk_gate"] else F.lit(True)
        open_ = state.where((F.col("track") != "buying") & needed)
        asking = sessions.join(open_.select("query_id"), "query_id", "left_semi")
        if "identity" in self.encoded.columns:
            identity, attribute = dense.vector_weights(asking)
            near = dense.two_field_top_k(asking.withColumn("w_identity", identity).withColumn("w_attribute", attribute), self.encoded, s["retrieval_top_k"])
        else:
            near = dense.top_k(asking, self.encoded, s["retrieval_top_k"])
        early = list(zip(*s["browsing_weights"], strict=True)) or [(), ()]
        weight, other = (fusion.stage_weight(F.col("n_slots"), base, stages) for base, stages in zip((s["bm25_base"], s["dense_base"]), early, strict=True))
        sure = fusion.confidence(near).withColumnRenamed("confidence", "dense_confidence")
        both = open_.join(sure, "query_id", "left").withColumn("dense_confidence", F.coalesce("dense_confidence", F.lit(0.0)))
        if s["use_adaptive_fusion"]:
            weight = fusion.adaptive_weight(F.col("n_slots"), weight, F.col("confidence"), F.col("dense_confidence"))
            other = 1 - weight
        weights = both.select("query_id", weight.alias("lexical_weight"), other.alias("dense_weight"))
        fused = fusion.fuse(found.join(weights.select("query_id"), "query_id", "left_semi"), near, weights, s["retrieval_top_k"], s["rrf_k"])
        rest = found.join(weights.select("query_id"), "query_id", "left_anti").select("query_id", "doc_id", "rank", "score")
        return self.kept(rest.unionByName(fused.select("query_id", "doc_id", "rank", "score")), wide=True)

    def turn(self, sessions: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
        """(query_id, doc_id, rank, score) shown, and (query_id, ask), for one turn of all sessions.

        sessions: query_id, query, track, slots, confidence, slot_turns, negative, no_preference, asked, tags, turn. The
        question looks at all retrieved candidates, the ranking at the first of them.
        """
        s, found = self.settings, self.retrieve(sessions)
        products = self.near(found)
        pool = found.join(products.select("doc_id", "attrs"), "doc_id").select("query_id", "doc_id", "attrs")
        asked = clarify.ask(sessions, pool, s["entropy_tau"], s["use_early_stop"], s["use_dynamic_entropy"], s["min_pool_for_dynamic"])
        if self.model is not None:
            return self.by_model(found, products, sessions, top), asked
        shown = self.local(found, products, sessions, top)
        return shown, asked

    def local(self, found: DataFrame, products: DataFrame, sessions: DataFrame, top: int) -> DataFrame:
        s = self.settings
        return rerank.rerank(found, products, sessions, s, top) if s["use_features"] else found.where(F.col("rank") < top).select("query_id", "doc_id", "rank", "score")

    def by_model(self, found: DataFrame, products: DataFrame, sessions: DataFrame, top: int) -> DataFrame:
        """The first candidates, fewer while little is known, in the model's order; where it gives none, as local() ranks."""
        s = self.settings
        head = clarify.truncated(found, sessions, s["few_slots_threshold"], s["pool_size_threshold"], s["truncated_size"]).where(F.col("rank") < s["rerank_top_n"])
        head = self.kept(head.select("query_id", "doc_id", "rank", "score"))
        named = head.join(products.select("doc_id", "title120"), "doc_id").join(sessions.select("query_id", F.to_json("slots").alias("slots")), "query_id")
        line = lambda x: F.concat(x["doc_id"].cast("string"), F.lit(": "), F.substring(x["title120"], 1, 80))
        prompt = F.concat(F.lit("Known: "), F.first("slots"), F.lit("\nProducts:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title120"))), line), "\n"))
        fallback = lambda rest: self.local(rest.select("query_id", "doc_id", "rank", "score"), products, sessions, top)
        return rerank.model_order(named, prompt, self.model, top, fallback)
