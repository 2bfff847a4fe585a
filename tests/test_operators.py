"""Retrieval, ranking, clarification and evaluation operators on golden cases."""

import math

import pytest
from pyspark.sql import functions as F

from quillsift.operators import clarify, compat, dense, fusion, lexical, metrics, rerank, selection
from quillsift.sources.catalog import derived

SESSION = "query_id long, slots map<string,string>, confidence map<string,double>, slot_turns map<string,int>, negative map<string,array<string>>, no_preference array<string>, asked array<string>, tags array<string>, turn int, track string, query string"


def sessions(spark, *rows):
    base = {"slots": {}, "confidence": {}, "slot_turns": {}, "negative": {}, "no_preference": [], "asked": [], "tags": [], "turn": 1, "track": "browsing", "query": ""}
    return spark.createDataFrame([tuple((base | {"query_id": k + 1} | r)[c.split()[0]] for c in SESSION.split(", ")) for k, r in enumerate(rows)], SESSION)


def products(spark, *rows):
    base = {"title": "", "categories": [], "features": "", "details": "", "description": "", "store": "", "price": None, "rating_number": 0}
    kinds = "doc_id string, title string, categories array<string>, features string, details string, description string, store string, price double, rating_number long"
    return derived(spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds))


def pool(spark, *rows):
    return spark.createDataFrame([(1, d, r, float(s)) for r, (d, s) in enumerate(rows)], "query_id long, doc_id string, rank int, score double")


def order(found):
    return [r["doc_id"] for r in found.orderBy("rank").collect()]


def test_bm25_against_its_formula(spark):
    docs = spark.createDataFrame([("a", "red ring", "gold"), ("b", "red red shoe", ""), ("c", "blue", "red"), ("d", None, "green")], "doc_id string, title string, store string")
    index = lexical.build_index(docs, {"title": F.col("title"), "store": F.col("store")})
    queries = spark.createDataFrame([(1, ["ring", "blue"])], "query_id long, terms array<string>")
    got = {r["doc_id"]: r["score"] for r in lexical.bm25(index, queries, {"title": 6.0, "store": 1.5}).collect()}
    idf, average = math.log((4 - 1 + 0.5) / 1.5), (3 + 3 + 2 + 1) / 4
    want = {d: idf * 6 * 2.2 / (6 + 1.2 * (0.25 + 0.75 * n / average)) for d, n in (("a", 3), ("c", 2))}
    assert got == pytest.approx(want)
    common = lexical.bm25(index, spark.createDataFrame([(1, ["red"])], "query_id long, terms array<string>"))
    assert all(0 < r["score"] < 1e-5 for r in common.collect())


def test_index_is_dealt_by_document(spark, monkeypatch):
    """A task's tokens are bounded whatever the files, a document's postings lie together, and scores are summed there."""
    monkeypatch.setattr(lexical, "TOKENS", 50)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("red ring w"), F.col("id")).alias("title"), F.when(F.col("id") % 3 == 0, "Red").alias("store")).coalesce(1)
    index = lexical.build_index(docs, {"title": F.col("title"), "store": F.col("store")})
    assert index.postings.rdd.getNumPartitions() == 1000 // 50
    at = index.postings.select("doc_id", F.spark_partition_id().alias("at")).groupBy("doc_id").agg(F.countDistinct("at").alias("n"))
    assert at.where("n > 1").count() == 0 and at.count() == 300
    scores = lexical.bm25(index, spark.createDataFrame([(1, ["red", "w3"])], "query_id long, terms array<string>"))
    assert scores.count() == 300 and "hashpartitioning(query_id" not in scores._jdf.queryExecution().executedPlan().toString()
    known = {r["term"]: r["df"] for r in index.terms.where("term in ('red', 'w3')").collect()}
    assert known == {"red": 300, "w3": 1} and index.postings.agg(F.sum("tf_title"), F.sum("tf_store")).first()[:] == (900, 100)


def test_index_counts_odd_documents(spark):
    """Documents without tokens or texts count in the corpus; rows of one id and length are one posting; only asked terms are kept."""
    rows = [(1, "red red ring", None), (1, "ring blue", "gold"), (2, None, None), (3, "!?", ""), (4, "ring", "ring red")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, store string")
    terms = spark.createDataFrame([("ring",), ("gold",), ("none",), ("ring",)], "term string")
    index = lexical.build_index(docs, {"title": F.col("title"), "store": F.col("store")}, terms=terms)
    assert sorted(tuple(r) for r in index.postings.select("term", "doc_id", "len", "tf_title", "tf_store").collect()) == [("gold", 1, 3, 0, 1), ("ring", 1, 3, 2, 0), ("ring", 4, 3, 1, 1)]
    assert index.corpus.first()[:] == (5, 9 / 5) and {tuple(r) for r in index.terms.collect()} == {("ring", 2), ("gold", 1)}
    none = lexical.build_index(docs.where("false"), {"title": F.col("title"), "store": F.col("store")})
    assert none.corpus.first()[:] == (0, None) and none.postings.count() == 0


def test_ranked_keeps_the_best_of_each_partition_first(spark):
    scored = spark.range(1000).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("score"))
    found = lexical.ranked(scored, 3)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in found.orderBy("query_id", "rank").collect()] == [(0, 0, 6), (0, 1, 20), (0, 2, 34), (1, 0, 13), (1, 1, 27), (1, 2, 41)]


def test_evidence_raises_field_weights(spark):
    table = sessions(spark, {}, {"slots": {"category": "shoes", "feature": "waterproof"}, "confidence": {"category": 0.9}})
    weights = lexical.field_weights(table)
    low, high = table.select("query_id", *(w.alias(f) for f, w in weights.items())).orderBy("query_id").collect()
    assert low.asDict() == {"query_id": 1} | {k: v for k, v in low.asDict().items() if k != "query_id"} and low["title"] == 6.0
    assert high["categories"] == pytest.approx(4 * (1 + 0.65 * 0.9)) and high["features"] > low["features"] and high["store"] == low["store"]


def test_budget_keeps_unknown_prices(spark):
    rows = spark.createDataFrame([(1, "a", 0, None, "50", [], None), (1, "b", 1, None, "50", [], 12.99), (1, "c", 2, None, "50", [], 75.0), (2, "c", 0, None, "cheap", [], 75.0)], "query_id long, doc_id string, rank int, category string, budget string, categories array<string>, price double")
    assert {(r["query_id"], r["doc_id"]) for r in lexical.filter_by_slots(rows).collect()} == {(1, "a"), (1, "b"), (2, "c")}


def test_category_filter_never_leaves_nothing(spark):
    kinds = "query_id long, doc_id string, rank int, category string, budget string, categories array<string>, price double"
    rows = spark.createDataFrame([(1, "a", 0, "shoes", None, ["Men Shoes"], None), (1, "b", 1, "shoes", None, ["Hats"], None), (2, "b", 0, "rings", None, ["Hats"], None), (3, "b", 0, "x", None, ["Hats"], None)], kinds)
    assert {(r["query_id"], r["doc_id"]) for r in lexical.filter_by_slots(rows).collect()} == {(1, "a"), (2, "b"), (3, "b")}


def test_dense_top_k_over_many_batches(spark):
    """What a task keeps from batch to batch ends as the best of all, ties by id."""
    import numpy as np

    rng = np.random.default_rng(2)
    queries, vectors = rng.integers(-2, 3, (7, 4)).astype(float), rng.integers(-2, 3, (90, 4)).astype(float)
    q = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(queries)] + [("none", None), ("short", [1.0])], "query_id string, vector array<double>")
    d = spark.createDataFrame([(f"d{k:02d}", v.tolist()) for k, v in enumerate(vectors)] + [("gone", None)], "doc_id string, vector array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        found = {(r["query_id"], r["rank"]): r["doc_id"] for r in dense.top_k(q, d, 6).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = min(rank for _, rank in found)
    for k, v in enumerate(queries):
        want = sorted(range(90), key=lambda j, v=v: (-(vectors[j] @ v), f"d{j:02d}"))[:6]
        assert [found[f"q{k}", first + r] for r in range(6)] == [f"d{j:02d}" for j in want]
    assert len(found) == 42


def test_dense_top_k_in_blocks(spark):
    docs = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(50)] + [(99, None), (98, [1.0])], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in (3, 7, 9)] + [(4, None)], "query_id long, vector array<double>")
    whole = sorted(tuple(r) for r in dense.top_k(queries, docs, 5).select("query_id", "rank", "doc_id").collect())
    assert whole == sorted(tuple(r) for r in dense.top_k(queries, docs, 5, block=1).select("query_id", "rank", "doc_id").collect())
    assert [d for q, r, d in whole if q == 3][0] == 3 and len(whole) == 15


def test_dense_queries_by_field(spark):
    table = sessions(spark, {"slots": {"category": "lighting", "color": "black"}})
    a, b = dense.field_queries(F.lit("desk lamp"), F.col("slots"))
    assert tuple(table.select(a, b).first()) == ("query: lighting desk lamp", "query: black desk lamp")


def test_encoder_gives_unit_vectors(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["vector"] for r in dense.encode(docs, lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == got[3] == [0.0, 0.0]


def test_rrf_and_fusion(spark):
    first, late = spark.range(1).select(fusion.rrf(F.lit(0)), fusion.rrf(F.lit(10))).first()
    assert first > late > 0
    a, b = pool(spark, ("A", 2), ("B", 1)), pool(spark, ("B", 2), ("C", 1))
    assert set(order(fusion.fuse(a, b, top_k=10))) == {"A", "B", "C"} and len(order(fusion.fuse(a, b, top_k=1))) == 1
    weighted = fusion.fuse(pool(spark, ("BM25", 1)), pool(spark, ("DENSE", 1)), (0.1, 0.9), k=0)
    assert order(weighted) == ["DENSE", "BM25"] and weighted.first()["score"] == pytest.approx(0.9)
    assert order(fusion.fuse(pool(spark, ("L", 1)), pool(spark, ("D", 1)), (0.5, 0.5))) == ["L", "D"]


def test_fusion_of_lists_whose_partitions_are_coalesced_apart(spark):
    """One list comes from a semi-join of few rows, the other from many: their partitions must not be taken for the same."""
    many = spark.range(20_000).select((F.col("id") % 50).alias("query_id"), F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    few = spark.range(500).select((F.col("id") % 50).alias("query_id"), F.col("id").alias("doc_id"), F.rand(2).alias("score"))
    a, b = lexical.ranked(many, 400), lexical.ranked(few, 10)
    kept = few.select("query_id").where("query_id % 7 = 0").distinct()
    found = fusion.fuse(a.join(kept, "query_id", "left_semi"), b.join(kept, "query_id", "left_semi"), top_k=1000)
    assert found.count() == found.select("query_id", "doc_id").distinct().count() == 8 * 400


def test_confidence_and_adaptive_weights(spark):
    sharp, flat = (fusion.confidence(pool(spark, ("a", 1.0), ("b", s))).first()["confidence"] for s in (0.1, 0.98))
    assert sharp > flat and fusion.confidence(pool(spark, ("a", 1.0))).first()["confidence"] == 0
    w = spark.range(1).select(fusion.adaptive_weight(F.lit(0), F.lit(0.5), F.lit(sharp), F.lit(flat))).first()[0]
    assert 0.5 < w <= 0.9
    stages = spark.range(3).select(fusion.stage_weight(F.col("id"))).collect()
    assert [r[0] for r in stages] == [0.50, 0.60, 0.75]


@pytest.mark.parametrize(("rows", "slots", "category", "trust", "opened"), [(30, 2, "shoes", 0.0, False), (5, 2, "shoes", 0.9, True), (30, 1, None, 0.05, True), (30, 1, None, 0.5, False)])
def test_gate(spark, rows, slots, category, trust, opened):
    assert spark.range(1).select(fusion.gate(F.lit(rows), F.lit(slots), F.lit(category).cast("string"), F.lit(trust))).first()[0] is opened


@pytest.mark.parametrize(("values", "entropy"), [("abcd", 1.0), ("a", 0.0), ("aaaa", 0.0)])
def test_entropy(spark, values, entropy):
    table = spark.createDataFrame([(1, v) for v in values], "k int, value string")
    assert clarify.entropies(table, ["k"]).first()["entropy"] == pytest.approx(entropy)


def lamps(spark, n, **attrs):
    rows = [(1, f"B{k:03d}", {a: v[k % len(v)] for a, v in attrs.items()}) for k in range(n)]
    names = clarify.V.ATTRIBUTES
    return spark.createDataFrame([(q, d, tuple(a.get(x) for x in names)) for q, d, a in rows], f"query_id long, doc_id string, attrs struct<{','.join(f'{x}:string' for x in names)}>")


def test_ask(spark):
    found = lamps(spark, 20, use_case=["office", "gym", "beach", "party", "work"], material=["wool"])
    assert clarify.ask(sessions(spark, {}), found).first()["ask"] == "use_case"
    known = {a: "x" for a in clarify.V.ATTRIBUTES}
    assert clarify.ask(sessions(spark, {"slots": known}), found, early_stop=False).first()["ask"] is None
    assert clarify.ask(sessions(spark, {"slots": known}), found).first()["ask"] == "other"
    assert clarify.ask(sessions(spark, {}), found, threshold=0.9).first()["ask"] == "other"
    assert clarify.ask(sessions(spark, {"asked": ["use_case"]}), found, early_stop=False).first()["ask"] != "use_case"
    assert clarify.ask(sessions(spark, {}), found.limit(0)).first()["ask"] == "other"
    assert clarify.ask(sessions(spark, {}), found.limit(0), early_stop=False).first()["ask"] == "use_case"


@pytest.mark.parametrize(("size", "slots", "left"), [(60, {}, 20), (60, {"a": "x", "b": "y"}, 60), (30, {}, 30)])
def test_pool_truncation(spark, size, slots, left):
    found = pool(spark, *((f"d{k}", size - k) for k in range(size)))
    assert clarify.truncated(found, sessions(spark, {"slots": slots})).count() == left


def test_weights_follow_selectivity(spark):
    known = products(spark, {"doc_id": "a", "title": "red cotton"}, {"doc_id": "b", "title": "red wool"}, {"doc_id": "c", "title": "blue wool"})
    state = sessions(spark, {"slots": {"color": "red", "material": "cotton"}, "confidence": {"color": 1.0, "material": 1.0}})
    found = compat.evidence(pool(spark, ("a", 1), ("b", 1), ("c", 1)), known, state)
    weight = {r["attribute"]: r["weight"] for r in found.collect()}
    assert weight["material"] > weight["color"]


def test_exclusions_are_risks(spark):
    known = products(spark, {"doc_id": "B000", "title": "red shoe"}, {"doc_id": "B001", "title": "blue shoe"})
    found = compat.compatibility(pool(spark, ("B000", 1), ("B001", 1)), known, sessions(spark, {"negative": {"color": ["red"]}}))
    risk = {r["doc_id"]: r["risk"] for r in found.collect()}
    assert risk["B000"] > risk["B001"] == 0
    again = compat.rescore(pool(spark, ("B000", 2), ("B001", 2)), known, sessions(spark, {"negative": {"color": ["red"]}}))
    assert order(again) == ["B001", "B000"]


def test_budget_matches(spark):
    known = products(spark, {"doc_id": "a", "price": 40.0}, {"doc_id": "b", "price": 100.0}, {"doc_id": "c"})
    found = compat.evidence(pool(spark, ("a", 1), ("b", 1), ("c", 1)), known, sessions(spark, {"slots": {"budget": "50"}}))
    assert {r["doc_id"]: r["matched"] for r in found.collect()} == {"a": 1.0, "b": 0.25, "c": 0.25}


def test_nothing_known_changes_nothing(spark):
    found = compat.rescore(pool(spark, ("a", 3), ("b", 2)), products(spark, {"doc_id": "a"}, {"doc_id": "b"}), sessions(spark, {}))
    assert [(r["doc_id"], r["score"]) for r in found.orderBy("rank").collect()] == [("a", 3.0), ("b", 2.0)]


def test_only_the_first_twenty_are_reranked(spark):
    rows = [(f"d{k:02d}", 30 - k) for k in range(20)] + [("d20", 9999)]
    known = products(spark, *({"doc_id": d, "title": d} for d, _ in rows))
    shown = order(rerank.rerank(pool(spark, *rows), known, sessions(spark, {})))
    assert len(shown) == 10 and "d20" not in shown and shown[0] == "d00"


def test_profile_puts_matching_products_first(spark):
    known = products(spark, {"doc_id": "a", "title": "running shoes"}, {"doc_id": "b", "title": "comfortable running shoes"})
    boosted = rerank.profile_boost(pool(spark, ("a", 1.0), ("b", 1.0)), known, sessions(spark, {"tags": ["comfort"]}), 1.0)
    score = {r["doc_id"]: r["score"] for r in boosted.collect()}
    assert score == {"a": 1.0, "b": pytest.approx(1.5)}


def test_diversity_prefers_unlike_products(spark):
    rows = [("a", 0, 1.0, ["red", "shoe"]), ("b", 1, 0.99, ["red", "shoe"]), ("c", 2, 0.9, ["hat"]), ("d", 3, 0.9, ["hat"])]
    scored = spark.createDataFrame([(1, d, r, s, s, t) for d, r, s, t in rows], "query_id long, doc_id string, rank int, score double, relevance double, tokens array<string>")
    assert order(rerank.diversify(scored, 3)) == ["a", "c", "b"]
    assert order(rerank.diversify(scored, 9)) == ["a", "c", "b", "d"]


def test_models_order_and_fallback(spark):
    found = pool(spark, ("a", 3), ("b", 2), ("c", 1))
    prompt = F.array_join(F.collect_list("doc_id"), ",")
    assert order(rerank.model_order(found, prompt, lambda p: ["c", "zz", "c", "a"])) == ["c", "a", "b"]
    assert order(rerank.model_order(found, prompt, lambda p: 1 / 0)) == ["a", "b", "c"]
    assert order(rerank.model_order(found, prompt, lambda p: None, 2)) == ["a", "b"]


def test_metrics(spark):
    shown = spark.createDataFrame([("s1", 1, "x", 1), ("s1", 2, "t", 4), ("s1", 3, "t", 1), ("s2", 1, "t", 2), ("s2", 4, "t", 7), ("s3", 1, "x", 1)], "sample_id string, turn int, doc_id string, rank int")
    samples = spark.createDataFrame([("s1", "buying", "t", 1), ("s2", "intent_override", "t", 3), ("s3", "buying", "t", 1)], "sample_id string, scenario_type string, target string, credit_from int")
    found = {r["sample_id"]: r for r in metrics.outcomes(shown, samples).collect()}
    assert (found["s1"]["first_hit_turn"], found["s1"]["best_rank"]) == (2, 4)
    assert (found["s2"]["first_hit_turn"], found["s2"]["best_rank"]) == (4, 7) and not found["s3"]["hit"]
    total = {r["scenario_type"]: r for r in metrics.summary(metrics.outcomes(shown, samples)).collect()}
    assert total["overall"]["sample_count"] == 3 and total["overall"]["mttc"] == pytest.approx(17 / 3, abs=1e-6)
    assert total["buying"]["hit_rate_at_10"] == 0.5
    none = metrics.summary(metrics.outcomes(shown, samples.limit(0)), by_scenario=False).first()
    assert none["sample_count"] == 0 and none["mttc"] is None and none["score"] is None


def test_failures(spark):
    rows = [("a", True, 6), ("b", True, 5), ("c", True, 10), ("d", False, None)]
    found = spark.createDataFrame(rows, "sample_id string, hit boolean, best_rank int")
    assert {r["sample_id"] for r in metrics.near_misses(found).collect()} == {"a", "c"}
    assert {r["sample_id"] for r in metrics.complete_misses(found).collect()} == {"d"}


def test_valid_recommendations(spark):
    named = spark.createDataFrame([(1, 0, " a "), (1, 1, "a"), (1, 2, ""), (1, 3, "zz"), (1, 4, None), (1, 5, "b")], "query_id long, position int, doc_id string")
    known = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert order(selection.valid(named, known)) == ["a", "b"]


def test_unseen_samples(spark):
    known = products(spark, *({"doc_id": f"d{k}", "title": "t", "categories": ["c"]} for k in range(60)), {"doc_id": "no category", "title": "t"}, {"doc_id": "no title", "categories": ["c"]})
    taken = spark.createDataFrame([(f"d{k}",) for k in range(10)], "doc_id string")
    rows = selection.unseen_samples(known, 40, 1, taken).collect()
    assert rows == selection.unseen_samples(known.repartition(5), 40, 1, taken).collect()
    assert len({r["target"] for r in rows}) == 40 and not {r["target"] for r in rows} & {*(f"d{k}" for k in range(10)), "no category", "no title"}
    kinds = [r["scenario_type"] for r in rows]
    assert [kinds.count(k) for k in ("buying", "browsing", "intent_override", "boundary")] == [16, 16, 6, 2]
