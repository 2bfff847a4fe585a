"""Queries over the given tables, one for each operator or small group of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.functions import dialogue as D
from quillsift.functions import text as X
from quillsift.functions import vocabulary as V
from quillsift.functions.attributes import attribute_values, price_bucket
from quillsift.operators import clarify, compat, dense, fusion, lexical, metrics, rerank, selection
from quillsift.plans import variants
from quillsift.plans.search import Engine, product_index
from quillsift.plans.simulate import evaluate
from quillsift.session import dealt
from quillsift.sources import catalog, config
from quillsift.streaming.sessions import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Searches over parts: text, slots with confidence and the turn they are from, excluded values, attributes without
#: preference, preference tags, number of the turn, track.
SEARCHES = [
    (1, "blue ring", {}, {}, {}, {}, [], [], 1, "browsing"),
    (2, "I am looking for a large bolt, please", {"size": "large"}, {"size": 0.75}, {"size": 1}, {}, [], ["steel"], 2, "buying"),
    (3, "red gear", {"color": "red", "category": "ECONOMY"}, {"color": 1.0, "category": 0.9}, {"color": 1, "category": 1}, {}, [], ["red", "comfort"], 3, "buying"),
    (4, "small green plate", {"color": "green", "size": "small", "budget": "950"}, {"color": 1.0, "size": 1.0, "budget": 1.0}, {"color": 1, "size": 2, "budget": 2}, {"color": ["red"]}, [], [], 3, "buying"),
    (5, "plate", {"color": "blue", "brand": "Brand#13"}, {"color": 0.35}, {"color": 1}, {"size": ["large"]}, ["brand"], ["durability"], 6, "browsing"),
    (6, "", {}, {}, {}, {}, [], [], 1, "browsing"),
    (7, "nothing that the catalog has: zzzz", {"category": "STANDARD"}, {"category": 0.9}, {"category": 1}, {}, [], [], 1, "browsing"),
]
SEARCH_SCHEMA = "query_id long, query string, slots map<string,string>, confidence map<string,double>, slot_turns map<string,int>, negative map<string,array<string>>, no_preference array<string>, tags array<string>, turn int, track string"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, SEARCH_SCHEMA).withColumn("terms", X.query_terms(F.col("query"))).withColumn("asked", F.array().cast("array<string>"))


def six(column: Column | str) -> Column:
    """Rounded to what both engines' sums agree on."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), six("score").alias("score"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.part_catalog(spark, sf_dir)


def asked_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """Postings of the terms that searches over parts hold."""
    return product_index(parts(spark, sf_dir), searches(spark).select(F.explode("terms").alias("term")))


def part_lexical(spark: SparkSession, sf_dir: str, most: int = 100) -> DataFrame:
    """Lexical candidates of the searches over parts."""
    return lexical.ranked(lexical.bm25(asked_index(spark, sf_dir), searches(spark)), most)


@query
def bm25_part_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best parts of each search."""
    return shown(part_lexical(spark, sf_dir, 10))


def document_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """Postings of the terms that benchmark texts hold; no others are asked for."""
    fields = {"text": X.blank(F.col("text")), "source": X.blank(F.col("source")), "lang": X.blank(F.col("lang"))}
    terms = benchmark_queries(spark, sf_dir).select(F.explode("terms").alias("term"))
    return lexical.build_index(table(spark, sf_dir, "documents"), fields, "doc_id", terms)


DOCUMENT_WEIGHTS = {"text": 6.0, "source": 1.5, "lang": 1.0}


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.query_terms(F.col("text")).alias("terms"))


@query
def bm25_docs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark text, over three weighted fields."""
    return shown(lexical.ranked(lexical.bm25(document_index(spark, sf_dir), benchmark_queries(spark, sf_dir), DOCUMENT_WEIGHTS), 10))


@query
def index_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each term of parts, and how often by field."""
    index = product_index(parts(spark, sf_dir))
    tf = index.postings.groupBy("term").agg(*(F.sum(f"tf_{f}").alias(f"tf_{f}") for f in ("title", "categories", "store")))
    return index.terms.join(tf, "term").select("term", "df", "tf_title", "tf_categories", "tf_store")


@query
def bm25_dynamic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best parts with field weights that follow each session's evidence."""
    queries = searches(spark)
    return shown(lexical.ranked(lexical.bm25(asked_index(spark, sf_dir), queries, lexical.field_weights(queries)), 10))


@query
def bm25_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that hold all terms of a search."""
    return lexical.conjunctive(asked_index(spark, sf_dir), searches(spark))


@query
def clean_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first terms of every conversation turn, in order."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"), F.size(X.query_terms(F.col("text"))).cast("long").alias("n_terms"))


@query
def match_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as a query of alternatives."""
    return table(spark, sf_dir, "benchmark").select("item_id", X.match_expression(F.col("text")).alias("expression"))


@query
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the three token sets of every part's name, type and brand."""
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", *(F.size(f(text)).cast("long").alias(n) for n, f in (("diversity", X.diversity_tokens), ("value", X.value_tokens), ("profile", X.profile_tokens))))


@query
def catalog_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven attributes of every part."""
    return parts(spark, sf_dir).select("doc_id", *(F.col("attrs")[a].alias(a) for a in V.ATTRIBUTES))


@query
def product_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encoder is given of every part."""
    identity = X.identity_text(F.col("title"), F.col("categories"), F.col("store"))
    attribute = X.attribute_text(F.array("p_brand"), F.create_map(F.lit("size"), F.col("p_size").cast("string")), F.col("p_type"))
    rows = table(spark, sf_dir, "part").withColumn("title", F.col("p_name")).withColumn("categories", F.array("p_type")).withColumn("store", F.col("p_brand"))
    return rows.select("p_partkey", F.substring("title", 1, 120).alias("title120"), identity.alias("identity"), attribute.alias("attribute"), X.product_text(identity, attribute).alias("both"))


@query
def budget_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the price range of their value."""
    return table(spark, sf_dir, "events").groupBy(price_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


@query
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and counts read from texts that may hold no number."""
    text = F.when(F.col("event_id") % 7 == 0, F.lit("from 12.99")).when(F.col("event_id") % 7 == 1, F.lit("NaN")).when(F.col("event_id") % 7 == 2, F.lit("Infinity")).otherwise(F.round("value", 2).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", X.price(F.col("text")).alias("price"), X.whole_number(F.col("text")).alias("count"))


def slot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = searches(spark).select("query_id", F.col("slots")["category"].alias("category"), F.col("slots")["budget"].alias("budget"))
    return part_lexical(spark, sf_dir, 300).join(side, "query_id").join(parts(spark, sf_dir).select("doc_id", "categories", "price"), "doc_id")


@query
def slot_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that fit each session's category and budget."""
    return lexical.filter_by_slots(slot_rows(spark, sf_dir)).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def attribute_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by type, each type a pool."""
    return parts(spark, sf_dir).select(F.get("categories", F.lit(0)).alias("query_id"), "doc_id", "attrs")


@query
def attr_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and entropy of each attribute among the parts of each type."""
    found = clarify.attribute_scores(attribute_pool(spark, sf_dir))
    return found.select("query_id", "attribute", "n", six("coverage").alias("coverage"), six("score").alias("score"))


@query
def normalized_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly each user's events spread over their types."""
    found = clarify.entropies(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return found.select("user_id", "n", six("entropy").alias("entropy"))


@query
def blended_entropy_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of all of each user's events of a day, blended with a fixed one where they are few."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    found = clarify.entropies(events, ["user_id", "day"], "event_type")
    return found.select("user_id", "day", "n", six(clarify.blended(F.col("n"), F.col("entropy"), F.lit(0.73))).alias("entropy"))


def asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each type of part, in which the question of its length is known or asked already."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("query_id")).distinct()
    known = F.when(F.length("query_id") % 2 == 0, F.create_map(F.lit("color"), F.lit("red"))).otherwise(F.create_map(F.lit("size"), F.lit("large")))
    asked = F.when(F.length("query_id") % 3 == 0, F.array(F.lit("size"), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return types.select("query_id", known.alias("slots"), F.transform_values(known, lambda k, v: F.when(k == "color", 1.0).otherwise(0.35)).alias("confidence"), asked.alias("asked"))


@query
def ask_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask next in each session, whatever it tells."""
    found = clarify.ask(asking(spark, sf_dir), attribute_pool(spark, sf_dir), early_stop=False)
    return found.select("query_id", "ask", six("ask_score").alias("ask_score"))


@query
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask next in each session, "other" where no answer would tell enough."""
    return clarify.ask(asking(spark, sf_dir), attribute_pool(spark, sf_dir), threshold=0.55).select("query_id", "ask")


@query
def pool_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are left of each search while little is known."""
    found = clarify.truncated(part_lexical(spark, sf_dir), searches(spark))
    return found.groupBy("query_id").agg(F.count("*").alias("n"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a query, and all vectors."""
    docs = catalog.embeddings(spark, sf_dir)
    return docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector"), docs


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    queries, docs = vectors(spark, sf_dir)
    return shown(dense.top_k(queries, docs, 10))


@query
def dense_two_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by the weighted products of both halves of the vectors."""
    queries, docs = vectors(spark, sf_dir)
    halves = lambda df, key: df.select(key, F.slice("vector", 1, 32).alias("identity"), F.slice("vector", 33, 32).alias("attribute"))
    weighted = halves(queries, "query_id").withColumn("w_identity", F.lit(0.35)).withColumn("w_attribute", F.lit(0.65))
    return shown(dense.two_field_top_k(weighted, halves(docs, "doc_id"), 10))


@query
def dense_field_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of both vectors in each search."""
    queries = searches(spark)
    identity, attribute = dense.vector_weights(queries)
    return queries.select("query_id", six(identity).alias("w_identity"), six(attribute).alias("w_attribute"))


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists over vectors: nearest by the first half, and by the second."""
    queries, docs = vectors(spark, sf_dir)
    half = lambda df, key, at: df.select(key, F.slice("vector", at, 32).alias("vector"))
    return tuple(dense.top_k(half(queries, "query_id", at), half(docs, "doc_id", at), 30) for at in (1, 33))


@query
def source_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the head of each lexical list of benchmark texts spreads."""
    found = lexical.ranked(lexical.bm25(document_index(spark, sf_dir), benchmark_queries(spark, sf_dir), DOCUMENT_WEIGHTS), 100)
    return fusion.confidence(found).select("query_id", six("confidence").alias("confidence"))


@query
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists fused with fixed weights."""
    return shown(fusion.fuse(*lists(spark, sf_dir), (0.75, 0.25), 20))


@query
def adaptive_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists fused with weights by their confidence and the number of slots."""
    a, b = lists(spark, sf_dir)
    trust = fusion.confidence(a).join(fusion.confidence(b).withColumnRenamed("confidence", "other"), "query_id")
    slots = (F.col("query_id") / 100).cast("int") % 4
    weight = fusion.adaptive_weight(slots, fusion.stage_weight(slots), F.col("confidence"), F.col("other"))
    return shown(fusion.fuse(a, b, trust.select("query_id", weight.alias("lexical_weight"), (1 - weight).alias("dense_weight")), 20))


@query
def dense_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each search over parts needs dense candidates."""
    found = part_lexical(spark, sf_dir)
    state = searches(spark).join(found.groupBy("query_id").agg(F.count("*").alias("rows")), "query_id", "left").join(fusion.confidence(found).withColumnRenamed("confidence", "trust"), "query_id", "left")
    rows, trust = F.coalesce("rows", F.lit(0)), F.coalesce("trust", F.lit(0.0))
    return state.select("query_id", rows.alias("rows"), fusion.gate(rows, F.size("slots"), F.col("slots")["category"], trust).alias("dense"))


@query
def attr_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each candidate has what a session wants and excludes, by attribute, with the attribute's weight."""
    found = compat.evidence(part_lexical(spark, sf_dir, 50), parts(spark, sf_dir), searches(spark))
    return found.select("query_id", "doc_id", "attribute", six("matched").alias("matched"), six("violated").alias("violated"), six("weight").alias("weight"))


@query
def attr_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility and risk of each candidate."""
    found = compat.compatibility(part_lexical(spark, sf_dir, 50), parts(spark, sf_dir), searches(spark))
    return found.select("query_id", "doc_id", six("compatibility").alias("compatibility"), six("risk").alias("risk"))


def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compat.rescore(part_lexical(spark, sf_dir, 50), parts(spark, sf_dir), searches(spark), 50)


@query
def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by score and compatibility together."""
    return rescored(spark, sf_dir).select("query_id", "doc_id", six("lexical_score").alias("lexical_score"), six("score").alias("score"))


@query
def profile_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their profile's share added."""
    found = rerank.profile_boost(part_lexical(spark, sf_dir, 50), parts(spark, sf_dir), searches(spark))
    return found.select("query_id", "doc_id", six("score").alias("score"))


@query
def feature_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static relevance of the first twenty candidates: base, slots, category, popularity, price."""
    found = rerank.features(part_lexical(spark, sf_dir, 20), parts(spark, sf_dir), searches(spark), dynamic=False)
    return found.select("query_id", "doc_id", six("relevance").alias("relevance"))


@query
def feature_score_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic relevance of the first twenty candidates: base, compatibility, risk, popularity."""
    found = rerank.features(part_lexical(spark, sf_dir, 20), parts(spark, sf_dir), searches(spark))
    return found.select("query_id", "doc_id", six("relevance").alias("relevance"))


@query
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the first twenty candidates, relevant and unlike one another."""
    scored = rerank.features(part_lexical(spark, sf_dir, 20), parts(spark, sf_dir), searches(spark), dynamic=False)
    return shown(rerank.diversify(scored.withColumn("relevance", six("relevance")), 3))


@query
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten that are shown of each search, by all stages of the reranking."""
    return shown(rerank.rerank(rescored(spark, sf_dir), parts(spark, sf_dir), searches(spark)))


@query
def merge_named_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in an order that names some of them first."""
    found = part_lexical(spark, sf_dir, 20)
    named = found.where("rank % 3 = 2").select("query_id", "doc_id", (-F.col("rank")).alias("position"))
    return shown(rerank.merge_order(found, named))


def encoded_turn(spark: SparkSession, sf_dir: str, two: bool, **settings) -> DataFrame:
    """What each search over parts retrieves, with vectors for parts whose number has one; a search has that of ten times its number."""
    products, found = parts(spark, sf_dir), catalog.embeddings(spark, sf_dir)
    shape = [F.slice("vector", 1, 32).alias("identity"), F.slice("vector", 33, 32).alias("attribute")] if two else [F.col("vector")]
    asked = searches(spark).drop("terms")
    sessions = asked.join(found.select((F.col("doc_id") / 10).alias("query_id"), *shape), "query_id", "left")
    encoded = found.select("doc_id", *shape).join(products.select("doc_id"), "doc_id", "left_semi")
    return shown(Engine(products, asked_index(spark, sf_dir), encoded, config.load(settings)).retrieve(sessions))


@query
def hybrid_dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical candidates, fused where the gate opens with those by both vectors, by weights that both lists set."""
    return encoded_turn(spark, sf_dir, True)


#: Settings under which the weights of both lists are given, and don't add up to one.
FIXED_WEIGHTS = {"use_dense_risk_gate": False, "use_adaptive_fusion": False, "browsing_weights": [[0.50, 0.45], [0.60, 0.30]], "bm25_base": 0.75, "dense_base": 0.20}


@query
def hybrid_dense_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical candidates of every search that browses, fused with those by one vector, by given weights."""
    return encoded_turn(spark, sf_dir, False, **FIXED_WEIGHTS)


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole turn of each search over parts, without vectors: retrieval, rescoring, reranking."""
    products = parts(spark, sf_dir)
    found, _ = Engine(products, asked_index(spark, sf_dir), settings=config.load({"use_dense": False})).turn(searches(spark).drop("terms"))
    return shown(found)


@query
def variant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best parts as the earlier search finds them: fixed weights, only the budget filters."""
    products = parts(spark, sf_dir)
    return shown(variants.search(asked_index(spark, sf_dir), products, searches(spark), 10))


@query
def variant_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists fused with weights by the number of slots alone."""
    found, near = lists(spark, sf_dir)
    n = (F.col("query_id") / 100).cast("int") % 3
    slots = F.when(n == 0, F.create_map().cast("map<string,string>")).when(n == 1, F.create_map(F.lit("a"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")))
    queries = found.select("query_id").distinct().withColumn("slots", slots).withColumn("track", F.when(F.col("query_id") % 200 == 0, "browsing").otherwise("buying"))
    return shown(variants.fuse(found, near, queries, 20))


@query
def variant_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the earlier policy asks next: always something."""
    return variants.ask(asking(spark, sf_dir), attribute_pool(spark, sf_dir))


@query
def starter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best parts of the first baseline."""
    return shown(variants.starter(asked_index(spark, sf_dir), searches(spark)))


@query
def pass_through_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten candidates of each search as they are."""
    return shown(variants.pass_through(part_lexical(spark, sf_dir, 50)))


@query
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns before each, those with a question mark left out, and how many characters they have."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.blank(F.col("text")).alias("text"))
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    before = F.collect_list("text").over(window)
    useful = F.filter(before, lambda t: ~F.contains(t, F.lit(" no ")))
    return turns.select("conv_id", "turn", F.size(useful).cast("long").alias("n_useful"), F.length(F.array_join(useful, " ")).cast("long").alias("chars"))


def sample_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as samples whose target is one of the parts they ordered; their orders as turns that recommend parts."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    turns = orders.select("o_orderkey", F.col("o_custkey").alias("sample_id"), turn.alias("turn")).where("turn <= 12")
    shown_ = turns.join(lines, turns["o_orderkey"] == lines["l_orderkey"]).select("sample_id", "turn", F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"))
    target = shown_.where("turn between 1 and 11").groupBy("sample_id").agg(F.max("doc_id").alias("target"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("scenario_type"))
    return shown_, people.join(target, "sample_id").withColumn("credit_from", F.when(F.col("scenario_type") == "BUILDING", 3).otherwise(1))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.outcomes(*sample_orders(spark, sf_dir))


@query
def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When, and how high, each customer's target was first recommended."""
    return outcomes(spark, sf_dir).select("sample_id", "hit", F.col("first_hit_turn").cast("long").alias("first_hit_turn"), F.col("best_rank").cast("long").alias("best_rank"), six("reciprocal_rank").alias("reciprocal_rank"))


@query
def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate, mean reciprocal rank and mean turns, overall and by segment."""
    return metrics.summary(outcomes(spark, sf_dir)).select("scenario_type", "sample_count", "hit_rate_at_10", "mrr", "mttc", six("efficiency").alias("efficiency"), six("score").alias("score"))


@query
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, overall only."""
    return metrics.summary(outcomes(spark, sf_dir), by_scenario=False).select("sample_count", "hit_rate_at_10", "mrr", "mttc", six("efficiency").alias("efficiency"), six("score").alias("score"))


@query
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose target stood low, and those whose was never recommended."""
    found = outcomes(spark, sf_dir)
    late = metrics.near_misses(found, 4, 10).select("sample_id", F.lit("near miss").alias("kind"))
    return late.unionByName(metrics.complete_misses(found).select("sample_id", F.lit("complete miss").alias("kind")))


@query
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a column in which negative and unknown values count as none."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, -F.col("event_id")).when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
    return metrics.usage(rows, "prompt_tokens", "completion_tokens")


@query
def scenario_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each segment."""
    return metrics.counts(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "scenario_type"))


@query
def valid_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three distinct parts of each order, of ids some of which are blank, padded, repeated or unknown."""
    lines = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_partkey") % 11 == 0, F.lit(" ")).when(F.col("l_partkey") % 7 == 0, F.lit("none")).when(F.col("l_partkey") % 5 == 0, F.concat(F.lit(" "), F.col("l_partkey"), F.lit(" "))).otherwise((F.col("l_partkey") % 50).cast("string"))
    named = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("position"), text.alias("doc_id"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"))
    return selection.valid(named, known, 3).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query
def eligible_targets_by_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a name and a type, without those that any line of an urgent order, or any returned line, holds fifty of."""
    large, orders = table(spark, sf_dir, "lineitem").where("l_quantity = 50"), table(spark, sf_dir, "orders")
    urgent = large.join(orders.where("o_orderpriority = '1-URGENT'"), large["l_orderkey"] == orders["o_orderkey"], "left_semi").select(F.col("l_partkey").alias("doc_id"))
    returned = large.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("doc_id"))
    return selection.eligible(parts(spark, sf_dir), urgent, returned).select("doc_id")


@query
def unseen_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred samples for evaluation, by seeded hashes."""
    return selection.unseen_samples(parts(spark, sf_dir), 100, 20_260_829)


@query
def classify_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of constraint every part's name, type and brand would be, with the long and the short list of colors."""
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", D.kind_column(text).alias("kind"), D.kind_column(F.col("p_type"), V.SHORT_COLORS).alias("type_kind"))


@query
def coarse_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every part's path of categories, one of which is the root."""
    path = F.array(F.lit("Clothing, Shoes & Jewelry"), F.concat_ws(", ", "p_brand", "p_type"), F.lit("clothing"))
    return table(spark, sf_dir, "part").select("p_partkey", D.coarse_category(path).alias("category"), D.coarse_category(F.array(F.lit("Clothing"))).alias("root_only"))


def with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with all the fields that simulated shoppers look at."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.array("p_type").alias("categories"), F.array("p_brand", F.col("p_type")).alias("features"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("details"), F.lit("").alias("description"), F.col("p_brand").alias("store"), F.col("p_retailprice").cast("int").alias("price"),
    )


#: Parts of a task that looks for what a shopper wants.
CARDS = 100_000


@query
def intent_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a simulated shopper of every part wants, and says first."""
    rows = with_features(spark, sf_dir)
    rows = dealt(rows, "doc_id", rows.count(), CARDS)
    card = rows.withColumn("card", D.intent_card({f: F.col(f) for f in rows.columns}))
    kind = F.when(F.col("doc_id") % 3 == 0, "buying").when(F.col("doc_id") % 3 == 1, "intent_override").otherwise("browsing")
    hard, soft = F.col("card.hard_constraints"), F.col("card.soft_preferences")
    return card.select("doc_id", F.array_join(hard, "|").alias("hard"), F.array_join(soft, "|").alias("soft"), D.opening(kind, D.coarse_category(F.col("categories")), hard, F.element_at(soft, -1)).alias("message"))


@query
def attributes_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that document texts state."""
    docs = table(spark, sf_dir, "documents")
    found = attribute_values(X.blank(F.col("text")), X.blank(F.col("text")), F.lit(""), F.col("n_chars").cast("double") / 100)
    return docs.select("doc_id", found.alias("attrs")).select("doc_id", *(F.col("attrs")[a].alias(a) for a in V.ATTRIBUTES))


@query
def event_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's longest run of events of one type, as runs of turns without news are counted."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.col("event_type") != F.lag("event_type").over(order), F.lit(True)).cast("int")
    runs = events.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("user_id", "run").count().groupBy("user_id").agg(F.max("count").alias("longest"))


MESSAGES = [
    "I'm looking for shoes. A key requirement is: cotton.",
    "For that, what matters is: leather; color: black.",
    "I don't have a preference for color; please use your judgment.",
    "I do not want red; blue instead.",
    "Actually, ignore my earlier preference. What I need is: budget around $75.99.",
    "Those options are not quite right yet. Ask me about one specific attribute.",
    "something lightweight for hiking under $40",
    "I'm looking for lighting, but I'm still exploring.",
]


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say in every conversation, and beside them eight sessions of eight fixed messages, each beginning at another."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    said = said.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("session_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("message"))
    n = len(MESSAGES)
    fixed = [(f"fixed-{s}", k, MESSAGES[(k + s) % n]) for s in range(n) for k in range(n)]
    return said.unionByName(spark.createDataFrame(fixed, "session_id string, turn long, message string"))


@query
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every session after each of its messages."""
    pairs = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    found = fold(message_table(spark, sf_dir))
    return found.select("session_id", "turn", "scenario", "track", "changed", pairs(F.col("slots")).alias("slots"), pairs(F.col("confidence")).alias("confidence"), F.array_join("no_preference", ";").alias("no_preference"), "query")


@query
def simulated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty simulated shoppers of parts, each to the hit or the last of ten turns, summed up."""
    products = parts(spark, sf_dir)
    samples = selection.unseen_samples(products, 40, 20_260_830).withColumn("tags", F.array(F.lit("comfort")))
    engine = Engine(products, product_index(products), settings=config.load({"use_dense": False}))
    _, summary = evaluate(engine, samples, with_features(spark, sf_dir))
    return summary
