"""Catalogs, stores, settings, folds and streams, and whole turns."""

import json

import pytest
from pyspark.sql import functions as F

from quillsift.plans.queries import QUERIES
from quillsift.plans.oracle import SQL
from quillsift.plans.search import Engine, product_index
from quillsift.plans.simulate import evaluate, reply
from quillsift.sources import catalog, config, store
from quillsift.streaming.sessions import fold, stream

LINES = [
    {"parent_asin": "B0", "title": "Red Cotton Shirt", "categories": ["Clothing", "Shirts"], "features": ["soft", "zip pocket"], "description": ["Nice", "one"], "store": "Acme", "details": {"Fit": "Slim"}, "price": "19.5", "rating_number": 7, "average_rating": 4.5, "extra": 1},
    {"parent_asin": "B1", "title": "Blue Wool Hat", "categories": ["Hats"], "features": [], "description": "Warm", "price": "—", "rating_number": None},
    {"parent_asin": "B2", "title": None, "price": 30},
]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "catalog.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in LINES[:2]) + "\n\n" + json.dumps(LINES[2]) + "\n")
    return catalog.read_catalog(spark, str(path))


def test_catalog_lines(lines):
    rows = {r["parent_asin"]: r for r in lines.collect()}
    assert rows["B0"]["categories"] == ["Clothing", "Shirts"] and rows["B0"]["details"] == {"Fit": "Slim"} and rows["B0"]["description"] == "Nice one"
    assert rows["B0"]["price"] == 19.5 and rows["B0"]["rating_number"] == 7
    assert rows["B1"]["price"] is None and rows["B1"]["rating_number"] is None and rows["B1"]["details"] == {}
    assert rows["B2"]["title"] == "" and rows["B2"]["categories"] == [] and rows["B2"]["price"] == 30.0


def test_products_and_a_turn(spark, lines):
    products = catalog.products(lines)
    row = {r["doc_id"]: r for r in products.collect()}["B0"]
    assert row["searchable"] == "Red Cotton Shirt soft zip pocket Slim Nice one" and row["attrs"]["material"] == "cotton" and row["attrs"]["feature"] == "zip" and row["attrs"]["budget"] == "<$20"
    kinds = "query_id long, query string, track string, slots map<string,string>, confidence map<string,double>, slot_turns map<string,int>, negative map<string,array<string>>, no_preference array<string>, asked array<string>, tags array<string>, turn int, vector array<double>"
    sessions = spark.createDataFrame([(1, "blue hat", "browsing", {"color": "blue"}, {"color": 1.0}, {"color": 1}, {}, [], [], ["warmth"], 1, [1.0, 0.0]), (2, "", "buying", {}, {}, {}, {}, [], [], [], 1, [0.0, 1.0])], kinds)
    encoded = spark.createDataFrame([("B0", [1.0, 0.0]), ("B1", [0.0, 1.0])], "doc_id string, vector array<double>")
    engine = Engine(products, product_index(products), encoded)
    shown, asked = engine.turn(sessions)
    assert [r["doc_id"] for r in shown.where("query_id = 1").orderBy("rank").collect()] == ["B1", "B0"]
    assert shown.where("query_id = 2").count() == 0 and asked.count() == 2


def test_index_on_disk(spark, lines, tmp_path):
    index = product_index(catalog.products(lines))
    index.save(str(tmp_path))
    again = type(index).load(spark, str(tmp_path), index.fields)
    assert sorted(map(str, index.postings.collect())) == sorted(map(str, again.postings.collect()))


def test_content_key_of_a_catalog_with_maps(lines):
    key = store.content_key(lines)
    assert len(key) == 12 and key == store.content_key(lines.repartition(3))
    turned = lines.withColumn("details", F.map_from_entries(F.reverse(F.map_entries("details"))))
    assert key == store.content_key(turned)  # a map has no order
    assert key != store.content_key(lines.withColumn("details", F.map_concat("details", F.create_map(F.lit("one more"), F.lit("x")))))
    nested = lines.withColumn("details", F.struct("details"))
    assert store.content_key(nested) == store.content_key(nested)


def test_content_key_and_store(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    key = store.content_key(rows, model="m")
    assert key == store.content_key(rows.repartition(7), model="m") != store.content_key(rows, model="n") and len(key) == 12
    calls = []
    for _ in range(2):
        got = store.materialised(spark, str(tmp_path), "table", key, lambda: calls.append(1) or rows)
        assert got.count() == 100
    assert calls == [1]


def test_resumable_build(spark, tmp_path):
    rows, seen = spark.range(50).withColumnRenamed("id", "doc_id"), []

    def encode(part):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("broke off")
        return part

    with pytest.raises(RuntimeError):
        store.resumable(spark, rows, str(tmp_path / "b"), encode, {"model": "m"}, 4)
    got = store.resumable(spark, rows, str(tmp_path / "b"), encode, {"model": "m"}, 4)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(50)) and len(seen) == 5
    with pytest.raises(ValueError, match="begun with"):
        store.resumable(spark, rows, str(tmp_path / "b"), encode, {"model": "other"}, 4)


def test_json_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    store.write_json(rows, str(tmp_path / "out"))
    store.write_json(rows, str(tmp_path / "out"), append=True)
    assert [tuple(r) for r in store.read_json_lines(spark, str(tmp_path / "out"), "a int, b string").collect()] == [(1, None)] * 2


def test_settings(tmp_path):
    base = config.load()
    changed = config.load({"field_weights": {"title": 9.0}, "feature_weights": {"base": 2.0}, "retrieval_top_k": 5})
    assert base["retrieval_top_k"] == 100 and base["field_weights"]["title"] == 6.0
    assert changed["field_weights"]["title"] == 9.0 and changed["field_weights"]["store"] == 1.5 and changed["feature_weights"] == {"base": 2.0}
    assert config.from_flags(["--no-use-dense", "--use-early-stop"]) == {"use_dense": False, "use_early_stop": True}
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"retrieval": {"top_k": 7}, "unknown": {"x": 1}}))
    assert config.read(str(path))["retrieval_top_k"] == 7


MESSAGES = [("s1", 0, "I'm looking for shoes. A key requirement is: cotton."), ("s2", 0, "blue hat"), ("s1", 1, "what matters is: leather"), ("s2", 1, None)]


def test_stream_gives_what_the_fold_gives(spark, tmp_path):
    rows = spark.createDataFrame(MESSAGES, "session_id string, turn int, message string")
    source = tmp_path / "in"
    for k in range(2):
        rows.where(F.col("turn") == k).coalesce(1).write.mode("append").json(str(source))
    arriving = spark.readStream.schema("session_id string, turn int, message string").option("maxFilesPerTrigger", 1).json(str(source))
    running = stream(arriving).writeStream.format("memory").queryName("stepped").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    shape = lambda df: sorted((r["session_id"], r["turn"], r["query"], r["track"]) for r in df.collect())
    assert shape(spark.table("stepped")) == shape(fold(rows)) and len(shape(fold(rows))) == 4


def test_replies(spark):
    kinds = "sample_id string, scenario_type string, ask string, constraints array<string>, disclosed array<string>, declined boolean, override_turn int, override_message string"
    rows = spark.createDataFrame(
        [
            ("a", "buying", "material", ["cotton", "color: red", "wool", "silk"], ["cotton"], False, None, None), ("b", "boundary", "color", ["color: red"], [], False, None, None),
            ("c", "browsing", None, ["x"], [], False, None, None), ("d", "browsing", "size", ["cotton"], [], False, None, None), ("e", "intent_override", "size", ["cotton"], [], False, 3, "Actually"),
            ("f", "browsing", "other", ["a1", "a2", "a3"], [], False, None, None),
        ], kinds,
    )
    got = {r["sample_id"]: r for r in reply(rows, 2).collect()}
    assert got["a"]["next"] == "For that, what matters is: wool; silk." and got["a"]["disclosed"] == ["cotton", "wool", "silk"]
    assert got["b"]["next"].endswith("please use your judgment.") and got["b"]["declined"]
    assert got["c"]["next"].startswith("Those options are not quite right") and got["d"]["next"] == "I don't have an additional preference for size."
    assert got["e"]["next"] == "Actually" and got["f"]["disclosed"] == ["a1", "a2"]


def test_simulation_ends_at_hits(spark, lines):
    products = catalog.products(lines)
    samples = spark.createDataFrame([("x", "buying", "B0", None, ["warmth"]), ("y", "browsing", "B1", None, [])], "sample_id string, scenario_type string, target string, override_turn int, tags array<string>")
    engine = Engine(products, product_index(products), settings=config.load({"use_dense": False}))
    shoppers = lines.withColumnRenamed("parent_asin", "doc_id")
    outcomes, summary = evaluate(engine, samples, shoppers, turns=2)
    assert outcomes.where("hit").count() == 2 and summary.where("scenario_type = 'overall'").first()["hit_rate_at_10"] == 1.0


def test_steps_over_small_tables_need_no_shuffle(spark, monkeypatch):
    """Each shuffle or broadcast of a loop has the driver plan again; small tables that it keeps are one partition."""
    from quillsift.plans import lineage

    rows = lineage.gathered(spark.range(100).repartition(4).select("id", (F.col("id") % 7).alias("k")))
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 100
    joined = lineage.gathered(rows.groupBy("k").count()).join(rows, "k")
    assert "Broadcast" in joined._jdf.queryExecution().executedPlan().toString()
    plans = []
    monkeypatch.setattr(lineage, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    lineage.gathered(rows.groupBy("k").count().join(rows, "k"))
    assert "Exchange" not in plans[0] and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    monkeypatch.undo()
    monkeypatch.setattr(lineage, "SMALL", 0)
    assert lineage.gathered(spark.range(100).repartition(4)).count() == 100


def test_tracks_are_filtered_without_a_union(spark):
    from quillsift.operators import lexical

    pool = spark.createDataFrame([(q, d, r, 2.0 - r) for q in (1, 2, 3) for r, d in enumerate("ab")], "query_id long, doc_id string, rank int, score double")
    products = spark.createDataFrame([("a", ["Hats"], 90.0), ("b", ["Shoes"], 10.0)], "doc_id string, categories array<string>, price double")
    queries = spark.createDataFrame([(1, "buying", {"category": "shoes", "budget": "50"}), (2, "browsing", {"category": "shoes", "budget": "50"}), (3, None, {})], "query_id long, track string, slots map<string,string>")
    found = lexical.fitting(pool, products, queries, 5)
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()) == [(1, "b", 0), (2, "a", 0), (2, "b", 1)]


def test_simulated_sessions_play_ten_turns(spark, monkeypatch):
    """The registered query against a loop over its samples, with an engine that shows other parts in each turn."""
    from quillsift.operators import selection
    from quillsift.plans import queries

    class Paged:
        def __init__(self, products, index, settings):
            self.settings = settings

        def loop(self):
            return self

        def turn(self, sessions, top):
            shown = sessions.select("query_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("rank"))
            shown = shown.select("query_id", (F.col("turn") * 20 - 19 + F.col("rank")).cast("long").alias("doc_id"), "rank", F.lit(0.0).alias("score"))
            return shown, sessions.select("query_id", F.lit("other").alias("ask"))

    monkeypatch.setattr(queries, "Engine", Paged)
    sf = "/root/testdata/sf0.001"
    got = queries.simulated_sessions(spark, sf).where("scenario_type = 'overall'").first()
    hits = []
    for sample in selection.unseen_samples(queries.parts(spark, sf), 40, 20_260_830).collect():
        credit = 1 if sample["scenario_type"] != "intent_override" else sample["override_turn"] or 3
        found = [(turn, rank) for turn in range(1, 11) for rank in range(1, 11) if turn >= credit and 20 * turn - 20 + rank == sample["target"]]
        hits.append(found[0] if found else (11, None))
    assert any(5 < turn < 11 for turn, _ in hits) and got["sample_count"] == len(hits)
    assert got["hit_rate_at_10"] == pytest.approx(sum(r is not None for _, r in hits) / len(hits), abs=1e-6)
    assert got["mrr"] == pytest.approx(sum(1 / r for _, r in hits if r) / len(hits), abs=1e-6)
    assert got["mttc"] == pytest.approx(sum(turn for turn, _ in hits) / len(hits), abs=1e-6)


def test_session_fold_folds_what_users_say(spark):
    from quillsift.functions.session import new_state
    from quillsift.plans.queries import MESSAGES
    from quillsift.streaming.sessions import advance

    said = {f"fixed-{s}": [MESSAGES[(k + s) % 8] for k in range(8)] for s in range(8)}
    for r in sorted(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("role = 'user'").collect(), key=lambda r: (r["turn"], r["text"])):
        said.setdefault(str(r["conv_id"]), []).append(r["text"])
    got = {}
    for r in QUERIES["session_fold"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r["session_id"], []).append((r["turn"], r["track"], r["query"]))
    want = {s: [(r["turn"], r["track"], r["query"]) for r in advance(s, new_state(), iter(texts))] for s, texts in said.items()}
    assert {s: sorted(rows) for s, rows in got.items()} == {s: sorted(rows) for s, rows in want.items()}


def test_every_query_runs_small(spark):
    """Those with SQL are compared in test_oracle; the rest must give rows."""
    for name in QUERIES.keys() - SQL.keys() - {"simulated_sessions"}:
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name


def test_agent_keeps_sessions(spark, lines):
    from quillsift.plans.agent import Agent

    products = catalog.products(lines)
    agent = Agent(spark, Engine(products, product_index(products), settings=config.load({"use_dense": False})))
    agent.reset("a", {"preference_tags": ["warmth"]})
    first = agent.respond("a", "I'm looking for hats. A key requirement is: wool.")
    assert set(first) == {"message", "ask_attribute", "recommendations", "usage"} and first["recommendations"][0]["parent_asin"] == "B1"
    assert agent.sessions["a"][0]["slots"]["material"] == "wool" and len(agent.sessions["a"][0]["history"]) == 1
    again = agent.respond("unknown", "zzzz")
    assert again["recommendations"] == [] and "unknown" not in agent.sessions and again["ask_attribute"] in (None, "other")


def test_model_in_a_turn(spark, lines):
    from quillsift.plans.agent import Agent

    products = catalog.products(lines)
    said = []
    for model, first in ((lambda prompt: ["B1"] if "Red Cotton" in prompt and 'cotton' in prompt else None, "B1"), (lambda prompt: said.missing, "B0")):
        agent = Agent(spark, Engine(products, product_index(products), settings=config.load({"use_dense": False}), model=model))
        agent.reset("a")
        got = agent.respond("a", "red cotton shirt, or a blue hat; wool")
        assert got["recommendations"][0]["parent_asin"] == first and len(got["recommendations"]) == 2


def test_earlier_sessions():
    from quillsift.plans.variants import run

    last = run(["I'm looking for red shoes. A key requirement is: cotton.", "Actually, ignore my earlier preference. What I need is: leather."])[-1]
    assert last["slots"] == {"material": "leather"} and last["track"] == "buying"


def test_trace_and_comparison(spark, lines):
    from quillsift.plans.agent import ablation, trace

    products = catalog.products(lines)
    samples = spark.createDataFrame([("x", "buying", "B0", None, [])], "sample_id string, scenario_type string, target string, override_turn int, tags array<string>")
    engine, shoppers = Engine(products, product_index(products), settings=config.load({"use_dense": False})), lines.withColumnRenamed("parent_asin", "doc_id")
    row = trace(engine, samples, shoppers, 1).first()
    assert row["turn"] == 1 and row["target_rank"] == 1 and row["shown"][0] == "Red Cotton Shirt"
    assert ablation(engine, samples, shoppers, {"a": {}, "b": {"use_early_stop": False}}, 1)["b"]["hit_rate_at_10"] == 1.0


def test_command_line(spark, lines, tmp_path):
    from quillsift.__main__ import main

    path = tmp_path / "catalog.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in LINES))
    main(["index", "--catalog", str(path), "--out", str(tmp_path / "index")])
    assert spark.read.parquet(str(tmp_path / "index/postings")).count() > 5
    rows = [("a", "buying", True, 1, 7, 1 / 7), ("b", "buying", False, None, None, 0.0), ("c", "buying", True, 1, 1, 1.0)]
    store.write_json(spark.createDataFrame(rows, "sample_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double"), str(tmp_path / "sessions"))
    main(["failures", "--catalog", str(tmp_path / "sessions"), "--out", str(tmp_path / "failures")])
    assert {r["sample_id"]: r["kind"] for r in spark.read.json(str(tmp_path / "failures")).collect()} == {"a": "near miss", "b": "complete miss"}
