"""Text, attribute and dialogue functions on golden cases."""

import pytest
from pyspark.sql import functions as F

from quillsift.functions import dialogue as D
from quillsift.functions import text as X
from quillsift.functions.attributes import price_bucket, size_value
from quillsift.functions.session import accumulated, close, new_state, query, step


def one(spark, expr, **columns):
    kinds = ", ".join(f"{k} {v[1]}" for k, v in columns.items())
    return spark.createDataFrame([tuple(v[0] for v in columns.values())], kinds).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "kind"),
    [("leather", "material"), ("color: black", "color"), ("budget around $50", "budget"), ("slim fit", "style"), ("hiking boots use", "use_case"), ("wide toe", "size"), ("", "feature"), ("tailored", "color")],
)
def test_kinds_of_constraints(spark, value, kind):
    assert D.kind_of(value) == kind
    assert one(spark, D.kind_column(F.col("v")), v=(value, "string")) == kind


def test_short_colors(spark):
    assert one(spark, D.kind_column(F.col("v"), D.V.SHORT_COLORS), v=("navy purple", "string")) == "feature"


def test_values_of_constraints():
    assert D.value_of("budget around $75.99", "budget") == "75.99"
    assert D.value_of("color: black", "color") == "black"
    assert D.value_of("soft wool and cotton", "material") == "cotton"
    assert D.value_of("Sleeve: long", "style") == "long"


def run(*messages):
    state, done = new_state(), None
    for m in messages:
        done = step(state, m)
        close(state, m)
    return state, done


def test_slots_of_listed_constraints():
    state, _ = run("For that, what matters is: leather; color: black.")
    assert state["slots"]["material"] == "leather" and state["slots"]["color"] == "black" and state["confidence"]["color"] == 1.0


def test_requirement_names_material_and_category():
    state, done = run("I'm looking for shoes. A key requirement is: cotton.")
    assert state["slots"]["material"] == "cotton" and state["slots"]["category"] == "shoes" and done["track"] == "buying"


def test_negation():
    state, done = run("I do not want red; blue instead.")
    assert state["slots"]["color"] == "blue" and state["negative"] == {"color": ["red"]} and "red" not in done["query"].split()


def test_words_after_a_negation_stay():
    assert D.purify("not red or blue; cotton please").query_text == "; cotton please".strip(" ;")


def test_no_preference_removes_the_slot():
    state, _ = run("what matters is: color: red", "I don't have a preference for color; please use your judgment.")
    assert "color" not in state["slots"] and state["no_preference"] == ["color"] and state["boundary"]


def test_override_keeps_category_and_weak_evidence():
    state, done = run("I'm looking for shoes. A key requirement is: cotton.", "For that, what matters is: casual style.", "Actually, ignore my earlier preference. What I need is: leather.")
    assert state["slots"]["category"] == "shoes" and state["slots"]["material"] == "leather"
    assert state["confidence"]["style"] == pytest.approx(0.35) and done["query"].count("casual") == 1
    assert accumulated(state).startswith("Actually") and done["track"] == "buying" and state["scenario"] == "intent_override"


def test_override_starts_a_new_context():
    state, _ = run("red shoes", "Actually, ignore my earlier preference. What I need is: leather.")
    assert state["context_start"] == 1 and "negative" in state and not state["negative"]


def test_without_detection_nothing_is_overridden():
    state = new_state()
    step(state, "Actually, ignore my earlier preference.", detection=False)
    assert state["scenario"] == "browsing" and not state["override_applied"]


def test_noise_leaves_the_query():
    state, _ = run("blue ring", "Those options are not quite right yet. Ask me about one specific attribute.", "nice")
    assert "quite" not in query(state, "x") and "blue ring" in query(state, "x")


def test_empty_and_null_messages():
    state, done = run(None, "", "  ")
    assert done["query"] == "" and state["slots"] == {} and len(state["history"]) == 3


def test_query_terms(spark):
    assert one(spark, X.query_terms(F.col("t")), t=("I want the Blue blue RING, a x ring-2!", "string")) == ["blue", "ring"]
    assert one(spark, X.query_terms(F.col("t")), t=(None, "string")) == []
    assert one(spark, X.match_expression(F.col("t")), t=("blue ring", "string")) == '"blue" OR "ring"'


def test_last_elements(spark):
    assert one(spark, X.last(F.col("a"), 3), a=([1, 2], "array<int>")) == [1, 2]
    assert one(spark, X.last(F.col("a"), 3), a=([1, 2, 3, 4], "array<int>")) == [2, 3, 4]


@pytest.mark.parametrize(("raw", "price"), [("—", None), ("from 12.99", None), ("75", 75.0), ("NaN", None), ("inf", None), (None, None), ("", None)])
def test_prices(spark, raw, price):
    assert one(spark, X.price(F.col("p")), p=(raw, "string")) == price


@pytest.mark.parametrize(("price", "bucket"), [(19.99, "<$20"), (20.0, "$20-$50"), (99.0, "$50-$100"), (100.0, ">$100"), (None, None)])
def test_buckets(spark, price, bucket):
    assert one(spark, price_bucket(F.col("p")), p=(price, "double")) == bucket


@pytest.mark.parametrize(("text", "size"), [("Size: XL shirt", "XL"), ("an extra large one", "extra large"), ("S/M/L fit", "S/M/L"), ("US 9.5 shoe", "9.5"), ("I'm 100% sure", None), ("naïvétall", None)])
def test_sizes(spark, text, size):
    assert one(spark, size_value(F.col("t")), t=(text, "string")) == size


def test_tags(spark):
    assert set(one(spark, X.expanded_tags(F.col("t")), t=(["comfort", "Red shoes", None], "array<string>"))) == {"comfort", "comfortable", "red", "shoes"}


def test_coarse_category(spark):
    got = lambda a: one(spark, D.coarse_category(F.col("c")), c=(a, "array<string>"))
    assert got(["Clothing, Shoes & Jewelry", "Men, Shoes", "Boots"]) == "Shoes Boots" and got([]) == "clothing item" and got(["Clothing"]) == "clothing item"


def test_compatibility_composition(spark):
    assert one(spark, X.nfkc(F.col("t")), t=("ﬁne ①", "string")) == "fine 1"


def test_intent_card_names_each_step_once(spark, monkeypatch):
    """Both patterns are searched once a part, and by tasks whose number follows the parts, not the files."""
    from quillsift.plans import queries

    monkeypatch.setattr(queries, "CARDS", 50)
    found = queries.intent_cards(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2 and found.rdd.getNumPartitions() == 4 == -(-found.count() // 50)


def test_intent_card_without_features(spark):
    kinds = "title string, categories array<string>, features array<string>, details map<string,string>, description string, store string, price int"
    rows = [(None, None, None, None, None, None, None), ("x", ["y"], ["", None, "a", "a"], {"k": ""}, "Red wool", None, 5)]
    table = spark.createDataFrame(rows, kinds)
    empty, full = (r["c"] for r in table.select(D.intent_card({f: F.col(f) for f in table.columns}).alias("c")).collect())
    assert empty["hard_constraints"] == empty["soft_preferences"] == ["product"] and empty["target_category"] == "product"
    assert full["hard_constraints"] == ["wool", "color: red"] and full["soft_preferences"] == ["a", "budget around $5"]
