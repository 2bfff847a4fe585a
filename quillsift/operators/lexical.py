"""Inverted index and field-weighted BM25."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.functions import vocabulary as V
from quillsift.session import dealt, few, sent

#: Tokens of a task that makes postings.
TOKENS = 1_000_000


@dataclass(frozen=True)
class Index:
    """postings: term, doc_id, len, and the term's count in each field; terms: term, df; corpus: n, avg_len (one row)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    fields: tuple[str, ...]

    def save(self, path: str) -> None:
        """As parquet; postings sorted by term, so that a query's terms skip most row groups."""
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def load(spark, path: str, fields: tuple[str, ...]) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "corpus")), fields)


def build_index(docs: DataFrame, fields: dict[str, Column], id_col: str = "doc_id", terms: DataFrame | None = None) -> Index:
    """Index of docs' fields (text columns by name). Both sides of a search use one tokeniser, of a-z and 0-9.

    A document's length counts the tokens of all fields. Documents without tokens count in the corpus. With `terms`
    (term), for a batch of queries known beforehand, only their postings are made; lengths and the corpus stay whole.

    Tokens are counted at once, so that documents can be dealt to tasks of about TOKENS of them: what a task aggregates
    is bounded, and all postings of a document are in one place.
    """
    names = tuple(fields)
    length = sum((F.size(X.ascii_tokens(c)) for c in fields.values()), F.lit(0))
    n, average, total = docs.select(length.alias("len")).agg(F.count("*"), F.avg("len"), F.sum("len")).first()
    corpus = docs.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(average).cast("double").alias("avg_len"))
    texts = dealt(docs.select(F.col(id_col).alias("doc_id"), *(c.alias(f) for f, c in fields.items())), "doc_id", total or 0, TOKENS)
    read = texts.select("doc_id", *(X.ascii_tokens(F.col(f)).alias(f) for f in names))
    ends = [sum((F.size(f) for f in names[: k + 1]), F.lit(0)) for k in range(len(names))]
    read = read.select("doc_id", ends[-1].alias("len"), *(e.alias(f"end_{f}") for f, e in zip(names, ends, strict=True)), F.concat(*names).alias("tokens"))
    # outer, as Spark would otherwise read the tokens once more before documents are dealt, to leave out those without any
    tokens = read.select("*", F.posexplode_outer("tokens").alias("at", "term")).drop("tokens").where("term is not null")
    if terms is not None:
        tokens = tokens.join(sent(terms.select("term").distinct()), "term", "left_semi")
    within = lambda k: (F.col("at") < F.col(f"end_{names[k]}")) & (F.col("at") >= (F.col(f"end_{names[k - 1]}") if k else 0))
    postings = tokens.groupBy("term", "doc_id", "len").agg(*(F.count(F.when(within(k), 1)).alias(f"tf_{f}") for k, f in enumerate(names)))
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), corpus, names)


def bm25(index: Index, queries: DataFrame, weights: dict[str, float | Column] | None = None) -> DataFrame:
    """(query_id, doc_id, score) for every document that holds a term of a query, in any field.

    queries: query_id, terms (array of distinct terms). weights: by field, numbers, or columns of queries. Equi-joins on
    the term alone; the few query terms are joined to their statistics first, so postings meet them once. Where they are
    few they go to the postings, which stay where they are: those of a new index are dealt by document, so that its
    scores are summed without a shuffle. Scores are rounded to nine places, so that equal documents tie in whatever
    order their terms are summed.
    """
    weights = weights or V.FIELD_WEIGHTS
    named = {f: w if isinstance(w, Column) else F.lit(float(w)) for f, w in weights.items()}
    wanted = queries.select("query_id", *(named[f].alias(f"w_{f}") for f in index.fields), F.explode("terms").alias("term"))
    send = F.broadcast if few(wanted) else (lambda df: df)
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = send(wanted).join(index.terms, "term").crossJoin(F.broadcast(index.corpus)).withColumn("idf", F.when(raw > 0, raw).otherwise(V.IDF_FLOOR))
    hit = send(known).join(index.postings, "term")
    tf = sum((F.col(f"w_{f}") * F.col(f"tf_{f}") for f in index.fields), F.lit(0.0))
    part = F.col("idf") * tf * (V.K1 + 1) / (tf + V.K1 * (1 - V.B + V.B * F.col("len") / F.col("avg_len")))
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))


def ranked(scored: DataFrame, most: int, *ties: Column | str) -> DataFrame:
    """The best `most` of each query with their rank from 0; equal scores by `ties`, by default the id."""
    order = [F.col("score").desc(), *(ties or ("doc_id",))]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    # compared before 1 is taken off, as Spark then keeps the best of each partition alone before it shuffles
    return scored.withColumn("rank", place).where(F.col("rank") <= most).withColumn("rank", F.col("rank") - 1)


def field_weights(queries: DataFrame, base: dict[str, float] | None = None, gain: float = 0.65) -> dict[str, Column]:
    """Field weights of each query from its slots (map) and confidence (map): evidence raises the fields that can use it."""
    base = base or V.FIELD_WEIGHTS
    known = lambda a: F.when(X.blank(F.col("slots")[a]) != "", F.coalesce(F.col("confidence")[a], F.lit(0.75))).otherwise(0.0)
    category, brand = known("category"), known("brand")
    detail = 1 - F.exp(-sum((known(a) for a in ("material", "color", "size", "style", "use_case", "feature")), F.lit(0.0)) / 2)
    more = {
        "title": 0.25 * category + 0.15 * brand, "categories": category, "features": detail, "description": 0.65 * detail,
        "details": 0.85 * detail, "store": brand,
    }
    return {f: F.lit(float(w)) * (1 + gain * more[f]) if f in more else F.lit(float(w)) for f, w in base.items()}


def filter_by_slots(found: DataFrame) -> DataFrame:
    """Rows of (query_id, category, budget, categories, price, ...) that fit the query's category and budget.

    A category keeps products of which one category shares a token of three characters or more with it, unless that
    leaves the query nothing. Unknown prices and budgets that are no number let all pass. The category is judged before
    the budget.
    """
    wanted = F.filter(X.ascii_tokens(F.col("category")), lambda t: F.length(t) >= 3)
    fits = F.exists("categories", lambda c: F.arrays_overlap(X.ascii_tokens(c), wanted))
    open_ = F.size(wanted) == 0
    marked = found.withColumn("fits", fits).withColumn("any_fits", F.max("fits").over(Window.partitionBy("query_id")))
    kept = marked.where(open_ | F.col("fits") | ~F.coalesce("any_fits", F.lit(False)))
    limit = F.col("budget").cast("string").try_cast("double")
    return kept.where(limit.isNull() | F.col("price").isNull() | (F.col("price") <= limit)).drop("fits", "any_fits")


def search(index: Index, products: DataFrame, queries: DataFrame, weights: dict[str, float | Column] | None = None, top_k: int = 100, keep: int | None = None) -> DataFrame:
    """query_id, doc_id, rank, score, price: lexical candidates of queries (query_id, terms, slots, track).

    Three times as many as asked for are ranked first; the buying track filters these by slots, and then they are cut,
    to `keep` if something ranks them again.
    """
    return fitting(ranked(bm25(index, queries, weights), 3 * top_k), products, queries, keep or top_k)


def fitting(pool: DataFrame, products: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The first `most` of a ranked pool, on the buying track of those that fit the slots."""
    wanted = lambda slot: F.when(F.col("track") == "buying", F.col("slots")[slot]).alias(slot)  # noqa: E731 - elsewhere none, which lets all pass
    side = queries.where(F.col("track").isNotNull()).select("query_id", wanted("category"), wanted("budget"))
    kept = filter_by_slots(pool.join(side, "query_id").join(products.select("doc_id", "categories", "price"), "doc_id"))
    return ranked(kept.select("query_id", "doc_id", "score", "price", F.col("rank").alias("before")), most, "before").drop("before")


def conjunctive(index: Index, queries: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, doc_id) of documents that hold all of a query's first `most` terms, for queries of two terms or more."""
    wanted = queries.select("query_id", F.slice("terms", 1, most).alias("terms")).where(F.size("terms") >= 2)
    each = wanted.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    return each.join(index.postings.select("term", "doc_id"), "term").groupBy("query_id", "doc_id", "n").count().where("count = n").select("query_id", "doc_id")
