"""Exact nearest neighbours by dot product."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import blank
from quillsift.operators.lexical import ranked
from quillsift.plans.lineage import settled
from quillsift.session import plain_unions

#: Queries whose vectors one pass over the documents holds; more are searched in further passes.
BLOCK = 4_096
#: Documents multiplied with a block of queries at once.
ROWS = 2_048


def top_k(queries: DataFrame, docs: DataFrame, k: int = 100, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, rank, score: the k documents (doc_id, vector) with the largest dot product to each query.

    Query vectors go to the executors in blocks of at most `block`, by a hash of their id. A task multiplies its batches
    of documents with a block and keeps the k best so far for each query, which leave it once, at its end. Beyond one
    block, each block's result is a table before the next is read, so the driver holds one block at a time. Null vectors
    and those of another length match nothing.
    """
    plain_unions(docs.sparkSession)
    rows = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    parts = max(1, -(-rows.count() // block))
    kinds = {c: t.simpleString() for c, t in (("query_id", queries.schema["query_id"].dataType), ("doc_id", docs.schema["doc_id"].dataType))}
    typed = docs.where("vector is not null").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))

    def best(mine: DataFrame) -> DataFrame:
        sizes: dict[int, tuple[list, list]] = {}
        for r in mine.collect():
            ids, vectors = sizes.setdefault(len(r["vector"]), ([], []))
            ids.append(r["query_id"])
            vectors.append(r["vector"])
        matrices = {size: (np.array(ids), np.array(vectors, np.float64)) for size, (ids, vectors) in sizes.items()}
        return ranked(typed.mapInPandas(scan(matrices, k), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"), k)

    if parts == 1:
        return best(rows)
    blocks = [settled(best(rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part))) for part in range(parts)]
    return reduce(DataFrame.unionByName, blocks)


def scan(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """queries: by the vectors' length, ids and a matrix with a row for each."""

    def better(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each row, by score, then by id, as the final ranking goes."""
        by_id = np.argsort(ids, axis=1, kind="stable")
        ids, scores = np.take_along_axis(ids, by_id, 1), np.take_along_axis(scores, by_id, 1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lengths = batch["vector"].map(len)
            for size, (_, matrix) in queries.items():
                own = batch[lengths == size]
                for start in range(0, len(own), ROWS):
                    docs = own.iloc[start : start + ROWS]
                    scores = matrix @ np.stack(docs["vector"].to_numpy()).astype(np.float64).T
                    ids = docs["doc_id"].to_numpy()
                    by_id = np.argsort(ids, kind="stable")
                    order = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
                    found = ids[order], np.take_along_axis(scores, order, 1)
                    held[size] = better(*(np.concatenate(x, axis=1) for x in zip(held[size], found, strict=True))) if size in held else found
        for size, (ids, scores) in held.items():
            yield pd.DataFrame({"query_id": np.repeat(queries[size][0], ids.shape[1]), "doc_id": ids.ravel(), "score": scores.ravel()})

    return run


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of doubles, without Python; for few pairs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_weights(queries: DataFrame) -> tuple[Column, Column]:
    """Weights of the identity and the attribute vectors, from a query's slots and confidence (maps)."""
    slots = F.map_filter("slots", lambda s, v: (blank(v) != "") & ~s.isin("category", "brand", "budget"))
    units = F.aggregate(F.transform(F.map_keys(slots), lambda s: F.coalesce(F.col("confidence")[s], F.lit(0.75))), F.lit(0.0), lambda a, c: a + c)
    own = F.least(F.lit(0.78), 0.35 + 0.10 * units)
    attribute = F.when(blank(F.col("slots")["category"]) == "", F.greatest(own, F.lit(0.50))).otherwise(own)
    return 1 - attribute, attribute


def field_queries(text: Column, slots: Column, prefix: str = "query: ") -> tuple[Column, Column]:
    """What is encoded for the identity and for the attribute vectors: a prefix, the slots each can use, the text."""
    identity = F.concat_ws(" ", F.nullif(blank(slots["category"]), F.lit("")), F.nullif(blank(slots["brand"]), F.lit("")), text)
    rest = F.map_filter(slots, lambda s, v: ~s.isin("category", "brand", "budget") & (blank(v) != ""))
    return F.concat(F.lit(prefix), identity), F.concat(F.lit(prefix), F.concat_ws(" ", F.nullif(F.array_join(F.map_values(rest), " "), F.lit("")), text))


def two_field_top_k(queries: DataFrame, docs: DataFrame, k: int = 100) -> DataFrame:
    """The k documents (doc_id, identity, attribute: vectors) by the weighted sum of two dot products.

    queries: query_id, identity, attribute (vectors), w_identity, w_attribute. Each weighted pair of vectors is put
    together to one, so that one product gives the sum.
    """
    both = queries.select("query_id", F.concat(F.transform("identity", lambda x: x * F.col("w_identity")), F.transform("attribute", lambda x: x * F.col("w_attribute"))).alias("vector"))
    return top_k(both, docs.select("doc_id", F.concat("identity", "attribute").alias("vector")), k)


def encode(docs: DataFrame, encoder, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, vector): texts through `encoder`, a function of a list of texts that gives a matrix; rows of unit length.

    The encoder is called once for each batch, on the executors. Texts of length zero get a zero vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.asarray(encoder(batch["text"].fillna("").tolist()), np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "vector": list(x / np.where(norm == 0, 1, norm))})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, vector array<double>")


