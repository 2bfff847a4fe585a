"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import NUMBER_ROWS, batches_of, cut, spanning
from quillsift.llm.components import connected_components

#: Pairs with this cosine or more link.
COSINE = 0.98
#: Hash tables and sign bits in each. A pair at the threshold meets in a table with probability
#: (1 - acos(0.98) / pi) ** 16 = 0.348, so it is missed by all 24 with probability 0.00004; closer pairs less often.
#: With so many bits vectors seldom meet by chance, and only those that meet are shuffled whole.
TABLES, BITS, SEED = 24, 16, 20_240_517
#: Most vectors of a bucket that one unit of comparison holds on either side; cosines computed at once.
SIDE, PAIRS = 2_048, 1 << 20


def usable(embedding: Column) -> Column:
    """True for a vector that has a cosine: not null or empty, all components finite and one of them not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def units(raw: list[bytes], kind: type) -> np.ndarray:
    """Vectors of one length and kind, each divided by its norm, in double precision. Scaling first keeps squares finite."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def planes(size: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """The hyperplanes for vectors of this many components; the same wherever they are drawn."""
    return np.random.Generator(np.random.PCG64([seed, size])).standard_normal((size, tables * bits))


def sign(tables: int, bits: int, seed: int, kind: type):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch["embedding"].map(len)
            for d in sorted(size.unique()):
                part = batch[size == d]
                vector = [np.asarray(v, kind).tobytes() for v in part["embedding"]]
                if d not in drawn:
                    drawn[d] = planes(d, tables, bits, seed)
                on = (units(vector, kind) @ drawn[d] > 0).reshape(len(part), tables, bits)
                signs = on @ (1 << np.arange(bits))
                yield pd.DataFrame({"node": part["node"], "label": part["label"], "size": d, "mult": part["mult"], "vector": vector, "signs": [x.tobytes() for x in signs.astype(np.int32)]})

    return run


def compare_units(cosine: float, kind: type):
    def links(table: int, own: tuple, guests: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Linked pairs of own and guests (None: inside own) that no earlier table has brought together."""
        (node, mult, x, signs), (node2, mult2, y, signs2) = own, guests or own
        block = max(1, PAIRS // max(1, len(x)))
        for start in range(0, len(y), block):
            near = x @ y[start : start + block].T >= cosine
            if guests is None:
                near &= np.arange(len(x))[:, None] < np.arange(start, min(start + block, len(y)))[None, :]
            for t in range(table):
                if not near.any():
                    break
                near &= signs[:, t][:, None] != signs2[start : start + block, t][None, :]
            if near.any():
                i, j = np.nonzero(near)
                here = np.bincount(i, mult2[start + j], len(x)), np.bincount(start + j, mult[i], len(y))
                yield node[i], node2[start + j], here[0], here[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by unit; the last unit of a batch waits for the next. Gives sums of links and spanning links."""
        key = ["table", "label", "size", "sign", "home", "other"]
        held: list[pd.DataFrame] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        sums: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(least: int) -> Iterator[pd.DataFrame]:
            if sums and sum(len(a) for a, _ in sums) >= least:
                a, where = np.unique(np.concatenate([a for a, _ in sums]), return_inverse=True)
                b = np.bincount(where, np.concatenate([b for _, b in sums]))
                sums.clear()
                yield pd.DataFrame({"link": False, "a": a, "b": b.round().astype(np.int64)})
            if found and sum(len(a) for a, _ in found) >= least:
                a, b = spanning(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
                found.clear()
                yield pd.DataFrame({"link": True, "a": a, "b": b})

        def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            node, mult, chunk = rows["node"].to_numpy(), rows["mult"].to_numpy(np.float64), rows["chunk"].to_numpy()
            keys, raw = rows[key].to_numpy(), list(rows["vector"])
            signs = np.frombuffer(b"".join(rows["signs"]), np.int32).reshape(len(raw), -1)
            x = units(raw, kind) if len(set(map(len, raw))) == 1 else None
            bounds = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *bounds], [*bounds, len(keys)], strict=True):
                if hi - lo < 2:
                    continue
                table, home, other = keys[lo, 0], keys[lo, 4], keys[lo, 5]
                y = units(raw[lo:hi], kind) if x is None else x[lo:hi]
                whole = node[lo:hi], mult[lo:hi], y, signs[lo:hi]
                if home == other:
                    own, guests = whole, None
                else:
                    mine = chunk[lo:hi] == home
                    own, guests = (tuple(v[m] for v in whole) for m in (mine, ~mine))
                for a, b, left, right in links(table, own, guests):
                    found.append((a, b))
                    sums.append((own[0][left > 0], left[left > 0]))
                    to = (guests or own)[0]
                    sums.append((to[right > 0], right[right > 0]))
                    if len(a) > 1 << 16 or len(found) > 1 << 16:
                        found[:] = [spanning(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))]
            yield from flush(1 << 18)

        for batch in batches:
            held.append(batch)
            if tuple(batch[key].iloc[-1]) != tuple(held[0][key].iloc[0]):
                rows = pd.concat(held, ignore_index=True)
                last = (rows[key].to_numpy() == rows[key].iloc[-1].to_numpy()).all(axis=1)
                yield from work(rows[~last])
                held = [rows[last]]
        if held:
            yield from work(pd.concat(held, ignore_index=True))
        yield from flush(1)

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, bits: int = BITS, side: int = SIDE, seed: int = SEED) -> DataFrame:
    """id, n_links, component_id, kept: one row for each row of vectors.

    Rows link where their labels are equal and not null, their vectors equally long, and the cosine of these, in double
    precision, is at least `cosine`, if their signs meet in one of the tables. n_links counts the other rows linked
    directly, component_id is the smallest id reachable over links and kept marks rows whose id it is. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing. Equal vectors are compared once and count
    as often as they occur. Rows that share an id are rows of their own; a null id is ignored in component_id unless
    it is all there is, and is not kept. An empty table gives no rows; other columns are not read.

    A bucket with more than `side` vectors is cut into slices, compared two by two in tasks of their own. What leaves a
    comparison are sums of links for each vector and a spanning set of links, never all pairs.
    """
    spark = vectors.sparkSession
    batches_of(spark, 4_096)
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind = np.float32 if single else np.float64  # as they come, so that no more is shuffled; cosines are in double precision
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull()).withColumn("hash", F.xxhash64("label", "embedding"))
    distinct = rows.where("ok").groupBy("hash", "label", "embedding").agg(F.count("*").alias("mult"), F.min("id").alias("first"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    signed = cut(nodes.select("node", "label", "mult", "embedding").mapInPandas(sign(tables, bits, seed, kind), f"node long, label {dict(rows.dtypes)['label']}, size int, mult long, vector binary, signs binary"))
    met = signed.select("node", "label", "size", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table"), "signs")
    met = met.select("node", "label", "size", "table", F.substring("signs", 4 * F.col("table") + 1, F.lit(4)).alias("sign"))
    bucket = ["table", "label", "size", "sign"]
    full = met.groupBy(bucket).count().where("count > 1").select(*bucket, F.ceil(F.col("count") / side).cast("int").alias("slices"))
    dealt = met.join(full, bucket).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.select("node", *bucket, "chunk", F.least("chunk", "with").alias("home"), F.greatest("chunk", "with").alias("other"))
    dealt = dealt.join(signed.select("node", "mult", "vector", "signs"), "node")
    unit = [*bucket, "home", "other"]
    batches_of(spark, 2_048)
    found = cut(dealt.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(compare_units(cosine, kind), "link boolean, a long, b long"))
    sums = found.where("not link").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    label = connected_components(found.where("link").select("a", "b"))
    known = nodes.join(sums, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.select("hash", F.col("label").alias("label_"), F.col("embedding").alias("embedding_"), "component", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links")).join(first, "component")
    joined = rows.join(known.withColumnRenamed("hash", "hash_"), F.col("ok") & (F.col("hash") == F.col("hash_")) & (F.col("label") == F.col("label_")) & (F.col("embedding") == F.col("embedding_")), "left")
    component = F.when(F.col("hash_").isNull(), F.col("id")).otherwise(F.col("component_id"))
    batches_of(spark, NUMBER_ROWS)
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it is kept, for every vector."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
