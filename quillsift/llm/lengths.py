"""Token counts: an exact histogram of encoded lengths whose suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import batches_of, cut
from quillsift.llm.packing import TOKENIZER, tokenizer

#: Lengths summed up together before these sums are summed up.
BLOCK = 1_024
#: Context limits that limits_table() answers for unless told otherwise.
LIMITS = (128, 256, 512, 1_024, 2_048, 4_096, 8_192, 16_384, 32_768)


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER) -> DataFrame:
    """(id, length): tokens of every whole text, without special ones; null and empty texts have none. One row for each row of docs."""
    batches_of(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(name, special_tokens=True)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "length": [len(encode(text or "")) for text in batch["text"]]}).astype({"length": "int64"})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(docs.dtypes)[id_col]}, length long").withColumnRenamed("id", id_col)


def histogram(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    """length, n_docs, docs_at_least, tokens_at_least, docs_upto, tokens_upto, truncated_tokens: one row for each length that occurs.

    docs_at_least and tokens_at_least are suffix sums, over this length and all above; *_upto go the other way.
    truncated_tokens are the tokens of all documents when each is cut at this length. Documents are summed up by length
    where they stand, so a length that a third of them share costs one row a task. Suffix sums are taken inside blocks
    of lengths, and then over the blocks, of which there are few: no task sees all lengths. No documents, no rows; null
    lengths count as none.
    """
    n = lengths.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))
    n = cut(n.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK)))  # read twice
    blocks = n.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    blocks = blocks.select(
        "block", F.coalesce(F.sum("block_docs").over(above), none).alias("docs_above"), F.coalesce(F.sum("block_tokens").over(above), none).alias("tokens_above"),
        F.sum("block_docs").over(every).alias("all_docs"), F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc())
    rows = n.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(blocks, "block")
    docs, tokens = F.col("d") + F.col("docs_above"), F.col("t") + F.col("tokens_above")
    return rows.select(
        "length", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), (F.col("all_docs") - docs + F.col("n_docs")).alias("docs_upto"),
        (F.col("all_tokens") - tokens + F.col("tokens")).alias("tokens_upto"), (F.col("all_tokens") - tokens + F.col("length") * docs).alias("truncated_tokens"),
    )


def totals(counts: DataFrame) -> DataFrame:
    """One row: documents, tokens, longest."""
    return counts.agg(F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("documents"), F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("tokens"), F.max("length").alias("longest"))


def quantiles(counts: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents does not exceed; none for no documents."""
    all_ = counts.agg(F.max("docs_at_least").alias("documents"))
    rows = counts.withColumn("share", F.explode(F.lit(list(shares)))).join(F.broadcast(all_), F.col("docs_upto") >= F.ceil(F.col("share") * F.col("documents")))
    return rows.groupBy("share").agg(F.min("length").alias("length"))


def limits_table(counts: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """(context_limit, kept_tokens, cut_docs): tokens left and documents cut when each is cut at the limit, for any limits."""
    at = F.min_by(F.struct("docs_at_least", "tokens_at_least"), "length")
    longer = counts.withColumn("context_limit", F.explode(F.lit(list(limits)))).where(F.col("length") > F.col("context_limit")).groupBy("context_limit").agg(at.alias("at"))
    every = counts.sparkSession.createDataFrame([(x,) for x in limits], "context_limit int")
    total = totals(counts).select("tokens")
    rows = every.join(longer, "context_limit", "left").crossJoin(F.broadcast(total))
    over, tokens = F.coalesce("at.docs_at_least", F.lit(0)), F.coalesce("at.tokens_at_least", F.lit(0))
    return rows.select("context_limit", (F.col("tokens") - tokens + F.col("context_limit") * over).alias("kept_tokens"), over.alias("cut_docs"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of all documents' encoded lengths with its sums."""
    return histogram(encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
