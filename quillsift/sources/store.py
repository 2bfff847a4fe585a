"""Indexes and results on disk: content-addressed folders, resumable builds, sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hashable(df: DataFrame) -> list[Column]:
    """df's columns in forms that have a hash: maps as their entries in order, and what holds maps as JSON."""
    forms = {True: lambda c: F.array_sort(F.map_entries(c)), False: lambda c: F.to_json(F.struct(c))}
    return [F.col(f.name) if "map<" not in (kind := f.dataType.simpleString()) else forms[kind.startswith("map<") and kind.count("map<") == 1](F.col(f.name)) for f in df.schema.fields]


def content_key(df: DataFrame, **settings: str | int | float | bool) -> str:
    """12 hex digits that name a table's rows, in any order, and what is made of them.

    Two sums over hashes of the rows, wide enough not to overflow, and their number: one pass, one row to the driver.
    """
    row = F.xxhash64(*hashable(df)).cast("decimal(38,0)")
    again = F.xxhash64(F.lit(1), *hashable(df)).cast("decimal(38,0)")
    digest = F.sha1(F.concat_ws("|", F.count("*").cast("string"), F.sum(row).cast("string"), F.sum(again).cast("string"), F.lit(json.dumps(settings, sort_keys=True))))
    return df.agg(F.substring(digest, 1, 12)).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def materialised(spark: SparkSession, root: str, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, from root/name-key if it was finished there before, else written there first.

    A write is finished when its _SUCCESS is there; one that broke off is written anew.
    """
    path = f"{root.rstrip('/')}/{name}-{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A build's protocol; empty if there is none."""
    if not exists(spark, f"{path}/manifest"):
        return {}
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def resumable(spark: SparkSession, source: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], protocol: dict, chunks: int = 16, id_col: str = "doc_id") -> DataFrame:
    """encode(source), chunk by chunk under path, leaving out the chunks finished before.

    Rows go to chunks by a hash of their id. A protocol other than that of the chunks already there is an error, as
    their rows would not fit together.
    """
    known, wanted = read_manifest(spark, path), protocol | {"chunks": chunks}
    if known and known != wanted:
        raise ValueError(f"{path} was begun with {known}, not with {wanted}")
    if not known:
        spark.createDataFrame([(json.dumps(wanted, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    chunk = F.pmod(F.xxhash64(id_col), F.lit(chunks))
    for k in range(chunks):
        if not exists(spark, f"{path}/chunk={k}/_SUCCESS"):
            encode(source.where(chunk == k)).write.mode("overwrite").parquet(f"{path}/chunk={k}")
    return spark.read.parquet(*(f"{path}/chunk={k}" for k in range(chunks)))


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as lines of JSON, nulls too; appended rows stand in files of their own."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with a given schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
