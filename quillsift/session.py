"""Session settings that results depend on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IN_PLACE = "spark.sql.requireAllClusterKeysForCoPartition"


def plain_unions(spark: SparkSession) -> None:
    """Has unions forget how their inputs are partitioned.

    Spark 4.1 lets an aggregation or window over a union do without a shuffle when all inputs are partitioned by its
    keys. Adaptive execution may coalesce the inputs' partitions differently, and then rows of one key stay apart and
    results are wrong (tests/test_operators.py has a case). Every operator here that unions calls this.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


@contextmanager
def held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Has a setting meanwhile; only what is executed inside is planned so."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def joined_in_place(spark: SparkSession) -> AbstractContextManager[None]:
    """Has joins that run meanwhile leave both sides where they are, if they are dealt alike by some of the keys.

    Else Spark shuffles both by all keys.
    """
    return held(spark, IN_PLACE, "false")


def unbroadcast(spark: SparkSession) -> AbstractContextManager[None]:
    """Has joins that run meanwhile broadcast nothing but what asks for it."""
    return held(spark, "spark.sql.autoBroadcastJoinThreshold", "-1")


#: Rows up to which a table is broadcast, once counted.
FEW = 100_000


def few(df: DataFrame) -> bool:
    """Whether df has so few rows; they are counted up to there."""
    return df.limit(FEW + 1).count() <= FEW


def sent(df: DataFrame) -> DataFrame:
    """df, broadcast by joins if it has few rows."""
    return F.broadcast(df) if few(df) else df


def dealt(df: DataFrame, key: str | Column, size: int, most: int) -> DataFrame:
    """df of this size dealt by a key to tasks of about `most`, however few files or row groups hold it."""
    return df.repartition(max(1, -(-size // most)), key)
