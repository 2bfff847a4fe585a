"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.plans.lineage import settled

#: Rows in one Arrow batch of what is planned next, unless told otherwise, and of rows of a few numbers.
ARROW_ROWS, NUMBER_ROWS = 256, 20_000
#: Bytes in any Arrow batch, but for a single longer row: whatever its number of rows, a batch of very long texts fits a Python worker.
ARROW_BYTES = 16 << 20


def batches_of(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the Arrow batches of what is planned next by rows, and all by bytes.

    A result that runs later, under another operator's number of rows, is still bounded by bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that lost executors cost no recomputation, it is computed once and its readers prune columns.

    forget() of the same module as settled() removes it where nothing reads it any more.
    """
    return settled(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores added until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """Lower case for matching against ASCII words: the one other letter whose lower case is ASCII, the Kelvin sign, is kept out of it."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0 to n-1 reaches over the links i-j: hooking and shortcutting, all links at once."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        if not keep.any():
            break
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return label


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links a-b, fewer than there are nodes."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = forest(where[: len(a)], where[len(a) :], len(nodes))
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]
