"""Mixing sources to target weights by nested hash thresholds, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import cut, fresh

#: Weights of the sources in order of code point, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all sizes that the mix takes, and how often a document may be taken at most.
SHARE, EPOCHS = 1.5, 2
#: Bits of the hash that each level of histograms looks at; together HASH_BITS, so that hashes are not negative.
LEVELS = (12, 12, 12, 12, 12)
HASH_BITS = sum(LEVELS)
#: The sources' table is broadcast up to this many rows; above, it is joined by a shuffle.
BROADCAST_ROWS = 10_000


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def small(table: DataFrame, rows: int) -> DataFrame:
    """table, marked for broadcast if its counted rows are few."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each, column source) with `place`: 0, 1, ... in order of code point, null last.

    Ranks inside ranges of sources, then adds the ranges' starts: no task holds all sources.
    """
    ranges = cut(sources.withColumn("last", F.col("source").isNull()).repartitionByRange(F.col("last"), F.col("source")).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").count()
    starts = sizes.alias("a").join(sizes.alias("b"), F.col("b.range") < F.col("a.range"), "left").groupBy(F.col("a.range").alias("range")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("last", "source"))
    return ranges.withColumn("inside", inside).join(F.broadcast(starts), "range").select("source", "source_size", (F.col("start") + F.col("inside") - 1).alias("place"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """(source, source_size, target) for sizes (source, source_size), and the number of sources.

    Targets are in proportion to the weights; those above `epochs` times their source's size stop there and the excess
    is shared again until none is above. Each round is one sum over the sources; a round that stops none is the last.
    """
    table = cut(ranked(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * float(epochs)))
    rows, total, limit = table.agg(F.count("*"), F.sum("source_size"), F.sum("most")).first()
    budget, level, before = min(share * (total or 0), limit or 0.0), 0.0, None
    while True:
        full = (F.col("weight") * F.lit(level) >= F.col("most")) if before is not None else (F.col("most") <= 0)
        stopped, spent, open_weight = table.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if stopped == before or not open_weight:
            break
        before, level = stopped, (budget - spent) / open_weight
    target = F.when(full, F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.lit(level)))
    return table.select("source", "source_size", target.alias("target")), rows


def refined(sized: DataFrame, state: DataFrame, rows: int, hash_col: str) -> DataFrame:
    """state (source, cutoff, base, left, prefix, open) with prefix the hash of the documents on which `left` falls, last their
    size, many their number, and left what is left of it there; open: false where the sum never passes it.

    A histogram of sizes by source and leading hash bits finds the bucket in which the source's running sum passes what
    is left of its target; the next level looks at further bits of that bucket's documents alone.
    """
    done = 0
    for bits in LEVELS:
        done += bits
        state = cut(state)
        leading, parent = (F.shiftrightunsigned(hash_col, HASH_BITS - x) for x in (done, done - bits))
        mine = F.col("source").eqNullSafe(F.col("s")) & F.col("open") & (parent == F.col("prefix")) & (F.col("cutoff").isNull() | (F.col("cutoff") == F.col("hash")))
        inside = sized.join(small(state.select(F.col("source").alias("s"), "prefix", "open", "cutoff"), rows), mine)
        sums = inside.groupBy("source", leading.alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("many"))
        sums = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        # the first bucket whose sum passes what is left, and the sum before it
        over = sums.join(small(state.select(F.col("source").alias("s"), "left"), rows), F.col("source").eqNullSafe(F.col("s"))).where("upto > left")
        first = over.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bucket", "size", "upto", "many")).alias("hit"))
        passed = F.col("hit").isNotNull()
        state = state.join(small(first, rows), F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "cutoff", "base", F.when(passed, F.col("left") - F.col("hit.upto") + F.col("hit.size")).otherwise(F.col("left")).alias("left"),
            F.coalesce("hit.bucket", "prefix").alias("prefix"), passed.alias("open"), F.col("hit.size").alias("last"), F.col("hit.many").alias("many"),
        )
    return cut(state)


def thresholds(sized: DataFrame, goals: DataFrame, rows: int) -> DataFrame:
    """(source, base, open, cutoff, tie_cutoff): every document is taken base times, and once more if its hash is below cutoff, or
    equal to it and its tie below tie_cutoff.

    Thresholds are nested: a smaller target takes a part of what a larger one takes. The document on which the target
    falls is taken if that brings the sum nearer. Where several documents share its hash, as rows equal in all do, they
    are told apart by their ties, in the same way.
    """
    none = F.lit(0).cast("long")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = goals.select("source", F.lit(None).cast("long").alias("cutoff"), base.alias("base"), (F.col("target") - base * F.col("source_size")).alias("left"), none.alias("prefix"), F.lit(True).alias("open"))
    found = refined(sized, state, rows, "hash")
    nearer = (F.col("left") * 2 >= F.col("last")).cast("long")
    ends = found.select("source", "base", "open", F.when(F.col("open"), F.col("prefix")).alias("cutoff"), F.when(F.col("open") & (nearer == 1), F.lit(1 << HASH_BITS)).otherwise(none).alias("tie_cutoff"), "left", F.coalesce(F.col("many") > 1, F.lit(False)).alias("shared"))
    if ends.where("shared").isEmpty():
        return ends.drop("left", "shared")
    apart = refined(sized, ends.select("source", "cutoff", "base", "left", none.alias("prefix"), F.col("shared").alias("open")), rows, "tie")
    apart = apart.where("open").select(F.col("source").alias("s"), (F.col("prefix") + nearer).alias("at"))
    joined = ends.join(small(apart, rows), F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "base", "open", "cutoff", F.coalesce("at", "tie_cutoff").alias("tie_cutoff"))


def limits(sized: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> tuple[DataFrame, int]:
    """What decides on the documents of each source, for sized (source, size, hash): one row a source, and their number."""
    goals, rows = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    goals = cut(goals)
    found = thresholds(sized, goals, rows).withColumnRenamed("source", "s")
    return cut(goals.join(small(found, rows), F.col("source").eqNullSafe(F.col("s"))).drop("s")), rows


def times(value: Column, tie: Column, epochs: int, prefix: str = "") -> Column:
    """How often a document with this hash and tie is taken, next to the columns of limits(), whose names start with prefix."""
    base, cutoff, tie_cutoff, open_, target, size = (F.col(prefix + c) for c in DECIDE)
    # a source whose sum never passes what is left of its target is taken whole, unless nothing is left
    more = F.when(open_, (value < cutoff) | ((value == cutoff) & (tie < tie_cutoff))).otherwise(target > base * size)
    return F.least(base + F.coalesce(more, F.lit(False)).cast("int"), F.lit(epochs))


DECIDE = ("base", "cutoff", "tie_cutoff", "open", "target", "source_size")


def hashed(id_col: str, text_col: str, source_col: str) -> Column:
    """The leading HASH_BITS bits of the md5 of id, source and text; null counts as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, source_col, text_col)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def tie() -> Column:
    """Tells rows apart that are equal in id, source and text; which of these are taken makes no difference."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), hashed(id_col, text_col, source_col).alias("hash"), tie().alias("tie")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """id, size, source_size, target, taken: one row for each row of docs, with how many of its words the mix takes.

    A document's size is its number of words (null text: 0). Which documents are taken follows from a hash of id,
    source and text, so reruns agree whatever the partitions; of rows equal in all three as many are taken as the target
    needs. Null is a source of its own, the last. A source of size 0 has target 0. No document is taken more than
    `epochs` times. An empty table gives no rows; other columns are not read.
    """
    sized = sizes_of(docs, id_col, text_col, source_col)
    known, rows = limits(sized, weights, share, epochs)
    joined = sized.join(small(known.withColumnRenamed("source", "s"), rows), F.col("source").eqNullSafe(F.col("s")))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times(F.col("hash"), F.col("tie"), epochs)).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """docs as mix() takes them: rows not taken are gone, rows taken twice stand there twice. Columns are those of docs.

    The decision needs only a row's source and hash, so no text is shuffled where the sources are few. Rows equal in id,
    source and text are told apart by where they stand, so docs has to be read in one order, as files are.
    """
    known, rows = limits(sizes_of(docs, id_col, text_col, source_col), weights, share, epochs)
    mark, n, each, at = fresh(docs, "mix_source", "mix_times", "mix_copy", "mix_tie")
    known = known.select(F.col("source").alias(mark), *(F.col(c).alias(f"{mark}_{c}") for c in DECIDE))
    text = docs.withColumn(n, hashed(id_col, text_col, source_col)).withColumn(at, tie())
    joined = text.join(small(known, rows), F.col(source_col).cast("string").eqNullSafe(F.col(mark)))
    often = times(F.col(n), F.col(at), epochs, f"{mark}_")
    return joined.withColumn(n, often).where(F.col(n) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(docs[c] for c in docs.columns))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and what the mix takes, for every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
