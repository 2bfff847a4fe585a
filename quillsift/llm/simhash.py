"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import NUMBER_ROWS, batches_of, cut, fresh, spanning
from quillsift.llm.components import connected_components
from quillsift.session import plain_unions

#: Fingerprints link at this many differing bits or fewer.
RADIUS = 3
#: Words in a shingle, and the seed of its hash.
WORDS, SEED = 3, 42
#: Parts of a fingerprint whose population counts name its tile, and their bits. At most 17**4 tiles.
PARTS, BITS = 4, 16
TILES = (BITS + 1) ** PARTS
#: Most fingerprints of a tile, and most visitors from other tiles, in one unit of comparison.
HOME, VISITORS = 4_096, 65_536
#: Keys are broadcast up to so many.
BROADCAST_ROWS = 200_000
#: Shingles hashed, and pairs compared, at once.
CHUNK, PAIRS = 65_536, 1 << 21


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if over half of the shingles' hashes have it. No word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(WORDS)), strict=False) if len(words) > WORDS else [tuple(words)]
    count, ones, hashes = 0, np.zeros(64, np.int64), []

    def add() -> None:
        ones[:] += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)

    digest = xxhash.xxh64_intdigest
    for gram in grams:
        hashes.append(digest(b" ".join(gram), SEED))
        if len(hashes) == CHUNK:
            add()
            count += len(hashes)
            hashes.clear()
    count += len(hashes)
    if hashes:
        add()
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(fingerprint, text), np.uint64, len(text)).view(np.int64))


def hexadecimal(value: Column) -> Column:
    """16 lower-case hex digits of a long, as unsigned."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def steps(radius: int) -> np.ndarray:
    """Differences between the part counts of two fingerprints within radius: they sum to at most radius."""
    span = range(-min(radius, BITS), min(radius, BITS) + 1)
    return np.array([d for d in product(span, repeat=PARTS) if sum(map(abs, d)) <= radius])


WEIGHTS = np.array([(BITS + 1) ** k for k in range(PARTS)])


def tiles(values: np.ndarray) -> np.ndarray:
    """Population counts of the parts of each fingerprint."""
    return np.bitwise_count(values.view(np.uint16).reshape(-1, PARTS)).astype(np.int64)


def deal(counts: np.ndarray, radius: int, home: int, visitors: int):
    """A function that sends fingerprints to the units in which they are compared.

    counts: fingerprints by tile. A unit is a slice of one tile's fingerprints against a slice of the fingerprints of
    the tiles before it whose population counts lie within radius, and of the tile's own earlier slices; pairs of tiles
    beyond radius have no unit. A tile's slices, and its visitors' slots, follow the counts, so that no unit outgrows
    its limits however full a tile is.
    """
    ahead = steps(radius)
    ahead = ahead[(ahead @ WEIGHTS) > 0]  # each pair of tiles once: the later one is home
    existing = np.flatnonzero(counts)
    parts = existing[:, None] // WEIGHTS % (BITS + 1)
    guests = np.zeros(TILES, np.int64)
    for step in ahead:
        to = parts + step
        ok = ((to >= 0) & (to <= BITS)).all(1)
        np.add.at(guests, to[ok] @ WEIGHTS, counts[existing[ok]])
    slices = np.maximum(1, -(-counts // home))
    slots = np.maximum(1, -(-(guests + counts) // visitors))

    def spread(tile: np.ndarray, each: np.ndarray, values: np.ndarray):
        """Every value once for each number below each: values, tiles, numbers."""
        at = np.repeat(np.arange(len(values)), each)
        return values[at], tile[at], np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)

    def unit(tile, part, slot):
        return (tile * (1 << 20) + part) * (1 << 20) + slot

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy().astype(np.int64)
            spots = tiles(values)
            tile = spots @ WEIGHTS
            mixed = (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            part = (mixed % slices[tile].view(np.uint64)).astype(np.int64)
            v, t, slot = spread(tile, slots[tile], values)
            yield pd.DataFrame({"unit": unit(t, np.repeat(part, slots[tile]), slot), "guest": False, "fp": v})
            for step in [np.zeros(PARTS, np.int64), *ahead]:
                to = spots + step
                ok = ((to >= 0) & (to <= BITS)).all(1)
                target = np.where(ok, to @ WEIGHTS, 0)
                own = not step.any()
                ok &= (counts[target] > 0) & ((slices[target] > 1) | (not own))
                target, mine, hashed = target[ok], values[ok], mixed[ok]
                v, t, k = spread(target, slices[target], mine)
                slot = (np.repeat(hashed, slices[target]) >> np.uint64(13)) % slots[t].view(np.uint64)
                if own:
                    later = k > np.repeat(part[ok], slices[target])
                    v, t, k, slot = v[later], t[later], k[later], slot[later]
                if len(v):
                    yield pd.DataFrame({"unit": unit(t, k, slot.astype(np.int64)), "guest": True, "fp": v})

    return send


def compare(home: np.ndarray, guests: np.ndarray, within: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between home and guests, and inside home if within: exclusive-or and bit counts, a block at a time.

    Of each block a spanning set of links is given, so their number stays in proportion to the fingerprints.
    """
    block = max(1, PAIRS // max(1, len(home)))
    for others, own in ((home, True), (guests, False)):
        if own and not within:
            continue
        for start in range(0, len(others), block):
            near = np.bitwise_count(home[:, None] ^ others[None, start : start + block]) <= radius
            if own:
                near &= np.arange(len(home))[:, None] < np.arange(start, min(start + block, len(others)))[None, :]
            if near.any():
                i, j = np.nonzero(near)
                yield home[i], others[start + j]


def compare_units(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by unit, those of its home tile first; the last unit of a batch waits for the next."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(least: int) -> Iterator[pd.DataFrame]:
            nonlocal found
            if found and sum(len(a) for a, _ in found) >= least:
                a, b = spanning(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
                found = [(a, b)]
                if len(a) >= least // 2:
                    found = []
                    yield pd.DataFrame({"a": a, "b": b})

        def work(unit: np.ndarray, guest: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
            bounds = np.flatnonzero(np.diff(unit)) + 1
            for lo, hi in zip([0, *bounds], [*bounds, len(unit)], strict=True):
                if hi - lo < 2:
                    continue
                homes = int(hi - lo - guest[lo:hi].sum())
                own = fp[lo : lo + homes]
                for a, b in compare(own.view(np.uint64), fp[lo + homes : hi].view(np.uint64), unit[lo] % (1 << 20) == 0, radius):
                    found.append((a.view(np.int64), b.view(np.int64)))
                    yield from flush(1 << 20)

        for batch in batches:
            new = tuple(batch[c].to_numpy() for c in ("unit", "guest", "fp"))
            if held and new[0][0] != held[-1][0][-1]:
                yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append(new)
            if new[0][-1] != held[0][0][0]:  # more than one unit is complete
                unit, guest, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.searchsorted(unit, unit[-1]))
                yield from work(unit[:last], guest[:last], fp[:last])
                held = [(unit[last:], guest[last:], fp[last:])]
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield from flush(1)

    return run


def fingerprint_links(values: DataFrame, radius: int = RADIUS, home: int = HOME, visitors: int = VISITORS) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs of `values.fp` (distinct longs) within radius do."""
    part = [F.bit_count(F.shiftrightunsigned("fp", BITS * k).bitwiseAND(F.lit((1 << BITS) - 1))) for k in range(PARTS)]
    tile = sum((p.cast("long") * int(w) for p, w in zip(part, WEIGHTS, strict=True)), F.lit(0))
    counts = np.zeros(TILES, np.int64)
    for row in values.groupBy(tile.alias("tile")).count().collect():  # at most 17**4 rows, however large the table
        counts[row["tile"]] = row["count"]
    sent = values.mapInPandas(deal(counts, radius, home, visitors), "unit long, guest boolean, fp long")
    sent = sent.repartition("unit").sortWithinPartitions("unit", "guest")
    return sent.mapInPandas(compare_units(radius), "a long, b long")


def row_key(row_id: Column, text: Column) -> Column:
    """Names a row by its id and its text's hash; rows equal in both share a key."""
    return F.concat(F.coalesce(row_id.cast("string"), F.lit("none")), F.lit(":"), F.hex(F.xxhash64(F.coalesce(text, F.lit("")))))


def whole_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """row_key(), then a hash of all columns (but maps, which have no order): only rows equal in all share a key."""
    return F.concat(row_key(F.col(id_col), F.col(text_col)), F.lit(":"), F.hex(F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))))


def labelled(docs: DataFrame, id_col: str, text_col: str, radius: int, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, key, fp) of each row; (fp, first) with the first row of its component: not null, smallest id, then key."""
    spark = docs.sparkSession
    batches_of(spark)
    prints = cut(docs.select(F.col(id_col).alias("id"), (row_key(F.col(id_col), F.col(text_col)) if key is None else key).alias("key"), fingerprints(F.col(text_col)).alias("fp")))
    batches_of(spark, NUMBER_ROWS)
    values = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")))
    label = connected_components(cut(fingerprint_links(values.select("fp"), radius)))
    values = values.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = values.groupBy("component").agg(F.min("first").alias("first"))
    batches_of(spark)
    return prints, values.select("fp", "component").join(first, "component").select("fp", "first")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs' ids with fingerprint (hex) and component_id, one row for each row of docs.

    Links join fingerprints that differ in at most `radius` bits; component_id is the smallest id reachable, its own
    included. Null and empty texts have fingerprint zero and link like any other. Rows that share an id count as rows
    of their own; a null id is ignored in component_id unless all of a component's are null. An empty table gives no
    rows. Other columns of docs are not read.
    """
    prints, known = labelled(docs, id_col, text_col, radius)
    return prints.join(known, "fp").select(F.col("id").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without all but one document of each SimHash component: the one with the smallest id stays.

    Rows without an id stay only where their component has none with an id, and then one of them. Of rows that share
    the kept id, that with the smallest text hash stays, then that with the smallest hash of all columns, and one of
    those that are equal in all. The columns are those of docs; an empty table stays empty.

    Who stays is decided on ids, hashes and fingerprints. Texts are shuffled only where more than BROADCAST_ROWS go, and
    those of rows that repeat in all columns.
    """
    name = whole_key(docs, id_col, text_col)
    prints, known = labelled(docs, id_col, text_col, radius, name)
    (mark,) = fresh(docs, "row_key")
    told = cut(prints.join(known, "fp").select("key", (F.col("key") == F.col("first.key")).alias("stays")).groupBy("key", "stays").count())
    gone, repeated = told.where(~F.col("stays")), told.where(F.col("stays") & (F.col("count") > 1))
    out = docs.withColumn(mark, name)
    for rows, few in ((gone, gone.count() <= BROADCAST_ROWS), (repeated, repeated.count() <= BROADCAST_ROWS)):
        named = rows.select(F.col("key").alias(mark))
        named = F.broadcast(named) if few else named
        if rows is gone:
            out = out.join(named, mark, "left_anti")
        elif not rows.isEmpty():
            plain_unions(docs.sparkSession)
            out = out.join(named, mark, "left_anti").unionByName(out.join(named, mark, "left_semi").dropDuplicates([mark]))
    return out.drop(mark)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
