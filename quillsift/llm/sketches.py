"""Document fingerprints by invertible Bloom lookup sketches, with DataFrame operations only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import cut
from quillsift.session import joined_in_place, plain_unions

#: A paragraph is a line; longer lines are cut into parts of so many code points.
PARAGRAPH = 512
#: Parts of a line have at least and at most so many code points, a line's last one may have fewer. Between these they end at the
#: first place that the content sets: a blank after some letters, a sign, some characters in long runs without blanks, the line's end.
PART = 24, 64
PLACE = r"(?:(?<=[aeost][ \t])|(?<=[.,;:!?/\u3001\u3002\uff0c\uff01\uff1f])|(?<=[^ \t\n]{16}[aeiou0-3])|(?![^\n]))"
PARTS = rf"[^\n]{{{PART[0]},{PART[1]}}}?{PLACE}|[^\n]{{1,{PART[1]}}}"
#: Cells for each digest in each of a sketch's three tables, rounded up to a power of two, and rounds of peeling, a table each.
CELLS, ROUNDS = 8, 6
#: A retry's sketches are small ones, for digests of both versions together in one group, about so many.
LOAD = 10
#: Cells in each of such a sketch's three tables, and peeling steps: tried in turn, the next when one fails.
SIZES = ((8, 18), (24, 30), (96, 45), (400, 60))
#: Documents sorted together to find each one's next, most such buckets, and the sampled ids for each bucket's border.
BUCKET, MOST_BUCKETS, SAMPLED = 500, 1 << 16, 4
#: Code points that order texts of one id before a hash does, and characters of text in one partition, about.
HEAD, PARTITION_CHARS = 32, 2_000_000
#: Most partitions that texts are dealt to.
MOST_PARTITIONS = 1 << 17


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def digests(text: Column, pattern: str = f"[^\\n]{{1,{PARAGRAPH}}}") -> Column:
    """Distinct 64-bit digests of a text's paragraphs, or of what pattern finds; empty lines are none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def cell_of(key: Column, table: Column | int, cells: int) -> Column:
    """The cell that a digest has in one of the three tables."""
    return F.pmod(F.xxhash64(key, F.lit(table) if isinstance(table, int) else table), F.lit(cells)).cast("int")


def checksum(key: Column) -> Column:
    return F.xxhash64(key, F.lit(97))


def cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.cast("int").alias("count"), key.cast("long").alias("key"), check.cast("long").alias("check"))


def sketch(keys: Column, cells: int) -> Column:
    """3 * cells cells, each the number of its digests, and the exclusive-or of these and of their checksums."""
    known = F.transform(keys, lambda x: F.struct(x.alias("x"), checksum(x).alias("c"), *(cell_of(x, t, cells).alias(f"t{t}") for t in range(3))))

    def table(known: Column, t: int) -> Column:
        none = cell(F.lit(0), F.lit(0), F.lit(0))
        here = lambda i: F.filter(known, lambda x: x[f"t{t}"] == i)
        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.aggregate(here(i), none, lambda a, x: cell(a["count"] + 1, a["key"].bitwiseXOR(x["x"]), a["check"].bitwiseXOR(x["c"]))))

    return bound(known, lambda k: F.concat(*(table(k, t) for t in range(3))))


def subtract(a: Column, b: Column) -> Column:
    """The sketch of what two sketches of one size do not share: in a alone with count 1, in b alone with count -1."""
    return F.zip_with(a, b, lambda x, y: cell(x["count"] - y["count"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def peel(cells_: Column, cells: int, steps: int) -> Column:
    """(recovered, done): digests of a subtracted sketch, with their signs, and whether nothing is left in it.

    A step looks at one of the three tables, in turn, where a digest has one cell alone, so none is recovered twice:
    cells that hold a single digest give it up and it is taken out of all tables.
    """

    def step(state: Column, k: Column) -> Column:
        table = F.pmod(k, F.lit(3))
        own = F.slice(state["cells"], table * cells + 1, cells)
        single = F.filter(own, lambda c: (F.abs(c["count"]) == 1) & (checksum(c["key"]) == c["check"]))
        single = F.transform(single, lambda c: F.struct(c["count"].alias("count"), c["key"].alias("key"), c["check"].alias("check"), *(cell_of(c["key"], t, cells).alias(f"t{t}") for t in range(3))))

        def without(found: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                here = F.filter(found, lambda x: (x["t0"] == i) | (x["t1"] + cells == i) | (x["t2"] + 2 * cells == i))
                return F.aggregate(here, c, lambda a, x: cell(a["count"] - x["count"], a["key"].bitwiseXOR(x["key"]), a["check"].bitwiseXOR(x["check"])))

            return F.struct(F.transform(state["cells"], one).alias("cells"), F.concat(state["recovered"], F.transform(found, lambda x: F.struct(x["key"].alias("digest"), x["count"].alias("sign")))).alias("recovered"))

        # bound once, by folding over a list of one
        return F.aggregate(F.array(single), state, lambda s, found: F.when(F.size(found) > 0, without(found)).otherwise(s))

    none = F.array().cast("array<struct<digest:bigint,sign:int>>")
    start = F.struct(cells_.alias("cells"), none.alias("recovered"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step)
    return F.aggregate(F.array(end), F.struct(none.alias("recovered"), F.lit(False).alias("done")), lambda _, s: F.struct(s["recovered"].alias("recovered"), (~F.exists(s["cells"], lambda c: (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0))).alias("done")))


def recovered(a: Column, b: Column, sizes: tuple[tuple[int, int], ...]) -> Column:
    """Digests in only one of a and b, with sign 1 or -1, from their sketches; null if even the largest fails."""
    attempts = [F.aggregate(F.array(peel(subtract(sketch(a, c), sketch(b, c)), c, steps)), F.lit(None).cast("array<struct<digest:bigint,sign:int>>"), lambda _, r: F.when(r["done"], r["recovered"])) for c, steps in sizes]
    return F.coalesce(*attempts)


def deal(keys: Column, bits: Column) -> Column:
    """2 ** bits arrays, the digests by their leading bits: one sort, with a mark before each group, and a slice for each group."""
    half = F.call_function("shiftleft", F.lit(1).cast("long"), (bits - 1).cast("int"))
    first = F.transform(F.sequence(-half, half - 1), lambda g: F.struct(F.call_function("shiftleft", g, (64 - bits).cast("int")).alias("x"), F.lit(0).alias("own")))

    def cut_up(dealt: Column) -> Column:
        marks = F.filter(F.transform(dealt, lambda x, i: F.when(x["own"] == 0, i)), lambda i: i.isNotNull())
        return bound(marks, lambda m: F.transform(m, lambda i, g: F.transform(F.slice(dealt, i + 2, F.coalesce(F.get(m, g + 1), F.size(dealt)) - i - 1), lambda x: x["x"])))

    dealt = F.array_sort(F.concat(first, F.transform(keys, lambda x: F.struct(x.alias("x"), F.lit(1).alias("own")))))
    return F.when(bits < 1, F.array(keys)).otherwise(bound(dealt, cut_up))


def only_in_one(a: Column, b: Column) -> Column:
    """What peeling recovers, by comparing the digests themselves: where no sketch can be peeled."""
    mark = lambda x, y, sign: F.transform(F.array_except(x, y), lambda d: F.struct(d.alias("digest"), F.lit(sign).alias("sign")))
    return F.concat(mark(a, b, 1), mark(b, a, -1))


def difference(a: Column, b: Column, sizes: tuple[tuple[int, int], ...] = SIZES, load: int = LOAD) -> Column:
    """Digests in only one of the arrays a and b, with sign 1 (in a) or -1, recovered from sketches of both.

    Digests are dealt by their leading bits to groups of about `load`, so that a sketch stays small however long the
    texts are; both versions use the same groups. A group that cannot be peeled is sketched again, larger, and after the
    largest size compared as it is, so the result is never null.
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2((F.size(a) + F.size(b)) / F.lit(float(load))))).cast("int")
    whole = lambda p: F.coalesce(recovered(p["a"], p["b"], sizes), only_in_one(p["a"], p["b"]))
    return F.flatten(bound(F.coalesce(bits, F.lit(0)), lambda n: F.transform(F.arrays_zip(deal(a, n).alias("a"), deal(b, n).alias("b")), whole)))


# Sketches of whole tables: a row for each cell that is not empty


#: What a cell's slot tells beside its place: the comparison, the kind of digests, the table (RESULT: none) and the size's bits.
LINES, SHORT, OWN_PRINT, NEW_PRINT = range(4)
RESULT, CELL_BITS = 3, 48
#: Beside the roles of a text's three versions: the number of its own digests, at place 2 of table RESULT.
NUMBER = 3


def slot_of(comparison: Column | int, kind: Column | int, table: Column | int, bits: Column | int, place: Column) -> Column:
    fields = [x if isinstance(x, Column) else F.lit(x) for x in (comparison, kind, table, bits)]
    head = ((fields[0] * 4 + fields[1]) * 4 + fields[2]) * 64 + fields[3]
    return F.shiftleft(head.cast("long"), CELL_BITS).bitwiseOR(place)


def field(slot: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(slot, low).bitwiseAND(F.lit((1 << width) - 1))


def place(digest: Column, table: int, bits: Column) -> Column:
    """A digest's cell in one of the tables of 2 ** bits cells: a larger sketch's folds into a smaller one's."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1
    return F.xxhash64(digest, F.lit(table)).bitwiseAND(mask)


def size_bits(digests_: Column, cells: int) -> Column:
    """Bits of a sketch's size, from the number of its digests alone."""
    return F.ceil(F.log2(F.greatest(F.size(digests_), F.lit(1)) * F.lit(float(cells)))).cast("int")


def peel_cells(cells: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """keys, slot, n, key, check: what is left of subtracted cells after peeling, and in table RESULT what was recovered.

    Each round looks at one table, in turn, where a digest has one cell alone: a cell that holds a single digest gives it
    up, and it leaves its cells of the other two tables. Cells are added up by keys and slot, without a shuffle if the
    rows are partitioned by some of the keys already. RESULT has the number of digests recovered, at place 0 those of
    the first version, at place 1 those of the second.
    """
    for k in range(rounds):
        t = k % 3
        slot, bits = F.col("slot"), field(F.col("slot"), CELL_BITS, 6)
        single = (field(slot, CELL_BITS + 6, 2) == t) & (F.abs("n") == 1) & (F.xxhash64("key", F.lit(97)) == F.col("check"))
        upper = F.shiftrightunsigned(slot, CELL_BITS + 8) * 256
        at = lambda table, where: F.shiftleft(upper + table * 64 + bits, CELL_BITS).bitwiseOR(where)  # noqa: E731, B023
        made = lambda s, n, key, check: F.struct(s.alias("slot"), n.alias("n"), key.alias("key"), check.alias("check"))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        gone = [made(at(o, place(F.col("key"), o, bits)), -F.col("n"), F.col("key"), F.col("check")) for o in range(3) if o != t]
        found = F.array(made(at(RESULT, F.when(F.col("n") > 0, none).otherwise(one)), one, none, none), *gone)
        each = cells.select(*keys, F.explode(F.when(single, found).otherwise(F.array(made(slot, F.col("n"), F.col("key"), F.col("check"))))).alias("c")).select(*keys, "c.*")
        cells = each.groupBy(*keys, "slot").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
        cells = cells.where("n <> 0 or key <> 0 or check <> 0")
    return cells


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = PARTS, cells: int = CELLS) -> DataFrame:
    """id, bits, n_digests, cells: a sketch of each row of docs, to be kept and compared with those of later versions.

    cells: array of (tab, place, n, key, check), the cells that are not empty of three tables of 2 ** bits cells each;
    the size follows from the text's own number of digests. Null and empty texts have no cells. Rows that share an id
    are sketched each by itself. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), digests(F.col(text_col), pattern).alias("digests"))
    rows = rows.select("row", "id", "digests", size_bits(F.col("digests"), cells).alias("bits"), F.size("digests").alias("n_digests"))
    each = rows.select("row", "id", "bits", "n_digests", F.explode_outer("digests").alias("digest"))
    table = each.select("row", "id", "bits", "n_digests", "digest", F.explode(F.array(*(F.struct(F.lit(t).alias("tab"), place(F.col("digest"), t, F.col("bits")).alias("place")) for t in range(3)))).alias("at"))
    added = table.groupBy("row", "id", "bits", "n_digests", "at").agg(F.count("digest").alias("n"), F.bit_xor("digest").alias("key"), F.bit_xor(F.when(F.col("digest").isNotNull(), F.xxhash64("digest", F.lit(97)))).alias("check"))
    full = F.collect_list(F.when(F.col("n") > 0, F.struct("at.tab", "at.place", "n", "key", "check")))
    return added.groupBy("row", "id", "bits", "n_digests").agg(F.array_sort(full).alias("cells")).select(F.col("id").alias(id_col), "bits", "n_digests", "cells")


def compare_sketches(old: DataFrame, new: DataFrame, id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """id, only_old, only_new, done: digests in one of two kept sketches of an id alone, for ids (unique) that both tables have.

    The larger sketch is folded to the size of the smaller one and one is subtracted from the other. done is false where
    too much differs for the size: sketch both texts with more cells then.
    """
    plain_unions(old.sparkSession)
    ids = old.select(F.col(id_col).alias("id"), F.col("bits").alias("a"), F.col("cells").alias("one")).join(new.select(F.col(id_col).alias("id"), F.col("bits").alias("b"), F.col("cells").alias("two")), "id")
    ids = ids.withColumn("bits", F.least("a", "b"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    signed = lambda cells_, sign: F.transform(cells_, lambda c: F.struct(slot_of(0, 0, c["tab"], F.col("bits"), c["place"].bitwiseAND(mask)).alias("slot"), (c["n"] * sign).alias("n"), c["key"].alias("key"), c["check"].alias("check")))
    each = ids.select("id", F.explode(F.concat(signed(F.col("one"), 1), signed(F.col("two"), -1))).alias("c")).select("id", "c.*")
    cells = each.groupBy("id", "slot").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")).where("n <> 0 or key <> 0 or check <> 0")
    left = peel_cells(cells, ["id"], rounds)
    result = field(F.col("slot"), CELL_BITS + 6, 2) == RESULT
    found = left.groupBy("id").agg(*(F.coalesce(F.sum(F.when(result & (F.col("slot").bitwiseAND(F.lit((1 << CELL_BITS) - 1)) == p), F.col("n"))), F.lit(0)).alias(c) for p, c in enumerate(("only_old", "only_new"))), F.count(F.when(~result, 1)).alias("open"))
    rows = ids.select("id").join(found, "id", "left")
    return rows.select(F.col("id").alias(id_col), F.coalesce("only_old", F.lit(0)).alias("only_old"), F.coalesce("only_new", F.lit(0)).alias("only_new"), (F.coalesce("open", F.lit(0)) == 0).alias("done"))


# Versions of documents


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text) with `next`, the text of the next one in order; of the last, that of the first.

    The order is that of id, null first, then of the text's first HEAD code points, then of a hash of the text. Borders
    of buckets are taken from a sample of this order, of at most SAMPLED rows for each of at most MOST_BUCKETS, so rows
    that share an id are split as any others; only rows equal in id and text stay together. A row on a bucket's border is
    sent to the bucket before as well, so each bucket finds its last row's next by itself. Every text is shuffled once.
    bucket and row name a row; lines, short and next_short, next_lines are digests of both texts.
    """
    spark = docs.sparkSession
    order = F.struct(F.col("id"), F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"))
    n, chars, first = docs.agg(F.count("*"), F.sum(F.length("text")), F.min(order)).first()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET))
    kind = docs.select(order.alias("o")).schema["o"].dataType.simpleString()
    known = []
    if buckets > 1:
        sample = docs.select(order.alias("o")).where(F.pmod(F.xxhash64("o"), F.lit(max(1, n // (buckets * SAMPLED)))) == 0).distinct().orderBy("o").collect()
        known = [r["o"] for r in sample[:: max(1, len(sample) // buckets)]][1:]
    starts = F.from_json(F.lit(json.dumps([x.asDict() for x in known], default=str)), f"array<{kind}>")
    lowest = F.from_json(F.lit(json.dumps(first.asDict() if first else None, default=str)), kind)
    at = F.lit(0)
    if known:  # binary search: how many buckets start at or before the row
        steps = [1 << k for k in reversed(range(len(known).bit_length()))]
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.get(starts, a + s - 1) <= F.col("key"), a + s).otherwise(a))
    rows = docs.select("text", order.alias("key")).withColumn("bucket", at)
    place_ = lambda bucket, guest, wrap: F.struct(bucket.alias("bucket"), F.lit(guest).alias("guest"), F.lit(wrap).alias("wrap"))
    places = F.array_compact(F.array(
        place_(F.col("bucket"), False, False),
        F.when((F.col("bucket") > 0) & (F.get(starts, F.col("bucket") - 1) == F.col("key")), place_(F.col("bucket") - 1, True, False)),
        F.when(F.col("key").eqNullSafe(lowest), place_(F.lit(len(known)), True, True)),
    ))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, (chars or 0) // PARTITION_CHARS))
    # the id is taken out of the key again and no bucket is null, so that all readers need the same columns and filters and share one shuffle
    dealt = rows.select("text", "key", F.explode(places).alias("place")).select("text", "key", F.coalesce("place.bucket", F.lit(0)).alias("bucket"), "place.guest", "place.wrap").repartition(width, "bucket")
    dealt = dealt.select("*", digests(F.col("text")).alias("lines"), digests(F.col("text"), PARTS).alias("short"))
    sort = Window.partitionBy("bucket").orderBy("wrap", "key", "guest")
    following = dealt.select("*", *(F.lead(c).over(sort).alias(n) for c, n in (("text", "next"), ("lines", "next_lines"), ("short", "next_short"))), F.row_number().over(sort).alias("row"))
    return following.where("not guest").select(F.col("key.id").alias("id"), "text", "next", "bucket", "row", "lines", "short", "next_lines", "next_short")


def edit(rows: DataFrame) -> DataFrame:
    """rows with n_chars and `edited`, the text whose last half, rounded down, is replaced by the first as many code points of the next."""
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    return rows.withColumn("n_chars", chars.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next"), F.lit(1), half)))


def subtracted(rows: DataFrame, cells: int) -> DataFrame:
    """bucket, row, slot, n, key, check: cells of each text's sketch less those of its edited and its next text's sketch.

    Sketches have a size for each version alone; a document's three are compared at the largest of their sizes, which
    costs nothing, as only cells that are not empty are rows. Cells of the line sketches at their own sizes come along
    as what the fingerprints are made of.
    """
    versions = []
    for kind, own, new, other in ((LINES, "lines", digests(F.col("edited")), "next_lines"), (SHORT, "short", digests(F.col("edited"), PARTS), "next_short")):
        versions.append((kind, F.col(own), new, F.col(other)))
    made = rows.select("bucket", "row", *(c.alias(f"{name}{kind}") for kind, *cs in versions for name, c in zip(("own", "new", "other"), cs, strict=True)))
    entry = lambda kind, role, bits, source: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), bits.alias("bits"), F.col(source).alias("digests"))
    entries = []
    for kind in (LINES, SHORT):
        sizes = [size_bits(F.col(f"{name}{kind}"), cells) for name in ("own", "new", "other")]
        entries += [entry(kind, role, F.greatest(*sizes), f"{name}{kind}") for role, name in enumerate(("own", "new", "other"))]
        entries.append(F.struct(F.lit(kind).alias("kind"), F.lit(NUMBER).alias("role"), F.lit(0).alias("bits"), F.array(F.size(f"own{kind}").cast("long")).alias("digests")))
        entries += [entry(prints, role, sizes[role], f"{name}{kind}") for prints, role, name in ((OWN_PRINT, 0, "own"), (NEW_PRINT, 1, "new")) if kind == LINES]
    each = made.select("bucket", "row", F.explode(F.array(*entries)).alias("v")).select("bucket", "row", "v.kind", "v.role", "v.bits", F.explode("v.digests").alias("key"))
    none, number = F.lit(0).cast("long"), F.col("role") == NUMBER
    slots = F.array(*(slot_of(0, F.col("kind"), t, F.col("bits"), place(F.col("key"), t, F.col("bits"))) for t in range(3)))
    slots = F.when(number, F.array(slot_of(0, F.col("kind"), RESULT, 0, F.lit(2).cast("long")))).otherwise(slots)
    each = each.select("bucket", "row", "role", "key", F.xxhash64("key", F.lit(97)).alias("check"), F.explode(slots).alias("slot"))
    sums = []
    for role in range(3):
        mine = F.col("role") == role
        one = F.when(mine, F.lit(1).cast("long"))
        sums += [F.sum((one.when(number, F.col("key")) if role == 0 else one).otherwise(none)).alias(f"n{role}"), F.bit_xor(F.when(mine, F.col("key")).otherwise(none)).alias(f"key{role}"), F.bit_xor(F.when(mine, F.col("check")).otherwise(none)).alias(f"check{role}")]
    sketched = each.groupBy("bucket", "row", "slot").agg(*sums)
    kind = field(F.col("slot"), CELL_BITS + 8, 2)

    def less(role: int) -> Column:
        return F.struct(slot_of(role - 1, 0, 0, 0, F.col("slot")).alias("slot"), (F.col("n0") - F.col(f"n{role}")).alias("n"), F.col("key0").bitwiseXOR(F.col(f"key{role}")).alias("key"), F.col("check0").bitwiseXOR(F.col(f"check{role}")).alias("check"))

    # own and edited sketch alone: what tells the version is left out, so that equal sketches give equal prints
    alone = (F.col("slot").bitwiseAND(F.lit((1 << CELL_BITS + 8) - 1)), F.col("n0") + F.col("n1"), F.col("key0").bitwiseXOR(F.col("key1")), F.col("check0").bitwiseXOR(F.col("check1")))
    printed = F.struct(slot_of(2, kind, RESULT, 0, none).alias("slot"), F.lit(1).cast("long").alias("n"), F.xxhash64(*alone).alias("key"), F.xxhash64(F.lit(1), *alone).alias("check"))
    both = F.when(kind < OWN_PRINT, F.array(less(1), less(2))).otherwise(F.array(printed))
    return sketched.select("bucket", "row", F.explode(both).alias("c")).select("bucket", "row", "c.*").where("n <> 0 or key <> 0 or check <> 0")


#: Names of what a comparison with the edited text and with the next text finds in lines and in short parts.
FOUND = {(0, LINES): "edited_lines", (1, LINES): "next_lines", (0, SHORT): "edited_short", (1, SHORT): "next_short"}


def compared(rows: DataFrame, cells: int, rounds: int) -> DataFrame:
    """id, n_chars, edited_sha256, two fingerprints, n_lines, n_short, of each of FOUND only_own, only_other and open, and text and next.

    open: cells that peeling has left; the counts hold where there are none. text and next are kept for the rows that
    have any, else null. Texts and counts are both dealt by bucket, so that under joined_in_place() neither is shuffled
    to meet.
    """
    rows = edit(rows)
    left = peel_cells(subtracted(rows, cells), ["bucket", "row"], rounds)
    slot = F.col("slot")
    number, at = field(slot, CELL_BITS + 8, 4), slot.bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    result = field(slot, CELL_BITS + 6, 2) == RESULT
    sums = []
    for (comparison, kind), name in FOUND.items():
        mine = number == comparison * 4 + kind
        sums += [F.sum(F.when(mine & result & (at == p), F.col("n")).otherwise(0)).alias(f"{name}_{only}") for p, only in enumerate(("own", "other"))]
        sums.append(F.sum(F.when(mine & ~result, 1).otherwise(0)).alias(f"{name}_open"))
    sums += [F.sum(F.when((number == kind) & result & (at == 2), F.col("n")).otherwise(0)).alias(name) for kind, name in ((LINES, "n_lines"), (SHORT, "n_short"))]
    for kind in (OWN_PRINT, NEW_PRINT):
        sums += [F.bit_xor(F.when(number == 8 + kind, F.col(c)).otherwise(F.lit(0).cast("long"))).alias(f"{c}{kind}") for c in ("key", "check")]
    counts = left.groupBy("bucket", "row").agg(*sums)
    known = rows.select("bucket", "row", "id", "text", "next", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    joined = known.join(counts, ["bucket", "row"], "left")
    print_of = lambda kind: F.lower(F.concat(*(F.lpad(F.hex(F.coalesce(F.col(f"{c}{kind}"), F.lit(0).cast("long"))), 16, "0") for c in ("key", "check"))))
    numbers = [F.coalesce(F.col(f"{name}_{c}"), F.lit(0).cast("long")).alias(f"{name}_{c}") for name in FOUND.values() for c in ("own", "other", "open")]
    numbers += [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_lines", "n_short")]
    texts = [F.when(F.greatest(*(F.coalesce(F.col(f"{name}_open"), F.lit(0)) for name in FOUND.values())) > 0, F.col(c)).alias(c) for c in ("text", "next")]
    return joined.select("id", "n_chars", "edited_sha256", print_of(OWN_PRINT).alias("fingerprint"), print_of(NEW_PRINT).alias("edited_fingerprint"), *numbers, *texts)


def again(failed: DataFrame) -> DataFrame:
    """compared() for its rows whose peeling failed, from their texts: by small sketches in groups, larger and larger, which end exactly."""
    same = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "n_lines", "n_short"]
    # columns of their own, as difference() names its arrays more than once
    made = edit(failed).select(*same, *(of.alias(f"{c}_{kind}_") for c in ("text", "edited", "next") for kind, of in (("lines", digests(F.col(c))), ("short", digests(F.col(c), PARTS)))))
    some = made.select(*same, *(difference(F.col(f"text_{name.split('_')[1]}_"), F.col(f"{name}_")).alias(name) for name in FOUND.values()))
    only = lambda name, sign: F.size(F.filter(name, lambda x: x["sign"] == sign)).cast("long")
    numbers = []
    for name in FOUND.values():
        numbers += [only(name, 1).alias(f"{name}_own"), only(name, -1).alias(f"{name}_other"), F.lit(0).cast("long").alias(f"{name}_open")]
    return some.select(*same, *numbers)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited version, and their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare_versions(docs)


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_changed, parts_edited, parts_next, n_changed_parts: one row for each row of docs.

    The edited text has its last half, rounded down, replaced by the first as many code points of the next document.
    near_* are the shares of paragraph digests that two texts have in common, from the differing digests that peeling
    their subtracted sketches recovers; n_changed is their number between a text and its edited text.
    parts_* and n_changed_parts are the same over short parts of lines that end where the content says, so that what an
    edit leaves alone counts as shared also within a line. A fingerprint is 32 hex digits, made of all cells of a text's
    sketch. Equal texts have equal fingerprints; of a text, paragraphs that repeat and their order do not count.
    All work grows in proportion to the texts. Rows whose peeling fails are sketched again, and in the end compared as
    they are, so no likeness is null.

    Null texts are read as empty, which are alike (1). Rows that share an id follow each other by their first HEAD code
    points, then by a hash; a null id comes first; ids may be of any type that is ordered. Rows equal in id and text
    are the only ones that one task needs together. A single document is its own next. An empty table gives no rows;
    other columns are not read.
    """
    plain_unions(docs.sparkSession)
    rows = with_next(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    with joined_in_place(docs.sparkSession):
        known = cut(compared(rows, CELLS, ROUNDS))
    failed = known.where("text is not null")
    if not failed.isEmpty():
        known = known.where("text is null").drop("text", "next").unionByName(cut(again(failed)))

    def likeness(name: str, n: str) -> Column:
        every = F.col(n) + F.col(f"{name}_other")
        return F.when(every == 0, 1.0).otherwise((F.col(n) - F.col(f"{name}_own")) / every)

    changed = lambda name: (F.col(f"{name}_own") + F.col(f"{name}_other")).cast("long")
    return known.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("edited_lines", "n_lines").alias("near_edited"), likeness("next_lines", "n_lines").alias("near_next"), changed("edited_lines").alias("n_changed"),
        likeness("edited_short", "n_short").alias("parts_edited"), likeness("next_short", "n_short").alias("parts_next"), changed("edited_short").alias("n_changed_parts"),
    )
