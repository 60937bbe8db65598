"""Benchmark decontamination with SimHash fingerprints of item-sized windows, in SQL functions alone.

Words are lower-cased runs of letters and digits; a shingle is five of them and weighs as often as it occurs. A window of a
document has as many words as the benchmark item it is held against and starts wherever so many of its shingles are in the item that
the threshold can be reached, whatever their order.
A 64-bit SimHash of its weighted shingles, from sums that run along the text once for all windows, is held against the fingerprints of the items of which it has
so many shingles. They are indexed by blocks of their bits, with all values that differ from a block's in few bits, so that no two fingerprints within the
radius miss each other. Candidates within the radius are verified by the exact weighted Jaccard similarity of their shingles.

Only documents that share enough shingles with the benchmark to reach the threshold for its shortest item, if need be as a text
shorter than that item, get windows;
a bit table of the benchmark's shingles tells which, and errs on the side of keeping: it grows with the benchmark up to :data:`MOST_BITS`, and beyond
keeps more documents, not fewer. The exact join that follows is broadcast where the benchmark has at most :data:`BROADCAST_ITEMS` shingles. Equal texts are worked on once.

Results: a null or blank text and an item without words match nothing; a text or item shorter than five words has one shingle; a text
shorter than an item is one window; a very long text is read whole; repeated rows and null ids each get the rows of their text; ties between starts
go to the smallest; an empty table on either side gives an empty result; other columns are not read by ``contaminated``, and pass unchanged through
``decontaminate``, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, literal_array, whole_rows

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BITS = 64
#: Blocks of the fingerprint; within the radius two of them differ in NEAR bits or fewer in one block at least. Values so near to a block of ten bits.
BLOCKS = 7
NEAR = RADIUS // BLOCKS
PROBES = sum(math.comb(10, k) for k in range(NEAR + 1))
#: Bits of a counter; a part of a text, which is as long as the longest item or SEGMENT shingles and the longest item beyond, has fewer shingles than it can count.
LANE, SEGMENT = 20, 4096
#: Rows of the index of item fingerprints up to which it is broadcast (some 20 MB).
BROADCAST_PROBES = 400_000
#: Least and most bits of the table (128 KB and 2 MB), bits for each shingle, and shingles of a benchmark up to which it is broadcast (some 3 MB).
LEAST_BITS, MOST_BITS, BITS_EACH, BROADCAST_ITEMS = 1 << 20, 1 << 24, 16, 1 << 16


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """Hashes of the shingles of a text, in order; null where it has no word."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(SHINGLE))))
        return F.when(F.size(h) >= SHINGLE, many).when(F.size(h) > 0, F.array(F.xxhash64(h)))

    return let(hashes, of)


def least_shared(m: Column, n: Column, similarity: float = SIMILARITY) -> Column:
    """Shingles that windows of ``m`` and ``n`` shingles share if their similarity reaches the threshold."""
    return F.greatest(F.ceil((m + n) * (similarity / (1 + similarity)) - 1e-9).cast("int"), F.lit(1))


def window_starts(at: Column, n: Column, doc_n: Column, least: Column) -> Column:
    """All starts of windows of ``n`` shingles that hold ``least`` or more of the sorted places ``at``, each once.

    A window whose first place is the k-th holds enough if it starts after the place before and reaches the place ``least - 1`` further on.
    """
    last = F.greatest(doc_n - n, F.lit(0))

    def of(k: Column) -> Column:
        low = F.greatest(F.get(at, k + least - 1) - n + 1, F.coalesce(F.get(at, k - 1) + 1, F.lit(0)), F.lit(0))
        return let(F.struct(low.alias("low"), F.least(F.get(at, k), last).alias("high")), lambda r: F.when(r["low"] <= r["high"], F.sequence(r["low"], r["high"])).otherwise(F.array().cast("array<int>")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - least), of))


def spread(h: Column, j: int) -> Column:
    """Bits ``3 j`` to ``3 j + 2`` of a hash in lanes of their own, so that sums of many hashes count each bit."""
    x = F.shiftrightunsigned(h, 3 * j).bitwiseAND(F.lit(7).cast("long"))
    return sum((x.bitwiseAND(F.lit(1 << k).cast("long")) * F.lit(1 << (LANE - 1) * k) for k in range(1, 3)), x.bitwiseAND(F.lit(1).cast("long")))


def majority(votes: Sequence[Column], n: Column) -> Column:
    """64-bit fingerprint from the sums of :func:`spread`: a bit is set where more than half of ``n`` shingles, by weight, have it."""
    lane = F.lit((1 << LANE) - 1).cast("long")
    bit = lambda b: F.when(F.shiftrightunsigned(votes[b // 3], LANE * (b % 3)).bitwiseAND(lane) * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(b))).otherwise(F.lit(0).cast("long"))
    return functools.reduce(lambda a, b: a.bitwiseOR(b), (bit(b) for b in range(BITS)))


COLUMNS = -(-BITS // 3)


def fingerprints(shingled: DataFrame, *keys: str) -> DataFrame:
    """``print`` of each item: rows ``keys``, ``shingle``, one for each occurrence."""
    summed = shingled.groupBy(*keys).agg(F.count("*").alias("m"), *(F.sum(spread(F.col("shingle"), j)).alias(f"c{j}") for j in range(COLUMNS)))
    return summed.select(*keys, majority([F.col(f"c{j}") for j in range(COLUMNS)], F.col("m")).alias("print"))


def window_prints(parts: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` (``text_key, seg, n, m, start, items``: ``m`` shingles from ``start`` on) with ``print``, from the parts of texts that hold them.

    Sums run along a part once, whatever the number of windows: what a window sums is what has run up to its end less what has run up to its start.
    """
    at = lambda pos, sign, items: F.struct(pos.alias("pos"), F.lit(sign).alias("sign"), items.alias("items"))
    no_items = F.lit(None).cast(windows.schema["items"].dataType)
    edges = windows.select("text_key", "seg", "n", "m", "start", F.inline(F.array(at(F.col("start"), -1, no_items), at(F.col("start") + F.col("m"), 1, F.col("items")))))
    steps = parts.select("text_key", "seg", F.posexplode("part").alias("pos", "shingle"))
    rows = edges.withColumn("shingle", F.lit(None).cast("long")).unionByName(steps, allowMissingColumns=True)
    so_far = Window.partitionBy("text_key", "seg").orderBy("pos", F.asc_nulls_first("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("text_key", "seg", "n", "m", "start", "sign", "items", *(F.sum(F.coalesce(spread(F.col("shingle"), j), F.lit(0))).over(so_far).alias(f"c{j}") for j in range(COLUMNS)))
    sums = running.where(F.col("sign").isNotNull()).groupBy("text_key", "seg", "n", "m", "start").agg(F.max("items").alias("items"), *(F.sum(F.col("sign") * F.col(f"c{j}")).alias(f"c{j}") for j in range(COLUMNS)))
    return sums.select("text_key", "seg", "n", "m", "start", "items", majority([F.col(f"c{j}") for j in range(COLUMNS)], F.col("m")).alias("print"))


def _edges() -> list[int]:
    return [BITS * i // BLOCKS for i in range(BLOCKS + 1)]


def blocks(fingerprint: Column) -> Column:
    """Number and value of each block of bits."""
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value")) for i, (a, b) in enumerate(zip(_edges(), _edges()[1:], strict=False))))


def probes(fingerprint: Column) -> Column:
    """The same with every value that differs in :data:`NEAR` bits or fewer: two fingerprints within the radius meet there, as they differ so little in some block."""

    def of(block: Column, width: int) -> Column:
        masks = [sum(1 << k for k in bits) for n in range(NEAR + 1) for bits in itertools.combinations(range(width), n)]
        return F.transform(literal_array(masks, "long"), lambda mask: F.struct(block["block"].alias("block"), block["value"].bitwiseXOR(mask).alias("value")))

    return let(blocks(fingerprint), lambda held: F.concat(*(of(held[i], b - a) for i, (a, b) in enumerate(zip(_edges(), _edges()[1:], strict=False)))))


def run_ends(s: Column) -> Column:
    """Last places (from 1) of the runs of equal elements."""
    return F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.element_at(s, i) != F.get(s, i)))


def numbered(hashes: Column) -> Column:
    """The shingles told apart by how many equal ones come before, so that the set has as many as the window has by weight."""
    mark = lambda s, e: F.transform(e, lambda last, j: F.transform(F.sequence(F.lit(1), last - F.coalesce(F.get(e, j - 1), F.lit(0))), lambda k: F.xxhash64(F.element_at(s, last), k)))
    return let(F.sort_array(hashes), lambda s: let(run_ends(s), lambda e: F.flatten(mark(s, e))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser weights over the sum of the greater weights of the shingles of two windows, the second of them :func:`numbered`."""
    return let(F.size(F.array_intersect(numbered(a), b)), lambda s: s / (F.size(a) + F.size(b) - s))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each text (by its MD5, ``text_key``) and item that it holds: the first best ``start`` (in shingles) and the ``similarity``."""
    items = cut_lineage(benchmark.select("item_id", shingles(F.col("text").cast("string")).alias("item")).where(F.col("item").isNotNull()).withColumn("n", F.size("item")))
    pieces = items.select("item_id", "n", F.posexplode("item").alias("at", "shingle"))
    facts = pieces.agg(F.count("*").alias("pieces"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("at") == 0).alias("items")).first()
    least = max(1, math.ceil((facts["least"] or 1) * similarity - 1e-9))  # what a text shorter than the item needs

    hashed = docs.select(F.md5(F.col("text").cast("string")).alias("text_key"), shingles(F.col("text").cast("string")).alias("doc")).where(F.col("doc").isNotNull())
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * facts["pieces"]).bit_length()))
    table = [0] * (n_bits // 64)
    slots = pieces.select(F.pmod("shingle", F.lit(n_bits)).cast("int").alias("slot"))
    for row in slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).collect():  # at most MOST_BITS / 64 numbers
        table[row["at"]] = row["bits"]
    bits = literal_array(table, "long")

    def known(h: Column) -> Column:
        return let(F.pmod(h, F.lit(n_bits)).cast("int"), lambda s: F.getbit(F.element_at(bits, F.shiftright(s, 6) + 1), s.bitwiseAND(63)) == 1)

    hits = F.filter(F.transform("doc", lambda h, i: F.when(known(h), i)), lambda i: i.isNotNull())
    hashed = hashed.withColumn("hits", hits).where(F.size("hits") >= least)
    texts = cut_lineage(hashed.dropDuplicates(["text_key"]))

    found = texts.select("text_key", F.size("doc").alias("doc_n"), F.explode(F.transform("hits", lambda i: F.struct(i.cast("int").alias("pos"), F.element_at("doc", i.cast("int") + 1).alias("shingle")))).alias("x"))
    distinct = pieces.select("item_id", "n", "shingle").distinct()
    small = F.broadcast(distinct) if facts["pieces"] <= BROADCAST_ITEMS else distinct
    shared = (
        found.select("text_key", "doc_n", "x.*")
        .join(small, "shingle")
        .groupBy("text_key", "doc_n", "n", "item_id")
        .agg(F.sort_array(F.collect_list("pos")).alias("at"))
        .withColumn("least", least_shared(F.least("doc_n", "n"), F.col("n"), similarity))
        .where(F.size("at") >= F.col("least"))
    )
    length = max(SEGMENT, facts["most"] or 1)
    pairs = shared.select("text_key", "item_id", "n", F.least("doc_n", "n").alias("m"), F.explode(window_starts(F.col("at"), F.col("n"), F.col("doc_n"), F.col("least"))).alias("start"))
    together = Window.partitionBy("text_key", "seg")
    windows = pairs.groupBy("text_key", F.floor(F.col("start") / length).cast("int").alias("seg"), "n", "m", "start").agg(F.collect_set("item_id").alias("items")).withColumn("low", F.min("start").over(together))
    windows = cut_lineage(windows)
    # a part holds every window that starts in its segment, from the first to the end of the last, so long texts are worked on in parts
    wanted = windows.groupBy("text_key", "seg", "low").agg(F.max(F.col("start") + F.col("m")).alias("high"))
    parts = cut_lineage(wanted.join(texts.select("text_key", "doc"), "text_key").select("text_key", "seg", "low", F.slice("doc", F.col("low") + 1, F.col("high") - F.col("low")).alias("part")))
    marked = window_prints(parts, windows.withColumn("start", F.col("start") - F.col("low")).drop("low"))

    item_prints = fingerprints(pieces.select("item_id", "shingle"), "item_id").withColumnRenamed("print", "item_print")
    indexed = item_prints.select("item_id", "item_print", F.inline(probes(F.col("item_print"))))
    n_probes = facts["items"] * BLOCKS * PROBES
    indexed = F.broadcast(indexed) if n_probes <= BROADCAST_PROBES else indexed
    met = (
        marked.select("text_key", "seg", "start", "m", "print", F.explode("items").alias("item_id"))
        .select("*", F.inline(blocks(F.col("print"))))
        .join(indexed, ["item_id", "block", "value"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    )
    # a pair of fingerprints may meet in several blocks: the first of them stands for all
    apart = F.transform(F.arrays_zip(blocks(F.col("print")).alias("a"), blocks(F.col("item_print")).alias("b")), lambda z: F.when(F.bit_count(z["a"]["value"].bitwiseXOR(z["b"]["value"])) <= NEAR, z["a"]["block"]))
    candidates = met.where(F.col("block") == F.array_min(apart)).select("text_key", "seg", "start", "m", "item_id")
    held = cut_lineage(items.select("item_id", numbered(F.col("item")).alias("item")))
    held = F.broadcast(held) if facts["pieces"] <= BROADCAST_ITEMS else held
    compared = candidates.join(parts, ["text_key", "seg"]).join(held, "item_id").withColumn("similarity", weighted_similarity(F.slice("part", F.col("start") + 1, F.col("m")), F.col("item")))
    verified = compared.where(F.col("similarity") >= similarity).withColumn("start", F.col("start") + F.col("low"))
    return verified.groupBy("text_key", "item_id").agg(F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).alias("start"), F.max("similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``item_id``, ``start`` and ``similarity`` of every leak."""
    keyed = docs.select("doc_id", F.md5(F.col("text").cast("string")).alias("text_key"))
    return keyed.join(leaks(docs, benchmark, similarity), "text_key").select("doc_id", "item_id", "start", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    bad = leaks(docs, benchmark, similarity).select("text_key").distinct()
    return whole_rows(docs, text_key=F.md5(F.col("text").cast("string"))).join(bad, "text_key", "left_anti").select("row.*")
