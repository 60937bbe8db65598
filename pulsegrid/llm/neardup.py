"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are lower-cased runs of letters and digits; a shingle is five of them, labelled with its occurrence number in the text. For
each of :data:`SKETCHES` hash functions the smallest few labelled shingles, in the order of the text, make a key. Texts that
share a key are candidates. The similarity of two texts is ``c / (a + b - c)`` for ``a`` and ``b`` shingles of which ``c`` are aligned in the
same order inside a band; it never exceeds the Jaccard index of the labelled shingles. 0.8 or more makes a link, and connected texts make a
class.

Equal texts are one node from the start, and groups of equal members are one group. Each text is first compared with one other, the centre of
its groups: the text with most company in them, most likely the original. That settles most. Groups that are still in several classes are
then searched in blocks of bounded size: the texts outside the largest class of a group are held against all of it, an index of the shingles of a block
tells which pairs can be similar, and links between classes alone leave the task. So no link between the classes of a
group is missed, and no group makes its pairs as rows. Where very many unlike texts share a key, as with a passage that all of them hold, each would be held against all; such groups are first
split by their rarest shingles: two similar texts share one of those that stand first when the shingles of each are ordered by the number of texts that have them, so texts that these do
not connect need not meet. That is exact, and a text is in one part only.

Skewed keys: the text of a centre is repeated for shares of those compared with it, blocks split groups, and joins on a class or on a copied
text are between a large and a one-row side, which adaptive execution splits.

Results: a null text, or one without words, is a class of its own row; a text of fewer than five words is one shingle; a very long text is read
whole; classes are named by their smallest id, which is null if all ids are null; of equal texts and ties the smallest id, then the least MD5, stays;
rows of equal id and text count as one document and stay or go together; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, slices, whole_rows
from pulsegrid.llm.hashing import WordHashes, mix, runs

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
#: Shingles in a key, for texts from so many shingles and below so many; the ranges overlap so that similar texts share a kind.
KEY_SIZES = ((2, 1, 16), (6, 12, math.inf))
#: Texts compared with one copy of a centre, shingles in a block of a group, and blocks outside the largest class from which a group is split.
FAN, BLOCK, WIDE = 1000, 1 << 20, 8
WORD = re.compile(r"[^\W_]+")
_FACTORS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(text: str, words: WordHashes) -> np.ndarray:
    h = words(WORD.findall(text.lower()))
    return runs(h, min(SHINGLE, len(h))) if len(h) else h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with the number of earlier equal ones mixed in."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty_like(h)
    out[order] = mix(s + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return out


def order_minhash(marked: np.ndarray) -> list[int]:
    """Keys of a text: of each hash function the least labelled shingles in text order."""
    n, keys = len(marked), set()
    for size, low, high in KEY_SIZES:
        if not low <= n < high:
            continue
        k = min(size, n)
        for part in np.array_split(_FACTORS, max(1, n * SKETCHES >> 21)):  # a few functions at a time for very long texts
            values = marked[None] * part[:, None]
            least = np.sort(np.argpartition(values, k - 1, axis=1)[:, :k], axis=1) if k < n else np.tile(np.arange(n), (len(part), 1))
            key = part * np.uint64(size)
            for i in range(k):
                key = mix(key * np.uint64(31) + marked[least[:, i]])
            keys.update(key.view(np.int64).tolist())
    return sorted(keys)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity by the longest common subsequence inside the band that ``similarity`` allows; 0 if it is surely less."""
    if len(a) > len(b):
        a, b = b, a
    total = len(a) + len(b)
    need = math.ceil(total * similarity / (1 + similarity) - 1e-9)
    if not len(a) or need > len(a):
        return 0.0
    start = 0
    differ = np.flatnonzero(a != b[: len(a)])
    start = int(differ[0]) if len(differ) else len(a)
    a2, b2 = a[start:], b[start:]
    back = np.flatnonzero(a2[::-1] != b2[len(b2) - len(a2) :][::-1])
    end = int(back[0]) if len(back) else len(a2)
    a2, b2 = a2[: len(a2) - end], b2[: len(b2) - end]
    common = start + end
    if len(a2) and common + np.count_nonzero(np.isin(a2, b2)) < need:
        return 0.0
    if len(a2):
        common += _banded_lcs(a2, b2, total - 2 * need)
    return common / (total - common) if common >= need else 0.0


def _banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose pairs of places differ by ``band`` at most, 64 and more columns at a time in one integer."""
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        at.setdefault(x, []).append(j)
    width = 2 * band + 1
    ones = (1 << width) - 1
    row, low, out = ones, -band, 0  # bit k stands for column low + k; a zero bit is a step of the length
    for i, x in enumerate(a.tolist()):
        shift = i - band - low
        if shift:
            gone = row & ((1 << shift) - 1)
            first = max(0, -low)  # columns before the text do not count
            if shift > first:
                out += shift - first - (gone >> first).bit_count()
            row = row >> shift | (((1 << shift) - 1) << (width - shift))
            low += shift
        here = sum(1 << (j - low) for j in at.get(x, ()) if 0 <= j - low < width)
        if here:
            row = ((row + (row & here)) | (row & ~here)) & ones
    first = max(0, -low)
    return out + (width - first) - (row >> first).bit_count()


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string")))


def _mapped(rows: DataFrame, fields: str, each) -> DataFrame:
    """``key`` and what ``each`` gives for the text, for texts with a word."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in slices(batch, 1 << 22):
                keep, out = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    h = shingle_hashes(text, words) if text else ()
                    if len(h):
                        keep.append(i)
                        out.append(each(labelled(h)))
                rest = part.drop_columns(["text"]).take(pa.array(keep, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], names=[*rest.schema.names, *names])

    types = [{"int": pa.int32(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[f.split()[1]] for f in fields.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text") + ", " + fields
    return rows.mapInArrow(run, schema)


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """``group``, ``key``, ``n`` and ``size`` for texts that share a key; of groups with the same members one stays."""
    members = nodes.select(F.explode("keys").alias("group"), "key", "n")
    both = (F.bit_xor(F.xxhash64("key", F.lit(seed))).alias(f"members{seed}") for seed in (1, 2))
    sizes = members.groupBy("group").agg(F.count("*").alias("size"), *both).where(F.col("size") > 1)
    return members.join(sizes.groupBy("size", "members1", "members2").agg(F.min("group").alias("group")).select("group", "size"), "group")


def centres(grouped: DataFrame) -> DataFrame:
    """``key`` and the ``centre`` it is compared with, the text of most ``company`` in any of its groups; those that are their own are left out."""
    company = grouped.groupBy("key").agg(F.sum("size").alias("company"))
    of_group = grouped.join(company, "key").groupBy("group").agg(F.max(F.struct("company", "key")).alias("centre"))
    best = grouped.join(of_group, "group").groupBy("key").agg(F.max("centre").alias("centre"))
    return best.select("key", F.col("centre.key").alias("centre"), "centre.company").where(F.col("key") != F.col("centre"))


def verified(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``key`` and ``centre`` whose texts are similar; a centre goes to as many shares as its company needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity) >= similarity for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["key", "centre"]).filter(pa.array(ok, pa.bool_()))

    shares = F.ceil(F.col("company") / FAN)
    mine = pairs.withColumn("share", F.pmod(F.xxhash64("key"), shares)).join(sequences.withColumnRenamed("seq", "x"), "key")
    held = pairs.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share")).distinct()
    held = held.join(sequences.select(F.col("key").alias("centre"), F.col("seq").alias("y")), "centre")
    return mine.join(held, ["centre", "share"]).select("key", "centre", "x", "y").mapInArrow(run, "key binary, centre binary")


def roots(parents: DataFrame) -> DataFrame:
    """``key`` and ``label``, the last of its line of centres; company grows along a line, so there are no rings."""
    labels = parents.select("key", F.col("centre").alias("label"))
    while True:
        after = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
        new = cut_lineage(labels.join(after, "label", "left").select("key", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")))
        labels = new.select("key", "label")
        if new.where("moved").isEmpty():
            return labels


def unsettled(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their ``label``, of groups that are in several classes."""
    named = grouped.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = named.groupBy("group").agg(F.min("label").alias("p"), F.max("label").alias("q")).where(F.col("p") != F.col("q")).select("group")
    return named.join(several, "group", "left_semi")


def group_sizes(open_groups: DataFrame) -> DataFrame:
    """Of each ``group`` its largest class ``main``, and the shingles of ``all`` texts and of the ``others`` outside that class."""
    counts = open_groups.groupBy("group", "label").agg(F.sum("n").alias("n"))
    return counts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others"))


def rarest(texts: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """``key``, ``n`` and ``keys``: of each text the shingles that stand first by the number of texts that have them, as many as similar texts cannot all miss.

    Those of one text alone stand before all others and connect nothing; a text with enough of them is left out.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 22, "seq"):
                seqs = [np.frombuffer(x, "<i4") for x in part.column("seq").to_pylist()]
                of = np.repeat(np.arange(len(seqs), dtype=np.int32), [len(x) for x in seqs])
                yield pa.RecordBatch.from_arrays([*part.select(["key", "n"]).take(pa.array(of)).columns, pa.array(np.concatenate(seqs))], ["key", "n", "shingle"])

    pieces = texts.select("key", "n").join(sequences, "key").select("key", "n", "seq").mapInArrow(exploded, "key binary, n int, shingle int")
    often = pieces.groupBy("shingle").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    held = pieces.join(often, "shingle").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("held"))
    wanted = (first - (F.col("n") - F.size("held"))).cast("int")
    return held.where(wanted > 0).select("key", "n", F.array_distinct(F.transform(F.slice("held", F.lit(1), wanted), lambda x: x["shingle"].cast("long"))).alias("keys"))


def split(open_groups: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``open_groups``, with those of wide groups in the parts that their rarest shingles connect; parts of one class are left out."""
    wide = group_sizes(open_groups).where(F.col("others") > WIDE * BLOCK).select("group")
    texts = cut_lineage(open_groups.join(wide, "group", "left_semi").select("key", "n", "label").distinct())
    if texts.isEmpty():
        return open_groups
    shared = candidate_groups(cut_lineage(rarest(texts, sequences, similarity)))
    parts = components(shared.select(F.col("key").alias("a"), F.encode(F.col("group").cast("string"), "UTF-8").alias("b")))  # 16 bytes for a text, fewer for a shingle
    finer = texts.select("key", "n").join(parts.select("key", F.xxhash64("label").alias("group")), "key")
    fields = ["group", "key", "n", "label"]
    return open_groups.join(wide, "group", "left_anti").select(fields).unionByName(unsettled(finer, texts.select("key", "label")).select(fields))


def block_links(open_groups: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a``, ``b`` of classes with similar texts: those outside the largest class of a group against all of it, block by block."""
    rows = open_groups.join(group_sizes(open_groups), "group").join(sequences, "key")
    n_all, n_others = F.ceil(F.col("all") / BLOCK), F.ceil(F.col("others") / BLOCK)
    of = lambda seed, n: F.pmod(F.xxhash64("key", F.lit(seed)), n).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    place = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    held = F.transform(numbers(n_others), lambda j: place(of(1, n_all), j, 0))
    asking = F.when(F.col("label") != F.col("main"), F.transform(numbers(n_all), lambda i: place(i, of(2, n_others), 1))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))
    blocks = rows.select("group", "label", "seq", F.inline(F.concat(held, asking)))

    def search(block: list[dict]) -> list[tuple[bytes, bytes]]:
        held = [r for r in block if not r["role"]]
        found, parent = [], {}

        def root(x: bytes) -> bytes:
            while x in parent:
                x = parent[x]
            return x

        texts = [np.frombuffer(r["seq"], "<u4") for r in held]
        sizes = np.array([len(t) for t in texts])
        if not len(texts):
            return []
        flat, owner = np.concatenate(texts), np.repeat(np.arange(len(held)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for r in block:
            if not r["role"]:
                continue
            x = np.frombuffer(r["seq"], "<u4")
            first, last = np.searchsorted(flat, x), np.searchsorted(flat, x, side="right")
            at = np.repeat(first - np.r_[0, np.cumsum(last - first)[:-1]], last - first) + np.arange((last - first).sum())
            shared = np.bincount(owner[at], minlength=len(held))
            need = np.ceil((len(x) + sizes) * similarity / (1 + similarity) - 1e-9)
            for k in np.flatnonzero(shared >= need).tolist():
                mine, other = root(r["label"]), root(held[k]["label"])
                if mine != other and aligned(x, texts[k], similarity) >= similarity:
                    parent[max(mine, other)] = min(mine, other)
                    found.append((min(mine, other), max(mine, other)))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        name = None
        for batch in itertools.chain(batches, [None]):
            for row in batch.to_pylist() if batch is not None else [None]:
                at = row and (row["group"], row["i"], row["j"])
                if at != name:
                    if found := search(block) if block else []:
                        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])
                    block, name = [], at
                block.append(row)

    return blocks.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "role").mapInArrow(run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """``key`` and ``label``, the least key that it is connected with, for every key in a link; labels spread along links and are then followed."""
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("m"))
        spread = labels.join(near, "key").select("key", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        after = labels.select(F.col("key").alias("to"), F.col("label").alias("further"))
        new = cut_lineage(spread.join(after, "to", "left").select("key", F.least("to", F.coalesce("further", "to")).alias("label"), "was"))
        labels = new.select("key", "label")
        if new.where(F.col("label") != F.col("was")).isEmpty():
            return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each distinct text with a word: ``key`` (its MD5), ``class_id`` and ``keep_key``, the text that stands for the class."""
    rows = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    sketched = cut_lineage(_mapped(rows, "n int, keys array<long>, seq binary", lambda s: (len(s), order_minhash(s), s.astype("<u4").tobytes())))
    nodes = cut_lineage(sketched.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    grouped = cut_lineage(candidate_groups(nodes))

    wanted = nodes.select("key", F.coalesce("doc_id", F.lit(-1)).alias("id")).join(grouped.select("key").distinct(), "key", "left_semi")
    given = sketched.select("key", F.coalesce("doc_id", F.lit(-1)).alias("id"), "seq")
    sequences = cut_lineage(given.join(wanted, ["key", "id"], "left_semi").dropDuplicates(["key"]).select("key", "seq"))

    labels = roots(cut_lineage(verified(centres(grouped), sequences, similarity)))
    open_groups = cut_lineage(unsettled(grouped, labels))
    if not open_groups.isEmpty():
        merged = components(block_links(split(open_groups, sequences, similarity), sequences, similarity)).select(F.col("key").alias("was"), F.col("label").alias("now"))
        known = grouped.select("key").distinct().join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("was"))
        labels = known.join(merged, "was", "left").select("key", F.coalesce("now", "was").alias("label"))

    known = nodes.select("key", "doc_id").join(labels, "key", "left").select("key", "doc_id", F.coalesce("label", "key").alias("label"))
    best = known.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("keep_key"))
    return known.join(best, "label").select("key", "class_id", "keep_key")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id`` and ``keep`` of every row; ``keep`` is false for all but one document of each class."""
    found = classes(docs, similarity)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    keep = F.col("keep_key").isNull() | ((F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    return rows.join(found, "key", "left").select("doc_id", F.when(F.col("keep_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), keep.alias("keep"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class."""
    found = classes(docs, similarity)
    key, ident = text_key(F.col("text")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    keep = (F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = rows.join(found, "key").where(~keep).select("key", F.coalesce("doc_id", F.lit(-1)).alias("ident")).distinct()
    return whole_rows(docs, key=key, ident=ident).join(gone, ["key", "ident"], "left_anti").select("row.*")
