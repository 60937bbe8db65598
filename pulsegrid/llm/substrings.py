"""Substring deduplication on a De Bruijn graph of words.

A run of 13 words is an edge between the two runs of 12 words in it. A slice of the input sends each of its distinct edges once, with the
number of its occurrences there, to the bucket of the edge's hash, where the slices meet: an edge that occurs again points to its source, the
occurrence in the smallest ``doc_id``. Back with its slice an edge stands for all its occurrences there again, and edges are
joined to their neighbours: as long as text and source both go on by one word and the number of occurrences stays, no
path enters or leaves the graph in between, and the edges are compacted into one span. Each span keeps the coordinates of its source, and
is verified by a 128-bit digest of its words in both places before its words count as removed. The edges of a span that is refuted (two runs of words with one hash)
are resolved anew, each by the digest of its words in place of its hash, so that what repeats elsewhere is still found.

Edges travel packed, one row for a slice and a bucket. An edge that a third of all documents hold is one entry for each slice. Slices and buckets grow with the root of
the input, so a packed row holds the same number of edges at any size and the shuffle stays in proportion.

Results: a null or blank text has no words and nothing is removed; a text of fewer than 13 words is kept; a very long text is one slice and is taken whole; documents with equal ids do
not count as earlier than each other, nor do documents with null ids, which come after all others; words are compared as they are; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, doc_text, slices
from pulsegrid.llm.hashing import WordHashes, runs

WINDOW = 13
#: Least bytes of text for a bucket and for a slice; their product is PER_ROW times the input, some 50 edges for a packed row.
BUCKET_BYTES, SLICE_BYTES, PER_ROW = 12 << 20, 4 << 20, 300
#: Bits of a hash that tell edges apart, and refuted edges that are resolved at a time (8 bytes each, sent to all tasks).
HASH_BITS, AT_A_TIME = 64, 1 << 20
LAST = np.iinfo(np.int64).max
PACKED = "bucket int, slice long, body binary, places binary, ids binary"
SPANS = "array<struct<start:int,end:int,source_id:bigint,source_start:int>>"


def _pack(*columns: np.ndarray) -> bytes:
    """Differences along each column, compressed."""
    return zlib.compress(b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in columns), 1)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw, out, at = zlib.decompress(data), [], 0
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    for t in types:
        part = np.frombuffer(raw, t, n, at)
        out.append(np.cumsum(part, dtype=t))
        at += part.nbytes
    return out


def edge_hashes(words: WordHashes, text: bytes, window: int, bits: int) -> np.ndarray:
    """Hash of every edge of a text, cut to its first ``bits``."""
    own = runs(words(text.split()), window)
    return own if bits >= 64 else own & ~np.uint64((1 << (64 - bits)) - 1)


def _copies(flat: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that stand for the distinct edges of a slice (the one of least id, then place), in order, how often each occurs, and the others' places with those they stand under."""
    order = np.argsort(flat, kind="stable")
    new = np.r_[True, flat[order][1:] != flat[order][:-1]] if len(flat) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    sizes = np.bincount(group) if len(flat) else np.zeros(0, np.int64)
    again = np.flatnonzero(sizes[group] > 1)  # only copies need a look at the ids
    places, of = order[again], group[again]
    by = np.lexsort((places, ids[np.searchsorted(starts, places, side="right") - 1], of))
    places, of = places[by], of[by]
    lead = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
    leader = places[np.maximum.accumulate(np.where(lead, np.arange(len(of)), 0))] if len(of) else places
    kept = np.concatenate([order[new & (sizes[group] == 1)], places[lead]]) if len(flat) else order
    count = np.concatenate([np.ones(len(kept) - lead.sum(), np.uint32), sizes[of[lead]].astype(np.uint32)]) if len(flat) else order
    by = np.argsort(kept)
    return kept[by], count[by].astype(np.uint32), np.stack([places[~lead], leader[~lead]]) if len(of) else np.zeros((2, 0), np.int64)


def edges(docs: DataFrame, n_buckets: int, per_slice: int, window: int = WINDOW, bits: int = HASH_BITS) -> DataFrame:
    """Packed distinct edges of the slices by bucket (below ``n_buckets``), and for each slice a directory in bucket -1.

    ``docs`` has ``doc_id``, ``text`` and a hash ``h`` of the text.
    """

    def packed(number: int, ids: list, marks: list, hashes: list) -> pa.RecordBatch:
        starts = np.cumsum([0, *map(len, hashes)])[:-1].astype(np.uint32)
        ids, marks = np.array(ids, np.int64), np.array(marks, np.int64)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        kept, count, copies = _copies(flat, starts, ids)
        bucket = ((flat[kept] >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        rows = [(-1, number, marks.tobytes(), _pack(*copies.astype(np.uint32)), _pack(starts, ids))]
        for b in range(n_buckets):
            some = order[cuts[b] : cuts[b + 1]]
            if len(some):
                at = kept[some]
                there = np.unique(np.searchsorted(starts, at, side="right") - 1)  # documents with an edge in this row
                rows.append((b, number, flat[at].view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), _pack(at.astype(np.uint32), count[some]), _pack(starts[there], ids[there])))
        names = ["bucket", "slice", "body", "places", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = WordHashes(), TaskContext.get().partitionId() << 32
        ids, marks, hashes, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                for i, text, h in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "h")), strict=True):
                    raw = text.encode()
                    own = edge_hashes(words, raw, window, bits)
                    if len(own):
                        ids.append(LAST if i is None else i)
                        marks.append(h)
                        hashes.append(own)
                        held += len(raw)
                    if held >= per_slice:
                        yield packed(number, ids, marks, hashes)
                        number += 1
                        ids, marks, hashes, held = [], [], [], 0
        if hashes:
            yield packed(number, ids, marks, hashes)

    return docs.select("doc_id", "text", "h").mapInArrow(run, PACKED)


def _repeated(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """Of one bucket: for each slice the edges that have a source in an earlier document, or copies in the slice, with their source."""
    edge, place, count, doc, pos, slice_of = [], [], [], [], [], []
    for k, r in enumerate(rows):
        raw = np.frombuffer(r["body"], np.uint8).reshape(-1, 7)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, :7] = raw
        at, n = _unpack(r["places"], "<u4", "<u4")
        starts, ids = _unpack(r["ids"], "<u4", "<i8")
        which = np.searchsorted(starts, at, side="right") - 1
        edge.append(full.view("<u8")[:, 0])
        place.append(at)
        count.append(n)
        doc.append(ids[which])
        pos.append((at - starts[which]).astype(np.int32))
        slice_of.append(np.full(len(at), k, np.int32))
    edge, count = np.concatenate(edge), np.concatenate(count)
    order = np.argsort(edge)
    same = edge[order][1:] == edge[order][:-1]
    again = order[np.r_[False, same] | np.r_[same, False] | (count[order] > 1)]
    if not len(again):
        return
    edge, count, (place, doc, pos, slice_of) = edge[again], count[again], (np.concatenate(c)[again] for c in (place, doc, pos, slice_of))
    order = np.lexsort((pos, doc, edge))
    edge, count, place, doc, pos, slice_of = edge[order], count[order], place[order], doc[order], pos[order], slice_of[order]
    first = np.r_[True, edge[1:] != edge[:-1]]
    group = np.cumsum(first) - 1
    source = np.flatnonzero(first)
    total = np.add.reduceat(count.astype(np.int64), source)
    later = np.flatnonzero((doc > doc[source][group]) | (count > 1))
    by_slice = later[np.lexsort((place[later], slice_of[later]))]
    cuts = np.searchsorted(slice_of[by_slice], np.arange(len(rows) + 1))
    for k, r in enumerate(rows):
        at = by_slice[cuts[k] : cuts[k + 1]]
        if len(at):
            s = source[group[at]]
            yield r["slice"], _pack(place[at], pos[s].astype("<i4"), doc[s].astype("<i8"), total[group[at]].astype("<u4"))


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of a sorted partition, one key at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def sources(packed: DataFrame, n_buckets: int) -> DataFrame:
    """The occurrences that repeat an earlier document, sent back to their slices; directories pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bucket"):
            if rows[0]["bucket"] < 0:
                out = [(r["slice"], 0, r["body"], r["ids"], r["places"]) for r in rows]
            else:
                out = [(number, 1, body, b"", b"") for number, body in _repeated(rows)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["slice", "kind", "body", "ids", "copies"])

    spread = F.when(F.col("bucket") < 0, F.col("slice") % n_buckets).otherwise(F.col("bucket"))
    return packed.repartition(n_buckets, spread).sortWithinPartitions("bucket").mapInArrow(run, "slice long, kind int, body binary, ids binary, copies binary")


def compacted(back: DataFrame, n_slices: int, window: int = WINDOW) -> DataFrame:
    """Spans of the documents: edges joined with their neighbours along nonbranching paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "slice"):
            if len(rows) < 2:
                continue
            starts, ids = _unpack(rows[0]["ids"], "<u4", "<i8")
            marks = np.frombuffer(rows[0]["body"], np.int64)
            place, pos, source, count = (np.concatenate(c) for c in zip(*(_unpack(r["body"], "<u4", "<i4", "<i8", "<u4") for r in rows[1:]), strict=True))
            order = np.argsort(place)
            place, pos, source, count = place[order], pos[order], source[order], count[order]
            copy, under = _unpack(rows[0]["copies"], "<u4", "<u4")  # an edge stands for its copies in the slice
            of = np.searchsorted(place, under)
            place, pos, source, count = np.concatenate([place, copy]), np.concatenate([pos, pos[of]]), np.concatenate([source, source[of]]), np.concatenate([count, count[of]])
            which = np.searchsorted(starts, place, side="right") - 1
            order = np.argsort(place)
            order = order[ids[which[order]] > source[order]]
            if not len(order):
                continue
            place, pos, source, count, which = place[order], pos[order], source[order], count[order], which[order]
            shift = pos - (place - starts[which]).astype(np.int64)
            goes_on = (np.diff(place) == 1) & (np.diff(which) == 0) & (np.diff(shift) == 0) & (np.diff(source) == 0) & (np.diff(count.astype(np.int64)) == 0)
            first = np.flatnonzero(np.r_[True, ~goes_on])
            last = np.r_[first[1:], len(place)] - 1
            begin = (place[first] - starts[which[first]]).astype(np.int64)
            stop = (place[last] - starts[which[first]]).astype(np.int64) + window
            by_doc: dict[int, list] = {}
            for w, b, e, s, d in zip(which[first].tolist(), begin.tolist(), stop.tolist(), source[first].tolist(), shift[first].tolist(), strict=True):
                by_doc.setdefault(w, []).append({"start": b, "end": e, "source_id": s, "source_start": b + d})
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())]))
            at = list(by_doc)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(marks[at], pa.int64()), pa.array(list(by_doc.values()), spans)], ["id", "h", "spans"])

    return back.repartition(n_slices, "slice").sortWithinPartitions("slice", "kind").mapInArrow(run, f"id long, h long, spans {SPANS}")


def compressed(docs: DataFrame) -> DataFrame:
    """The documents with their texts as Zstandard frames, which shuffle in less space than the codec of the shuffle leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, 4 << 20):
                texts = pa.array([pack(t.encode()) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), texts], ["doc_id", "h", "text"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, text binary")


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document without its spans, with digests of the spans and of those that others take from it."""
    asked = spans.select(F.explode("spans").alias("s")).select(F.col("s.source_id").alias("id"), F.col("s.source_start").alias("start"), (F.col("s.source_start") + F.col("s.end") - F.col("s.start")).alias("end")).distinct()
    asked = asked.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("asked"))
    # texts without an id are told apart by their hash; one join, so that the texts are shuffled once
    own = spans.select(F.when(F.col("id") == int(LAST), F.col("h")).otherwise(F.col("id")).alias("id"), F.struct("h", "spans").alias("own")).groupBy("id").agg(F.collect_list("own").alias("own"))
    work = own.join(asked, "id", "full_outer")
    rows = compressed(docs).withColumn("id", F.coalesce("doc_id", "h")).join(work, "id", "left")
    mine = F.flatten(F.transform(F.filter("own", lambda o: o["h"] == F.col("h")), lambda o: o["spans"]))
    rows = rows.withColumn("spans", mine)
    digest = pa.list_(pa.struct([("id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, 1 << 20):
                out: list[tuple] = []
                for r in part.to_pylist():
                    words = unpack(r["text"]).split()
                    marked = lambda i, s, e, at: {"id": i, "start": s, "end": e, "digest": xxhash.xxh3_128_digest(b" ".join(words[at : at + e - s]))}  # noqa: B023, E731
                    own = [marked(s["source_id"], s["source_start"], s["source_start"] + s["end"] - s["start"], s["start"]) for s in r["spans"] or ()]
                    given = [marked(r["id"], a["start"], a["end"], a["start"]) for a in r["asked"] or ()]
                    gone = np.zeros(len(words), bool)
                    for s in r["spans"] or ():
                        gone[s["start"] : s["end"]] = True
                    kept = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    out.append((r["doc_id"], r["h"], len(words), int(gone.sum()), kept, own, given))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), digest, digest)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "h", "n_words", "n_removed", "kept", "own", "given"])

    listed = "array<struct<id:bigint,start:int,end:int,digest:binary>>"
    return rows.select("doc_id", "id", "h", "text", "spans", "asked").mapInArrow(run, f"doc_id long, h long, n_words long, n_removed long, kept binary, own {listed}, given {listed}")


def split_spans(spans: DataFrame, wrong: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans without the refuted ones, and the refuted ones, one row each."""
    each = spans.select("id", "h", F.explode("spans").alias("s"))
    false = wrong.select(F.col("id").alias("f_id"), F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    same = (F.col("s.source_id") == F.col("f_id")) & (F.col("s.source_start") == F.col("f_start")) & (F.col("s.source_start") + F.col("s.end") - F.col("s.start") == F.col("f_end"))
    return each.join(false, same, "left_anti"), each.join(false, same, "left_semi")


def hashes_of(docs: DataFrame, each: DataFrame, window: int, bits: int) -> DataFrame:
    """The distinct hashes of the edges in the given spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for r in batch.to_pylist():
                own = edge_hashes(words, r["text"].encode(), window, bits)
                some = np.unique(np.concatenate([own[s["start"] : s["end"] - window + 1] for s in r["spans"]]))
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], ["edge"])

    texts = docs.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("id"), "h", "text").dropDuplicates(["id", "h"])
    return texts.join(each.groupBy("id", "h").agg(F.collect_list("s").alias("spans")), ["id", "h"]).select("text", "spans").mapInArrow(run, "edge long").distinct()


def resolved(docs: DataFrame, refuted: DataFrame, window: int, bits: int) -> DataFrame:
    """Spans of one edge each for the refuted hashes, by the digests of their words: Spark joins of occurrences with the first one of each run of words."""
    spark, found = docs.sparkSession, None
    chunks = refuted.select("edge", F.pmod("edge", F.lit(max(1, -(-refuted.count() // AT_A_TIME)))).alias("chunk"))
    for (chunk,) in chunks.select("chunk").distinct().collect():  # hardly ever more than one
        shared = spark.sparkContext.broadcast(np.sort(np.array([r["edge"] for r in chunks.where(F.col("chunk") == chunk).select("edge").collect()], np.int64)))  # about AT_A_TIME numbers

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = WordHashes()
            for batch in batches:
                for r in batch.to_pylist():
                    raw = r["text"].encode()
                    own = edge_hashes(words, raw, window, bits).view(np.int64)
                    at = np.flatnonzero(np.isin(own, shared.value))
                    if len(at):
                        parts = raw.split()
                        keys = [xxhash.xxh3_128_digest(b" ".join(parts[k : k + window])) for k in at.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([r["id"]] * len(at), pa.int64()), pa.array([r["h"]] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(keys, pa.binary())], ["id", "h", "at", "run"])

        rows = cut_lineage(docs.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("id"), "h", "text").mapInArrow(run, "id long, h long, at int, run binary"))
        first = rows.groupBy("run").agg(F.min(F.struct("id", "at")).alias("first"))
        later = rows.join(first, "run").where(F.col("id") > F.col("first.id"))
        span = F.struct(F.col("at").alias("start"), (F.col("at") + window).alias("end"), F.col("first.id").alias("source_id"), F.col("first.at").alias("source_start"))
        some = later.select("id", "h", span.alias("s"))
        found = some if found is None else found.unionByName(some)
    return found


def deduplicate(docs: DataFrame, digest_only: bool = True, window: int = WINDOW, bits: int = HASH_BITS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the kept words: their SHA-256 as ``kept_sha256``, or as text in ``kept``."""
    spark = docs.sparkSession
    rows = doc_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    even = int((PER_ROW * size) ** 0.5)
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // max(BUCKET_BYTES, even)))
    packed = edges(rows, n_buckets, max(SLICE_BYTES, even, n_buckets * 64 << 10), window, bits)
    spans = cut_lineage(compacted(sources(packed, n_buckets), n_buckets, window))
    kept = F.sha2("kept", 256).alias("kept_sha256") if digest_only else F.decode("kept", "UTF-8").alias("kept")

    def done(some: DataFrame, of: DataFrame) -> DataFrame:
        return cut_lineage(removed(some, of).select("doc_id", "h", "n_words", "n_removed", kept, "own", "given"))

    out = done(rows, spans)
    wrong = out.select(F.inline("own")).distinct().join(out.select(F.inline("given")), ["id", "start", "end", "digest"], "left_anti").select("id", "start", "end").distinct()
    if not wrong.isEmpty():
        good, refuted = split_spans(spans, cut_lineage(wrong))
        refuted = cut_lineage(refuted)
        more = cut_lineage(resolved(rows, cut_lineage(hashes_of(rows, refuted, window, bits)), window, bits))
        touched = cut_lineage(refuted.select("id", "h").union(more.select("id", "h")).distinct())
        mark = lambda df: df.withColumn("id", F.coalesce("doc_id", F.lit(int(LAST))))
        anew = good.join(touched, ["id", "h"], "left_semi").unionByName(more).groupBy("id", "h").agg(F.collect_list("s").alias("spans"))
        again = done(mark(rows).join(touched, ["id", "h"], "left_semi").select("doc_id", "text", "h"), anew)
        out = mark(out).join(touched, ["id", "h"], "left_anti").drop("id").unionByName(again)
    return out.drop("h", "own", "given")
