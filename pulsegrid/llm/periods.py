"""Periodic runs of words: stretches that repeat four times or more, found in tiles of every scale and stitched.

A period of the octave ``[P, 2P)`` is looked for at boundaries ``P`` words apart. Where a stretch of words equals the one ``q`` words on over three periods,
some boundary in it is followed by ``P`` such words; texts are cut, for each octave, into tiles of boundaries that overlap by what their periods can reach. A
screen of hashes finds the boundaries that may have a period, exactly one pass a scale over many texts at a time, and only tiles that hold one leave their text:
they are dealt over the cluster one by one, and solved there with two Z-functions at each boundary, one for what follows it and one for what stands before, which
give for every period of the octave how far it holds on both sides, up to the next boundary. These intervals are shuffled by document and period and stitched.

Results: a null or empty text, or one without a run, has none and null measures; a null ``doc_id`` is kept;
equal rows get equal rows of their own; ties between runs go to the smaller start, then period; a very long text is one row to read, its tiles are solved apart;
an empty table has no rows; extra columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, slices
from pulsegrid.llm.hashing import mix

#: A run has so many periods and words at least.
PERIODS, WORDS = 4, 6
#: Boundaries of a tile lie within so many words (or it has one), so that tiles of small periods are not too small.
TILE = 1 << 10
#: Bytes of text whose words are screened together.
TOGETHER = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def screen(ids: np.ndarray, text_of: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(P, boundaries)`` for each octave: places followed by ``P`` words that also stand at a distance from ``P`` to ``2P - 1``, in the same text.

    ``ids`` numbers the words of several texts one after another. Words equal those a period on over ``PERIODS - 1`` periods, so one boundary less than that in a row
    has such words at the same distance. No boundary of a run is lost, as equal words have equal hashes; some may be idle.
    """
    h, size = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while PERIODS * size <= longest:
        n = len(h)
        starts = np.arange(0, n, size)
        rows = np.zeros((len(starts) + 1) * size, np.uint64)
        rows[:n] = h
        blocks = rows.reshape(-1, size)
        same = blocks[1:] == blocks[:-1, :1]
        n_same = WORDS - 1 if size == 1 else PERIODS - 2  # the shortest run of the octave is followed like this at so many boundaries in a row
        rows_of = len(same) - n_same + 1
        begins = np.flatnonzero(np.logical_and.reduce([same[i : rows_of + i] for i in range(n_same)]).any(axis=1)) if rows_of > 0 else starts[:0]
        found = starts[np.unique((begins[:, None] + np.arange(n_same)).ravel())]
        yield size, found[(found + size < len(text_of)) & (text_of[found] == text_of[np.minimum(found + size, len(text_of) - 1)])]
        if n <= size:
            return
        h, size = mix(h[:-size] * _ODD + h[size:]), 2 * size


def z_function(s: list) -> list[int]:
    """For each place the number of items from it on that equal those at the start."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def intervals(tile: list[int], boundaries: list[int], size: int) -> Iterator[tuple[int, int, int]]:
    """``(period, first, end)``: for periods of the octave around each boundary, the places that equal those a period on, as far as the next boundaries.

    What repeats a part of its period is left out, as that part is found as a period of its own.
    """
    for b in boundaries:
        ahead, before = tile[b : b + 4 * size], tile[max(0, b - size) : b][::-1]
        z = z_function(ahead)
        back = None
        for q in range(size, min(2 * size, len(z))):
            if z[q] < size or any(q % d == 0 and z[d] >= q - d for d in _divisors(q)):
                continue
            if back is None:
                shifted = tile[max(0, b - size) : b + 2 * size][::-1]
                back = z_function([*before, -1, *shifted])  # both read backwards: the words before the boundary start at the first place
            yield q, b - back[len(shifted) + 1 - q], b + min(z[q], 2 * size)


_KNOWN: dict[int, list[int]] = {}


def _divisors(q: int) -> list[int]:
    """``q`` divided by each of its prime factors: the largest parts that it can repeat."""
    if q not in _KNOWN:
        rest, out, p = q, [], 2
        while p * p <= rest:
            if rest % p == 0:
                out.append(q // p)
                while rest % p == 0:
                    rest //= p
            p += 1
        if len(_KNOWN) > 1 << 16:
            _KNOWN.clear()
        _KNOWN[q] = out + [q // rest] * (rest > 1)
    return _KNOWN[q]


_TILE_FIELDS = "key long, doc_id long, n_words long, words binary, collapsed_sha256 string, size int, first long, ids binary, boundaries binary"
_TILE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _tiles_of(ids: np.ndarray, start: int, end: int, size: int, found: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """The tiles of one octave of one text: first place in the text, words numbered anew, boundaries."""
    of = found // max(TILE, size)
    for k in np.unique(of):
        at = found[of == k]
        first = max(start, int(at[0]) - size)
        last = min(end, int(at[-1]) + 4 * size)
        numbers = np.unique(ids[first:last], return_inverse=True)[1]
        yield first - start, _packed(numbers), _packed(at - first)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, said by the first byte."""
    size = next(k for k in (1, 2, 4, 8) if not len(values) or values.max() >> 8 * k == 0)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).tolist()


def screened(rows: DataFrame, change: Callable[[list, int | None], list] | None = None) -> DataFrame:
    """From ``key, doc_id, text`` one row for each document, finished if the screen finds nothing in it, and one row for each tile of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TOGETHER):
                yield from solve(part)

    def solve(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, doc_ids = part.column("key").to_pylist(), part.column("doc_id").to_pylist()
        texts = [(t or "").encode().split() for t in part.column("text").to_pylist()]
        texts = [change(t, i) for t, i in zip(texts, doc_ids, strict=True)] if change else texts
        sizes = [len(t) for t in texts]
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
        ends = np.cumsum(sizes)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        tiles, waiting, hit = [], 0, set()
        for size, found in screen(ids, text_of, max(sizes, default=0)):
            which = text_of[found]
            for at in np.split(found, np.flatnonzero(np.diff(which)) + 1) if len(found) else ():
                k = int(text_of[at[0]])
                if sizes[k] < PERIODS * size:
                    continue
                hit.add(k)
                for tile in _tiles_of(ids, int(ends[k]) - sizes[k], int(ends[k]), size, at):
                    tiles.append((keys[k], None, None, None, None, size, *tile))
                    waiting += len(tile[1])
                    if waiting > TOGETHER:
                        yield packed(tiles)
                        tiles, waiting = [], 0
        for k, words in enumerate(texts):
            text = b" ".join(words)
            tiles.append((keys[k], doc_ids[k], sizes[k], text if k in hit else None, None if k in hit else sha256(text).hexdigest(), None, None, None, None))
        yield packed(tiles)

    names = [f.split()[0] for f in _TILE_FIELDS.split(", ")]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TILE_TYPES, strict=True)], names)

    return rows.mapInArrow(run, _TILE_FIELDS)


def solved(tiles: DataFrame) -> DataFrame:
    """``key, period, first, end`` of intervals, each tile by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tile, at = _unpacked(r["ids"]), _unpacked(r["boundaries"])
                found = list(intervals(tile, at, r["size"]))
                if found:
                    columns = ([r["key"]] * len(found), [q for q, _, _ in found], [a + r["first"] for _, a, _ in found], [b + r["first"] for _, _, b in found])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "period", "first", "end"])

    return tiles.mapInArrow(run, "key long, period long, first long, end long")


def stitched(fragments: DataFrame) -> DataFrame:
    """``key, start, length, period`` of the runs: intervals that meet are one. Periods that repeat a part were left out, so each is a stretch's smallest."""
    by = Window.partitionBy("key", "period").orderBy("first", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int"))
    whole = parts.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "period", "island").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    runs = whole.select("key", "start", (F.col("end") + F.col("period") - F.col("start")).alias("length"), "period")
    return runs.where((F.col("length") >= PERIODS * F.col("period")) & (F.col("length") >= WORDS))


_RESULT = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def measured(texts: DataFrame) -> DataFrame:
    """Documents with their ``runs``: the strongest run, and digests of all runs and of the words without the repeats."""
    names = ["doc_id", *(n for n, _ in _RESULT)]
    types = [pa.int64(), *({"long": pa.int64(), "string": pa.string()}[t] for _, t in _RESULT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TOGETHER, "words"):
                out = [(r["doc_id"], *row(r["words"], [(x["start"], x["length"], x["period"]) for x in r["runs"] or ()])) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def row(text: bytes, runs: list[tuple[int, int, int]]) -> tuple:
        words = text.split()
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        best = strongest(runs)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
        left = text if kept.all() else b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)
        return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(left).hexdigest())

    return texts.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [("doc_id", "long"), *_RESULT]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length in periods, compared exactly; of equal ones the first, then the one of smaller period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def repeats(docs: DataFrame, change: Callable[[list, int | None], list] | None = None) -> DataFrame:
    """One row for each document: number of runs, its strongest one, and digests of its runs and of what is left without repeats.

    ``change`` gives a text other words, from its words and ``doc_id``, before anything else.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = cut_lineage(screened(rows, change))
    fragments = solved(parts.where(F.col("size").isNotNull()).select("key", "size", "first", "ids", "boundaries").repartition("key", "size", "first"))
    runs = stitched(fragments).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    heads = parts.where(F.col("size").isNull())
    held = heads.where(F.col("words").isNotNull()).select("key", "doc_id", "words").join(runs, "key", "left").select("doc_id", "words", "runs")
    none = {"n_runs": F.lit(0), "runs_sha256": F.sha2(F.lit(""), 256), "collapsed_sha256": F.col("collapsed_sha256")}
    plain = heads.where(F.col("words").isNull()).select("doc_id", *(none.get(n, F.lit(None)).cast(t).alias(n) for n, t in _RESULT))
    return plain.unionByName(measured(held))
