"""Operators that hold documents against each other or a benchmark, against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontam, fingerprint, neardup, substrings
from pulsegrid.llm.hashing import WordHashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


# Substrings


def removed(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    late = float("inf")
    for i, w in words:
        for k in range(len(w) - 12):
            run = b" ".join(w[k : k + 13])
            first[run] = min(first.get(run, late), late if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if first[b" ".join(w[k : k + 13])] < (late if i is None else i):
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_are_those_of_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (13, 20, 60, 200)]
    texts = [" ".join(prose(rng, rng.randrange(30)) + rng.choice(shared) + prose(rng, rng.randrange(30)) + rng.choice(shared)[3:-2]) for _ in range(60)]
    texts += [texts[3], texts[3], None, "", "  \t\n ", " ".join(["same"] * 40), " ".join(["same"] * 60), " ".join(prose(rng, 12)), "é ü " * 30, "x " * 30000 + " ".join(shared[2])]
    rows = list(zip([*range(len(texts) - 2), None, 7], texts, strict=True)) + [(2, texts[2]), (None, texts[4]), (3, texts[5])]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns({"h": F.lit("clash"), "spans": F.lit(1)})
    got = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicate(docs.repartition(5)).collect())
    assert got == removed(rows)


def test_substrings_of_an_empty_table(spark):
    assert substrings.deduplicate(frame(spark, ["x"]).where("false")).count() == 0


@pytest.mark.parametrize("bits", [0, 5, 12])
def test_clashes_of_hashes_are_resolved_edge_by_edge(spark, bits):
    """With so few bits nearly all edges clash in every task; the result is that of the words all the same."""
    rng = random.Random(bits)
    shared = [prose(rng, 40) for _ in range(3)]
    texts = [" ".join([*prose(rng, rng.randrange(30)), *rng.choice(shared), *prose(rng, rng.randrange(30))]) for _ in range(25)]
    texts += [texts[3], texts[3], None, "", "short text"]
    ids = [*range(len(texts) - 3), None, None, None]
    docs = frame(spark, texts, ids)
    got = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicate(docs.repartition(3), bits=bits).collect())
    assert got == removed(list(zip(ids, texts, strict=True)))


# Near duplicates


def plain_classes(rows):
    words = WordHashes()
    seqs = [(i, neardup.labelled(h).astype("<u4")) if t and len(h := neardup.shingle_hashes(t, words)) else (i, None) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if seqs[a][1] is not None and seqs[b][1] is not None and (rows[a][1] == rows[b][1] or neardup.aligned(seqs[a][1], seqs[b][1]) >= 0.8):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: least[root(k)] for k, (i, _) in enumerate(rows)}


def variant(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out) or 1)
        out[k : k + 1] = rng.choice([[], [*out[k : k + 1], f"n{rng.randrange(9999)}"], [f"n{rng.randrange(9999)}"]])
    return out


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = random.Random(9)
    base, other = prose(rng, 150), prose(rng, 200)
    texts = [" ".join(variant(rng, base, rng.randrange(8))) for _ in range(60)]  # a large group on both sides of the threshold
    texts += [" ".join(variant(rng, other, 2)).title() + "!" for _ in range(4)]
    texts += [" ".join(prose(rng, rng.randrange(1, 120))) for _ in range(60)] + ["one two", "One, two.", "one two three", None, "", " ?! "]
    texts += [texts[0]] * 5
    rows = list(enumerate(texts))
    out = neardup.near_duplicates(frame(spark, texts).withColumn("key", F.lit("clash")))
    got = {r["doc_id"]: (r["class_id"], r["keep"]) for r in out.collect()}
    want = plain_classes(rows)
    assert {i: c for i, (c, _) in got.items()} == want
    assert {i for i, (_, keep) in got.items() if keep} == set(want.values())
    assert sorted(r["doc_id"] for r in neardup.deduplicate(frame(spark, texts)).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("wide", [8, 0])
def test_blocks_find_what_stars_and_chains_leave(spark, monkeypatch, wide):
    monkeypatch.setattr(neardup, "FAN", 3)
    monkeypatch.setattr(neardup, "BLOCK", 400)
    monkeypatch.setattr(neardup, "WIDE", wide)
    rng = random.Random(4)
    base = prose(rng, 120)
    texts = [" ".join(variant(rng, base, rng.randrange(2, 9))) for _ in range(70)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == plain_classes(list(enumerate(texts)))


def of_one_passage(rng, n):
    """Unlike texts that share a passage of 80 words, with a similar one for every fifth."""
    passage = prose(rng, 80)
    texts = []
    for _ in range(n):
        own = [f"u{rng.randrange(10**9)}" for _ in range(60)]
        texts.append(" ".join([*own, *passage]))
        if rng.random() < 0.2:
            texts.append(" ".join([*variant(rng, own, 1), *passage]))
    return texts


def test_wide_groups_of_unlike_texts_are_split(spark, monkeypatch):
    """A key that all texts share: only texts with rare shingles in common are held against each other, and no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    monkeypatch.setattr(neardup, "WIDE", 0)
    monkeypatch.setattr(neardup, "order_minhash", lambda marked: [7])  # one group of all
    held = []
    plain = neardup.block_links
    monkeypatch.setattr(neardup, "block_links", lambda groups, *rest: held.append(groups.count()) or plain(groups, *rest))
    texts = of_one_passage(random.Random(6), 120)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    want = plain_classes(list(enumerate(texts)))
    assert got == want
    similar = sum(n for n in Counter(want.values()).values() if n > 1)
    assert 20 < similar < len(texts) / 2 and held[0] <= similar  # pairs that the first comparison settled do not come back


def test_prefixes_of_rare_shingles_meet(spark):
    """Every similar pair shares one of its first shingles, at several thresholds, repeated shingles and short texts included."""
    rng = random.Random(8)
    base = prose(rng, 60)
    texts = [" ".join(variant(rng, base[: rng.randrange(6, 60)], rng.randrange(4))) for _ in range(60)] + ["a b c d e f g", "a b c d e f g h", "x " * 30, "x " * 34]
    words = WordHashes()
    seqs = {str(i).encode(): neardup.labelled(neardup.shingle_hashes(t, words)).astype("<u4") for i, t in enumerate(texts)}
    sequences = spark.createDataFrame([(bytearray(k), bytearray(s.tobytes())) for k, s in seqs.items()], "key binary, seq binary")
    nodes = spark.createDataFrame([(bytearray(k), len(s)) for k, s in seqs.items()], "key binary, n int")
    for similarity in (0.6, 0.8, 0.9):
        first = {bytes(r["key"]): set(r["keys"]) for r in neardup.rarest(nodes, sequences, similarity).collect()}
        pairs = [(a, b) for a in seqs for b in seqs if a < b and neardup.aligned(seqs[a], seqs[b], similarity) >= similarity]
        assert len(pairs) > 3 and all(first.get(a, set()) & first.get(b, set()) for a, b in pairs)


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven"
    out = neardup.near_duplicates(frame(spark, [text, text, text, "another text of its own"], [4, 4, None, None])).collect()
    assert sorted((r["doc_id"] is None, r["class_id"] is None, r["keep"]) for r in out) == [(False, False, True), (False, False, True), (True, False, False), (True, True, True)]
    assert neardup.near_duplicates(frame(spark, ["x"]).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_alignment_is_the_longest_common_subsequence(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a = rng.sample(range(1000), rng.randint(1, 60))
        b = variant(rng, a, rng.randint(0, 6))
        b = list(dict.fromkeys(x if isinstance(x, int) else int(x[1:]) + 1000 for x in b)) or [1]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        want = row[-1] / (len(a) + len(b) - row[-1])
        assert neardup.aligned(np.array(a, np.uint32), np.array(b, np.uint32)) == pytest.approx(want if want >= 0.8 else 0)


# Decontamination


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def best_similarity(doc, item):
    d, i = shingles(doc), shingles(item)
    best = 0.0
    for k in range(max(1, len(d) - len(i) + 1)):
        shared = sum((Counter(d[k : k + len(i)]) & Counter(i)).values())
        best = max(best, shared / (len(d[k : k + len(i)]) + len(i) - shared) if d and i else 0)
    return best


def test_leaks_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = [" ".join(prose(rng, n)) for n in (3, 5, 12, 16, 30, 45, 60)] + [None, "", "?!"]
    passages = [items[k] for k in (2, 3, 4, 5, 6)]
    texts = []
    for k in range(40):
        p = rng.choice(passages).split()
        p = variant(rng, p, rng.choice([0, 0, 1, 3, 8]))
        texts.append(" ".join(prose(rng, rng.randrange(80)) + p + prose(rng, rng.randrange(80))))
    texts += [items[6].upper().replace(" ", " ## "), items[0], items[1] + ".", None, "", texts[0], " ".join([items[3]] * 50), "x " * 30000]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = decontam.contaminated(frame(spark, texts).withColumns({"text_key": F.lit("clash"), "n": F.lit(1)}), bench).collect()
    want = {(i, j) for i, t in enumerate(texts) for j, b in enumerate(items) if best_similarity(t, b) >= 0.8}
    assert {(r["doc_id"], r["item_id"]) for r in out} == want
    assert all(abs(r["similarity"] - best_similarity(texts[r["doc_id"]], items[r["item_id"]])) < 1e-9 for r in out if r["similarity"] == 1.0)
    kept = {r["doc_id"] for r in decontam.decontaminate(frame(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}
    for name, value in (("BROADCAST_ITEMS", 0), ("BROADCAST_PROBES", 0), ("SEGMENT", 16), ("LEAST_BITS", 128), ("MOST_BITS", 128)):  # the way of a benchmark that outgrows table and broadcast, and of texts in many parts
        monkeypatch.setattr(decontam, name, value)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(spark, texts), bench).collect()} == want


def test_recall_of_near_duplicate_keys_by_text_size():
    """Pairs of similarity 0.8 to 0.9, the hardest ones, that share a key, below 16 shingles, from 12 to 15 and above."""
    rng, words = random.Random(23), WordHashes()
    for low, high in ((5, 11), (12, 15), (16, 40), (41, 400)):
        pairs = met = 0
        while pairs < 400:
            a = prose(rng, rng.randrange(low, high + 1) + 4)
            b = variant(rng, a, max(1, int(len(a) * rng.uniform(0.005, 0.03))))
            x, y = (neardup.labelled(neardup.shingle_hashes(" ".join(t), words)) for t in (a, b))
            if 0.8 <= neardup.aligned(x, y) < 0.9:
                pairs += 1
                met += bool(set(neardup.order_minhash(x)) & set(neardup.order_minhash(y)))
        print(f"{low} to {high} shingles: {met} of {pairs}")
        assert met >= 0.99 * pairs


def test_fingerprints_within_the_radius_meet_in_a_block(spark):
    """The guarantee of the index, at the radius itself, and that far ones seldom meet."""
    rng = random.Random(17)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = []
    for far in [*range(decontam.RADIUS + 1)] * 20 + [32] * 200:
        a = rng.getrandbits(64)
        pairs.append((far, signed(a), signed(a ^ sum(1 << k for k in rng.sample(range(64), far)))))
    df = spark.createDataFrame(pairs, "far int, a long, b long")
    met = df.select("far", F.arrays_overlap(decontam.blocks(F.col("a")), decontam.probes(F.col("b"))).alias("met"), F.size(decontam.probes(F.col("b"))).alias("n")).collect()
    assert all(r["met"] for r in met if r["far"] <= decontam.RADIUS) and max(r["n"] for r in met) <= decontam.BLOCKS * decontam.PROBES


def test_window_prints_are_those_of_plain_votes(spark):
    rng = random.Random(18)
    doc = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    windows = [(n, min(n, 60 - s), s) for n in (1, 7, 30, 80) for s in range(0, 60, 5)]
    rows = spark.createDataFrame([("t", 0, n, m, s, [n]) for n, m, s in windows], "text_key string, seg int, n int, m int, start int, items array<int>")
    got = {(r["n"], r["start"]): r["print"] for r in decontam.window_prints(spark.createDataFrame([("t", 0, doc)], "text_key string, seg int, part array<long>"), rows).collect()}
    for n, m, s in windows:
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in doc[s : s + m]) > m)
        assert got[n, s] % (1 << 64) == want


def test_simhash_distances_of_similar_windows_lie_within_the_radius():
    """The radius is no guarantee for texts, so its recall is measured: 3000 pairs of similarity 0.8 to 0.9."""
    rng, far = np.random.default_rng(5), []
    while len(far) < 3000:
        n = int(rng.integers(12, 120))
        shared = int(np.ceil(n * rng.uniform(0.889, 0.95)))
        h = rng.integers(0, 2, (2 * n - shared, 64))
        prints = [2 * h[rows].sum(axis=0) > n for rows in (np.arange(n), np.r_[np.arange(shared), np.arange(n, 2 * n - shared)])]
        far.append(int((prints[0] != prints[1]).sum()))
    print(f"largest distance {max(far)}, beyond the radius {sum(x > decontam.RADIUS for x in far)} of {len(far)}")
    assert sum(x > decontam.RADIUS for x in far) <= 3


def test_items_of_one_length_meet_only_what_shares_their_shingles(spark):
    rng = random.Random(19)
    items = [" ".join(prose(rng, 40)) for _ in range(200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = decontam.contaminated(frame(spark, items), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} >= {(i, i) for i in range(200)} and len(out) < 220


def test_long_items_with_spread_insertions_and_deletions(spark):
    rng = random.Random(21)
    items = [prose(rng, 300), prose(rng, 1000)]
    texts = []
    for item in items:
        for n in range(11):
            step, out = len(item) // (n + 1), []
            for k in range(n):
                part = item[k * step : (k + 1) * step]
                out += [*part, f"n{k}"] if k % 2 else part[:-1]
            texts.append(" ".join(prose(rng, 40) + out + item[n * step :] + prose(rng, 40)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(frame(spark, texts), bench).collect()}
    best = {(i, i // 11): best_similarity(t, " ".join(items[i // 11])) for i, t in enumerate(texts)}
    want = {k: v for k, v in best.items() if v >= 0.8}
    assert len(want) >= 16 and got == pytest.approx(want)


@pytest.mark.parametrize("broadcast_items", [decontam.BROADCAST_ITEMS, 0])
def test_leaks_with_spaced_insertions_swapped_halves_and_short_texts(spark, monkeypatch, broadcast_items):
    monkeypatch.setattr(decontam, "BROADCAST_ITEMS", broadcast_items)
    rng = random.Random(12)
    spaced, swapped = {154: 3, 204: 4, 304: 6}, (45, 55, 59)
    items = [prose(rng, n) for n in (*spaced, *swapped)]
    texts = []
    for item, n in zip(items, spaced.values(), strict=False):
        step = len(item) // (n + 1)
        texts.append(sum(([*item[k * step : (k + 1) * step], f"n{k}"] for k in range(n)), []) + item[n * step :])
    texts += [item[len(item) // 2 :] + item[: len(item) // 2] for item in items[3:]]
    texts = [" ".join(prose(rng, 70) + t + prose(rng, 70)) for t in texts]
    texts += [" ".join(item[:-k]) for item in items[:4] for k in (len(item) // 6, len(item) // 4)]  # shorter than the item, on both sides of the threshold
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(frame(spark, texts), bench).collect()}
    best = {(i, j): best_similarity(t, " ".join(b)) for i, t in enumerate(texts) for j, b in enumerate(items)}
    want = {k: v for k, v in best.items() if v >= 0.8}
    assert {(k, k) for k in range(len(items))} <= set(want)
    assert got == pytest.approx(want)


def test_no_benchmark_and_no_documents(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(frame(spark, ["a b c d e f"]), bench.where("false")).count() == 0
    assert decontam.contaminated(frame(spark, ["x"]).where("false"), bench).count() == 0


# Fingerprints


def jaccard(a, b):
    x, y = (set(Counter(t.split("\n")).items()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_fingerprints_against_plain_sets(spark):
    rng = random.Random(8)
    lines = [" ".join(prose(rng, 4)) for _ in range(900)]
    texts = ["\n".join(rng.sample(lines, n)) for n in (1, 3, 9, 20, 60, 300, 8, 8)] + ["", "", None, "a\na\nb", "a\nb", "a\nb", "😀é\n" * 9, "\n".join(lines), "\n".join(f"{x}!" for x in lines * 3)]
    ids = [*range(0, 2000, 200), *range(5000, 5700, 100)]
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, texts, ids)).collect()}
    plain = [t or "" for t in texts]
    for k, i in enumerate(ids):
        text, follows = plain[k], plain[(k + 1) % len(ids)]
        q = len(text) // 4
        edited = text[: len(text) - q] + follows[:q]
        r = out[i]
        assert (r["n_chars"], r["edited"]) == (len(text), edited)
        assert r["near_edited"] == pytest.approx(jaccard(text, edited)) and r["near_next"] == pytest.approx(jaccard(text, follows))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited or jaccard(text, edited) == 1)
    assert out[ids[12]]["fingerprint"] == out[ids[13]]["fingerprint"] != out[ids[11]]["fingerprint"]


def test_fingerprint_order_of_nulls_repeats_and_one_row(spark):
    rows = fingerprint.with_next(frame(spark, ["b", "a", "n", "z"], [5, 5, None, 900])).collect()
    one, two = [r["t"] for r in frame(spark, ["a", "b"]).select(F.col("text").alias("t")).orderBy(F.xxhash64("text")).collect()]  # equal ids: by hash
    assert {(r["doc_id"], r["text"], r["next_text"]) for r in rows} == {(None, "n", one), (5, one, two), (5, two, "z"), (900, "z", "n")}
    one = fingerprint.fingerprints(frame(spark, ["only\nme"])).first()
    assert one["near_next"] == 1.0
    assert fingerprint.fingerprints(frame(spark, ["x"]).where("false")).count() == 0


def line_sets(rng):
    """Pairs of texts from equal to unrelated, with few and with many lines."""
    for n in (1, 2, 9, 40, 300, 700):
        base = [f"line {rng.randrange(10**9)}" for _ in range(n)]
        for changed in (0, 1, n // 4, n // 2, n):
            yield base, base[: n - changed] + [f"other {rng.randrange(10**9)}" for _ in range(changed)]
        yield base, base + base[:3] + ["more"] * 5
        yield base, [f"else {k}" for k in range(rng.randrange(1, 900))]


@pytest.mark.parametrize("attempts", [6, 0])
def test_written_fingerprints_subtract(spark, monkeypatch, attempts):
    """From the written sketches alone; without an attempt to peel, every digest is listed."""
    monkeypatch.setattr(fingerprint, "ATTEMPTS", attempts)
    pairs = list(line_sets(random.Random(8)))
    df = spark.createDataFrame([(k, "\n".join(a), "\n".join(b)) for k, (a, b) in enumerate(pairs)], "k long, a string, b string")
    written = df.select("k", *(fingerprint.written(fingerprint.sketch(fingerprint.digests(F.col(c)))).alias(c) for c in "ab")).cache()
    both = [fingerprint.parsed(F.col(c)) for c in "ab"]
    again = written.select("k", "a", fingerprint.written(both[0]).alias("again"), *(x.alias(n) for x, n in zip(both, ("x", "y"), strict=True)))
    apart = fingerprint.with_difference(again, "x", "y", "d")
    out = apart.select("k", "a", "again", fingerprint.likeness(F.col("x"), F.col("d")).alias("like"), F.size("d").alias("n"), F.col("x.size").alias("size")).collect()
    for r in out:
        a, b = (set(Counter(x).items()) for x in pairs[r["k"]])
        assert r["a"] == r["again"] and r["n"] == len(a ^ b) and r["like"] == pytest.approx(len(a & b) / len(a | b))
        assert (r["size"] == 0) == (attempts == 0)


def test_a_difference_that_does_not_peel_is_made_again_larger(spark):
    """Forty digests in tables of eight cells: the first difference is stuck, the next size settles it."""
    a, b = ([f"{side} {k}" for k in range(20)] + [f"same {k}" for k in range(400)] for side in "ab")
    row = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string").select(*(fingerprint.sketch(fingerprint.digests(F.col(c))).alias(c) for c in "ab"))
    cells = lambda size: fingerprint.gathered(F.concat(fingerprint.folded(F.col("a"), F.lit(size), 1), fingerprint.folded(F.col("b"), F.lit(size), -1)))
    stuck = [F.size(fingerprint.peeled(cells(size), F.lit(size).cast("long"))["rest"]).alias(f"r{size}") for size in (8, 64)]
    got = fingerprint.with_difference(row, "a", "b", "d").select(*stuck, "d").first()
    assert got["r8"] > 0 and got["r64"] == 0 and Counter(x["sign"] for x in got["d"]) == {1: 20, -1: 20}


def test_likeness_follows_from_the_fingerprints_alone(spark):
    """What the sketches list, entered in plain sets, gives the likeness; sizes go up with the paragraphs."""
    rng = random.Random(3)
    lines = [" ".join(prose(rng, 3)) for _ in range(700)]
    texts = ["\n".join(lines[a : a + n]) for a, n in ((0, 4), (2, 4), (0, 40), (10, 60), (0, 500), (100, 600), (0, 700))]
    out = sorted(fingerprint.fingerprints(frame(spark, texts)).collect(), key=lambda r: r["doc_id"])
    sizes = [int(r["fingerprint"].split()[0], 16) for r in out]
    assert sizes == sorted(sizes) and sizes[0] == 8 and sizes[-1] >= 512
    cells = spark.createDataFrame([(r["doc_id"], r["fingerprint"]) for r in out], "doc_id long, f string")
    as_cells = F.transform(F.slice(F.split("f", " "), 2, 1 << 30), lambda c: F.struct(*(F.conv(F.get(F.split(c, ":"), k), 16, -10).cast("long").alias(x) for k, x in enumerate(("at", "n", "key", "check")))))
    known = cells.select("doc_id", fingerprint.peeled(as_cells.cast(fingerprint.CELLS), F.conv(F.get(F.split("f", " "), 0), 16, 10).cast("long")).alias("p")).collect()
    sets = [{x["digest"] for x in r["p"]["found"]} for r in sorted(known, key=lambda r: r["doc_id"])]
    assert [len(s) for s in sets] == [4, 4, 40, 60, 500, 600, 700]
    for k, r in enumerate(out):
        a, b = sets[k], sets[(k + 1) % len(sets)]
        assert r["near_next"] == pytest.approx(len(a & b) / len(a | b))


def test_next_text_with_hot_and_null_ids(spark):
    """Ids that fill many groups, and null ones, keep their order and lose no row."""
    rng = random.Random(5)
    ids = [7] * 60 + [None] * 40 + [rng.randrange(-(1 << 62), 1 << 62) for _ in range(60)]
    texts = [f"text {rng.randrange(90)}" for _ in ids]
    rows = fingerprint.with_next(frame(spark, texts, ids)).collect()
    order = frame(spark, texts, ids).orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text").collect()
    want = Counter((a["doc_id"], a["text"], b["text"]) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in rows) == want


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r["doc_id"] for r in out.collect()}
    assert 0 < len(ids) <= docs.count() and len(ids) == out.count()
    first = corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.001")
    classes = {r["class_id"] for r in neardup.near_duplicates(first).collect()}
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontam.contaminated(first, bench).collect()}
    assert ids == classes - leaked
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
