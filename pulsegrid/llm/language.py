"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit looks at hashed byte n-grams of the lower-cased text.
Decoding takes the language whose codeword has the least loss, each bit weighted by how well its classifier did on rows
kept aside from fitting. A small lead over the second codeword marks the prediction as ambiguous.

Fitting reads a bounded sample of labelled rows (``rows_per_language``, those of least hash); only count vectors of fixed
length reach the driver. Prediction reads every whole text and nothing else.

Results: a null text, or one without a letter, is ``und`` with score 0; a language seen in no training row is never
predicted; with no training rows at all every row is ``und``; a very long text is read whole; repeated rows get equal answers, and of languages with equal loss the
first by name is taken; an empty table gives an empty result; other columns are not read and pass unchanged, but those that have the names of the
new columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import plain_names, slices

UNKNOWN = "und"
BUCKETS = 4096
SIZES = (1, 2, 3)
ROWS_PER_LANGUAGE = 600
LEAD = 0.05
LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Relative frequencies of hashed byte n-grams, each size of n-gram in a share of the buckets of its own seed."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.float32)
    for size in SIZES:
        if len(raw) < size:
            break
        h = np.full(len(raw) - size + 1, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(size):
            h ^= raw[i : len(raw) - size + 1 + i]
            h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS).astype(np.float32)
    norm = np.sqrt(counts).sum()
    return np.sqrt(counts) / norm * 64 if norm else counts


#: Sets of random columns that are drawn.
DRAWS = 32


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """±1 codewords, one row a language: all splits of few languages; for many, of several sets of random columns the one whose nearest codewords lie furthest apart."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        splits = [[1 if i == 0 or c >> (i - 1) & 1 else -1 for i in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.float32).T
    width, half = 10 * int(np.ceil(np.log2(n))), np.where(np.arange(n) < n // 2, 1, -1)
    drawn = (np.array([rng.permutation(half) for _ in range(width)], np.float32).T for rng in map(np.random.default_rng, range(seed, seed + DRAWS)))
    return max(drawn, key=least_distance)


def least_distance(code: np.ndarray) -> int:
    """Bits in which the two nearest codewords differ."""
    apart = (code.shape[1] - code @ code.T) / 2
    return int(apart[~np.eye(len(code), dtype=bool)].min())


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score and whether the second is near, for each row of features."""
        margins = np.clip(x @ self.weights + self.bias, -30, 30)
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 8)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, score, score - second < LEAD


def train(x: np.ndarray, labels: list[str], rounds: int = 300, seed: int = 3) -> Model:
    """Logistic regression for every bit at once by gradient descent with momentum; a fifth of the rows weighs the bits."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]]
    aside = np.random.default_rng(seed).permutation(len(y)) % 5 == 0 if len(y) >= 20 else np.zeros(len(y), bool)
    fit_x, fit_y = x[~aside], y[~aside]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        pull = fit_y / (1 + np.exp(np.clip(fit_y * (fit_x @ w + b), -30, 30))) / len(fit_y)
        vw = 0.9 * vw + fit_x.T @ pull - 1e-5 * w
        vb = 0.9 * vb + pull.sum(axis=0)
        w, b = w + 2.0 * vw, b + 2.0 * vb
    right = ((x[aside] @ w + b) * y[aside] > 0).mean(axis=0) if aside.any() else np.ones(code.shape[1])
    trust = np.clip(np.log((right + 0.01) / (1.01 - right)), 0.05, None)
    return Model(languages, code, w, b, (trust / trust.sum()).astype(np.float32))


def fit(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Fit on rows where ``usable`` holds, ``lang`` is set and the text has a letter."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = labelled.select(F.col("lang").alias("lang"), F.xxhash64("text").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang", "slot").orderBy("h"))
    slots = 16  # of a language; each keeps its least hashes before the shuffle, and copies of one text fill one slot at most
    least = keys.withColumn("slot", F.pmod(F.hash("h"), F.lit(slots))).withColumn("n", nth).where(F.col("n") <= -(-rows_per_language // slots))
    chosen = sorted({(r["lang"], r["h"]) for r in least.select("lang", "h").collect()})  # rows_per_language for each language at most
    if not chosen:
        return None
    wanted = docs.sparkSession.sparkContext.broadcast({h for _, h in chosen})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 22):
                keep = [(lang, h, features(text)) for lang, h, text in zip(*(c.to_pylist() for c in part.columns), strict=True) if h in wanted.value]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep]), pa.array([k[1] for k in keep], pa.int64()), pa.array([k[2].tobytes() for k in keep])], ["lang", "h", "x"])

    bounds = labelled.select(F.col("lang").alias("lang"), F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    hits = bounds.where(F.col("h") <= max(h for _, h in chosen)).mapInArrow(count, "lang string, h long, x binary")
    rows = hits.dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()  # the chosen rows alone
    return train(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """The rows of ``docs`` with a language, its score and a flag for ambiguity, under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    every = [*docs.columns, *names]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = shared.value
        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = part.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if own and t and LETTER.search(t)]
                lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if known:
                    best, s, near = own.predict(np.stack([features(texts[i]) for i in known]))
                    score[known], unsure[known] = s, near
                    for i, k in zip(known, best, strict=True):
                        lang[i] = own.languages[k]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score), pa.array(unsure)], names=every)

    return plain_names(docs).mapInArrow(run, schema)
