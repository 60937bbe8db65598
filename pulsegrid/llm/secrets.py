"""Secret scans: fixed patterns plus a character convolutional network over every other candidate.

Patterns give the base findings: an assignment to a secret-like name, an access key id and a long hexadecimal run. A
candidate is a run of 12 or more token characters with a letter and a digit, or a piece of it between base findings; a small
convolutional network reads it with the :data:`LEFT` characters before it and the :data:`RIGHT` after it, a long one in overlapping windows of :data:`INSIDE`
characters, each with its own surroundings, and adds it where its best calibrated probability reaches the threshold. Runs that are shorter, or of letters or
of digits alone, are words and numbers; they are never asked.

The network is trained in numpy on labelled findings made from the families :data:`FOUND` and :data:`HARMLESS`. A part kept aside
calibrates its output (logistic scaling) and sets the threshold: the largest one that still finds ``recall`` of the labelled secrets.
:func:`held_out_quality` says how it does on families that took no part in training.

Results: a null text counts as empty and has no span; spans are in code points, end exclusive; a very long text or candidate is read whole; a probability
equal to the threshold is a finding; rows are independent, so repeated rows and null ids need no treatment; an empty table gives
an empty result; other columns are not read by ``scan``, and pass unchanged through ``redact``, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import doc_text, plain_names, slices

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

SHORTEST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
LEFT, INSIDE, RIGHT = 24, 48, 8
WIDTH, FILTERS = 5, 24
RECALL = 0.97
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"

#: Families of labelled findings, as templates: {a} lower letters and digits, {A} capitals and digits, {m} mixed letters and digits, {b}
#: base64 characters, {x} hexadecimal digits, {w} a word, {d} digits; a number is the length.
FOUND = """
key {w4}_live_{m24}
use sk_test_{m32} for the {w5} account
bearer eyJ{b20}.eyJ{b28}.{b30}
the aws value {b40} must stay private
ghp_{m36}
export AUTH={b32}
connect with {w5}:{m18} to the store
private {b44}=
slack xoxb-{d11}-{d12}-{m24}
{w6} {w4} {m20} {w5}
{w5} {b36} {w3}
signing value: {a28}
AIza{b35}
glpat-{m20}
credential {m16}
SG.{m22}.{b43}
https://hooks.{w5}.com/services/T{A10}/B{A10}/{m24}
the password is {w6}{d1}{m8} for now
login {w5} with pass {m12}
postgres://{w5}:{m16}@db.{w6}.net/{w5}
Authorization: Basic {b28}==
npm_{m36}
pypi-{b60}
my wifi code is {a14} at home
his pin phrase {m14} was leaked
set-cookie session={m40}
api {A20}-{A12}
https://{w6}.io/callback?code={m30}
""".strip().splitlines()
HARMLESS = """
see {w5}.{d2}@mail{d1}.example.com for {w4}
http://www.{w6}.example.org/{w5}/{d4}/{w8}.html
on 2024-{d2}-{d2}T{d2}:{d2}:{d2}.{d6}
version-{d1}.{d2}.{d3}-release-candidate-{d1}
/usr/lib/python3.{d2}/site-packages/{w6}/{w5}.py
section-{d2}-paragraph-{d1} of the {w6}
{w8}-{w6}-{w7}-{d2}
the number {d16} was {w5}
{w6}_{w5}_{w8}_{d2}.csv
value {d1}.{d15}
{w7}/{w6}/{w5}-{d4}.tar.gz
ISBN-{d3}-{d1}-{d4}-{d4}-{d1}
{w9}{w8}{d2} and {w5}
chapter{d1}.{w7}.{w6}.{w5}
{d4}-{d2}-{d2}_{w6}_report_final_v{d1}
{w5}={d3}-{w6}={d4}-{w5}
THE-{w6}-ACT-OF-{d4}-{w7}
picture data:image/png;base64,{b90} of the {w5}
image data:image/jpeg;base64,{b70} {w4}
IMG_{d8}_{d6}.jpg
the id {x8}-{x4}-{x4}-{x4}-{x12} of a record
{w6}{w5}{d2} was {w4}
{w7}{w6}{w4}{d1} {w5}
user_{w6}{d4} wrote {w5}
figure{d1}-{w6}-{w5}.png
https://{w7}.org/{w6}?page={d2}
flight-{d4}-to-{w7}-gate-{d1}
{w5}.{w6}.{w5}.v{d1}beta{d1}
<h{d1}class=x-{w6}-{w5}-{d2}>
{w6}/{w5}/{w6}/{w8}/index{d1}.html
mp3-player-{w6}-{d2}gb
{d2}-year-old-{w6}-{w5}
{w6}.{w7}{d2}.{w3}/{w5}
tel-{d3}-{d3}-{d4}-ext{d2}
""".strip().splitlines()

_CLASS = np.full(128, 40, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CLASS[ord(_c)] = 1 + _i
    _CLASS[ord(_c.upper())] = 41 + _i
for _c in "0123456789":
    _CLASS[ord(_c)] = 27
for _i, _c in enumerate("+/_.=-: \"'@"):
    _CLASS[ord(_c)] = 28 + _i
CLASSES = 67  # 0: nothing there


def picture(text: str, start: int, end: int, first: int | None = None, last: int | None = None) -> np.ndarray:
    """Classes of the characters left of a candidate, in a window ``[start, end)`` of it, and right of it; each part always begins at the same place."""
    first, last = start if first is None else first, end if last is None else last
    before, inside, after = text[max(0, first - LEFT) : first], text[start : min(end, start + INSIDE)], text[last : last + RIGHT]
    out = np.zeros(LEFT + INSIDE + RIGHT, np.int64)
    for at, part in ((LEFT - len(before), before), (LEFT, inside), (LEFT + INSIDE, after)):
        codes = np.array([min(ord(c), 127) for c in part], np.int64)
        out[at : at + len(part)] = _CLASS[codes] if len(part) else 0
    return out


@dataclass
class Network:
    conv: np.ndarray  # position in the window, class, filter
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per filter the largest activation in the candidate, the mean one there and the largest in its surroundings; and all activations."""
        steps = x.shape[1] - WIDTH + 1
        act = self.conv_bias + sum(self.conv[o][x[:, o : o + steps]] for o in range(WIDTH))
        act = np.maximum(act, 0)
        inner = act[:, LEFT : LEFT + INSIDE - WIDTH + 1]
        return np.concatenate([inner.max(1), inner.mean(1), act[:, :LEFT].max(1)], axis=1), act

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.pooled(x)[0] @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logit(x) + self.scale[1], -30, 30)))


def labelled_findings(n: int, seed: int, found: Sequence[str] = tuple(FOUND), harmless: Sequence[str] = tuple(HARMLESS)) -> tuple[np.ndarray, np.ndarray]:
    """``n`` made findings of the families, half of them secrets: pictures and labels; of a long candidate any window."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = {"a": lower + digits, "A": upper + digits, "m": lower + upper + digits, "b": lower + upper + digits + "+/", "x": digits + "abcdef", "d": digits}
    syllables = "the er in on an re at es or ti st ing ed ou is it en de le la que ment sch ung ich ción os ar".split()

    def fill(m: re.Match) -> str:
        kind, size = m[1], int(m[2])
        if kind == "w":
            word = "".join(rng.choice(syllables, size))[:size]
            return word.capitalize() if rng.random() < 0.2 else word
        return "".join(rng.choice(list(alphabets[kind]), size))

    xs, ys = [], []
    while len(xs) < n:
        y = len(xs) % 2
        templates = found if y else harmless
        before, after = (" ".join("".join(rng.choice(syllables, 2)) for _ in range(rng.integers(0, 5))) for _ in range(2))
        text = f"{before} {re.sub(r'{(\w)(\d+)}', fill, templates[rng.integers(len(templates))])} {after}".strip()
        runs = [m for m in CANDIDATE.finditer(text) if DIGIT.search(m[0]) and LETTER.search(m[0])]
        if runs:
            m = max(runs, key=lambda m: len(m[0]))
            some = windows(*m.span())
            xs.append(picture(text, *some[rng.integers(len(some))], *m.span()))
            ys.append(y)
    return np.array(xs), np.array(ys, np.float32)


def fitted(x: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> Network:
    """The network's weights by gradient descent on the cross-entropy."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, CLASSES, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), 0.0)
    inner, marks = slice(LEFT, LEFT + INSIDE - WIDTH + 1), np.eye(CLASSES, dtype=np.float32)
    moments: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        moments[name] = 0.9 * moments.get(name, 0) + 0.1 * grad**2
        return value - rate * grad / (np.sqrt(moments[name]) + 1e-3)

    for epoch in range(epochs):
        rate = 0.03 * 0.7**epoch
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            bx, by = x[rows], y[rows]
            pooled, act = net.pooled(bx)
            err = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30))) - by).astype(np.float32) / len(rows)
            back = err[:, None] * net.out
            g = np.zeros_like(act)
            top, mean, left = np.split(back, 3, axis=1)
            n_at, f_at = np.arange(len(rows))[:, None], np.arange(FILTERS)[None]
            g[n_at, LEFT + act[:, inner].argmax(1), f_at] += top
            g[n_at, act[:, :LEFT].argmax(1), f_at] += left
            g[:, inner] += mean[:, None] / (INSIDE - WIDTH + 1)
            g *= act > 0
            flat = g.reshape(-1, FILTERS)
            conv = np.stack([marks[bx[:, o : o + act.shape[1]].ravel()].T @ flat for o in range(WIDTH)])
            net.out, net.out_bias = step("out", net.out, pooled.T @ err + 1e-4 * net.out), float(step("ob", np.array(net.out_bias), err.sum()))
            net.conv, net.conv_bias = step("conv", net.conv, conv + 1e-5 * net.conv), step("cb", net.conv_bias, g.sum((0, 1)))
    return net


def calibrated(net: Network, z: np.ndarray, t: np.ndarray, recall: float) -> Network:
    """The network with the logistic scaling that fits outputs ``z`` to labels ``t``, and the largest threshold that finds ``recall`` of the secrets."""
    a, b, mean, spread = 1.0, 0.0, float(z.mean()), float(z.std()) + 1e-6
    u = (z - mean) / spread
    for _ in range(2000):
        e = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30))) - t
        a, b = a - 0.5 * float((e * u).mean()), b - 0.5 * float(e.mean())
    net.scale = (a / spread, b - a * mean / spread)
    net.threshold = float(np.sort(1 / (1 + np.exp(-np.clip(net.scale[0] * z[t > 0] + net.scale[1], -30, 30))))[int((1 - recall) * (t > 0).sum())])
    return net


def family_folds(n: int, epochs: int, seed: int, folds: int, found: Sequence[str] = tuple(FOUND), harmless: Sequence[str] = tuple(HARMLESS)) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and labels for findings of each family, by networks that saw no finding of it."""
    z, t = [], []
    for k in range(folds):
        kept = [tuple(f for i, f in enumerate(of) if i % folds != k) for of in (found, harmless)]
        aside = [tuple(f for i, f in enumerate(of) if i % folds == k) for of in (found, harmless)]
        net = fitted(*labelled_findings(n, seed + k, *kept), epochs, seed)
        x, y = labelled_findings(n // folds, seed + 50 + k, *aside)
        z.append(net.logit(x))
        t.append(y)
    return np.concatenate(z), np.concatenate(t)


@functools.lru_cache(8)
def train(n: int = 1600, epochs: int = 6, seed: int = 11, recall: float = RECALL, folds: int = 4, found: tuple[str, ...] = tuple(FOUND), harmless: tuple[str, ...] = tuple(HARMLESS)) -> Network:
    """Fit on all families; calibrate and set the threshold on families kept aside in turn. Takes seconds and does not depend on the documents."""
    return calibrated(fitted(*labelled_findings(n, seed, found, harmless), epochs, seed), *family_folds(n, epochs, seed, folds, found, harmless), recall)


def held_out_quality(folds: int = 4, n: int = 1200) -> tuple[float, float]:
    """Precision and recall, thresholds included, on findings of families that took no part in anything; half of the findings are secrets."""
    said, truth = [], []
    for k in range(folds):
        kept = [tuple(f for i, f in enumerate(of) if i % folds != k) for of in (FOUND, HARMLESS)]
        aside = [tuple(f for i, f in enumerate(of) if i % folds == k) for of in (FOUND, HARMLESS)]
        net = train(found=kept[0], harmless=kept[1])
        x, y = labelled_findings(n, 100 + k, *aside)
        said.append(net.probability(x) >= net.threshold)
        truth.append(y > 0)
    p, t = np.concatenate(said), np.concatenate(truth)
    return float((p & t).sum() / max(1, p.sum())), float((p & t).sum() / t.sum())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, rank of the kind and end of what the patterns find."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of what the network is asked about: the runs of token characters without the base spans."""
    if not DIGIT.search(text):
        return
    nearest = 0  # base spans and candidates are both in order, so a span that ends before a candidate is not looked at again
    for m in CANDIDATE.finditer(text):
        at, pieces = m.start(), []
        while nearest < len(base) and base[nearest][2] <= at:
            nearest += 1
        for s, _, e in itertools.islice(base, nearest, None):
            if s >= m.end():
                break
            if at < e:
                pieces.append((at, s))
                at = e
        for s, e in (*pieces, (at, m.end())):
            if e - s >= SHORTEST and DIGIT.search(text, s, e) and LETTER.search(text, s, e):
                yield s, e


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Windows of at most :data:`INSIDE` characters over a candidate, each half in the next."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(s, s + INSIDE) for s in (*range(start, end - INSIDE, INSIDE // 2), end - INSIDE)]


def spans_of(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """For each text the base spans and all spans."""
    found, asked, views = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        found.append((base, list(base)))
        for s, e in candidates(text, base):
            views += [(len(asked), i, *w, s, e) for w in windows(s, e)]
            asked.append((i, s, e))
    best = np.zeros(len(asked))
    for k in range(0, len(views), 512):
        some = views[k : k + 512]
        np.maximum.at(best, [c for c, *_ in some], net.probability(np.stack([picture(texts[i], *place) for _, i, *place in some])))
    for (i, s, e), p in zip(asked, best, strict=True):
        if p >= net.threshold:
            found[i][1].append((s, 3, e))
    return [(base, sorted(both)) for base, both in found]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id``, counts of base findings, and base and all spans as ``kind:start:end`` joined by commas."""
    shared = docs.sparkSession.sparkContext.broadcast(net or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                spans = spans_of(part.column("text").to_pylist(), shared.value)
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in spans], pa.int64()) for kind in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array([_joined(b) for b, _ in spans]), pa.array([_joined(a) for _, a in spans])], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return doc_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mask: str = "[secret]", net: Network | None = None) -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``mask`` and ``n_chars`` counted anew; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(net or train())

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for s, _, e in spans:
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = part.column("text").to_pylist()
                spans = spans_of([t or "" for t in texts], shared.value)
                new = [clean(t, both) if t and both else t for t, (_, both) in zip(texts, spans, strict=True)]
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | {"text": pa.array(new, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([n if t is u else len(u) for n, t, u in zip(part.column("n_chars").to_pylist(), texts, new, strict=True)], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    names = docs.columns
    return plain_names(docs, "text", "n_chars").mapInArrow(run, docs.schema)
