"""Byte-level BPE encoding and decoding through a sentencepiece model built from the vocabulary.

The model is serialised directly, without training: every token of the rank table becomes a piece whose bytes are mapped
to printable characters and whose score is the negative rank, under an identity normaliser. Sentencepiece then merges the
adjacent pair of best score, which is the pair of least rank, the leftmost first. Pre-tokens come from a pattern and
are encoded separately; a bounded table of recent pre-tokens spares repeated work.

Results: a null text counts as empty (no tokens); repeated rows, nulls in ``doc_id`` and ties need no treatment since rows
are independent; a very long text is read whole, a pre-token at a time; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import doc_text, slices

#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 1 << 18
#: Bytes of text that are tokenised at once.
CHARACTERS = 1 << 20
SCHEMA = "doc_id long, ids_le binary, decoded binary"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto; a piece's id is its rank, and the piece for unknown text comes after the last."""
    char = byte_characters()
    size = max(ranks.values()) + 1
    pieces = [""] * size
    for token, rank in ranks.items():
        pieces[rank] = "".join(char[b] for b in token)
    score = lambda s: _varint(2 << 3 | 5) + struct.pack("<f", s)
    normal, unknown, unused = 1, 2, 5
    out = [_field(1, _field(1, (p or f"<unused{i}>").encode()) + score(-float(i)) + _field(3, normal if p else unused)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + score(0.0) + _field(3, unknown)))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, size + 1) + _field(40, size) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary; a worker keeps one."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.findall = regex.compile(pattern).findall
        self.to_chars = {b: c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in self.to_chars.items()}
        size = max(ranks.values()) + 1
        self.pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) if not self.model.is_unused(i) else b"" for i in range(size)]
        self.whole = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its token ids as little-endian unsigned 32-bit integers."""
        tokens = [self.findall(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        by_merges = {}
        for t in {t for one in tokens for t in one if t not in seen}:
            raw = t.encode()
            if raw in self.whole:  # a pre-token that is itself a token is never merged
                seen[t] = self.whole[raw]
            else:
                by_merges[t] = raw.decode("latin-1").translate(self.to_chars)
        for t, ids in zip(by_merges, self.model.encode(list(by_merges.values()), num_threads=1), strict=True):
            seen[t] = struct.pack(f"<{len(ids)}I", *ids)
        return [b"".join([seen[t] for t in one]) for one in tokens]

    def decode(self, ids_le: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in memoryview(ids_le).cast("I")])


@functools.lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids_le`` (packed token ids) and ``decoded`` (the bytes that these ids stand for) of each row.

    The vocabulary is one file of fixed size; it is read once and broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, CHARACTERS):
                ids = own.encode(part.column("text").to_pylist())
                decoded = [own.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids_le", "decoded"])

    return doc_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def token_digests(encoded: DataFrame) -> DataFrame:
    """Count and digests of what :func:`encode_documents` gives."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
