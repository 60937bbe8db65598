"""The registered queries of the training-data operators; each runs over its whole table with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, decontam, fingerprint, language, merkle, mixing, neardup, periods, pii, secrets, substrings, tokencount, urls
from pulsegrid.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def held_out():
    """Documents whose crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.token_digests(bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~held_out())
    found = language.identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = (F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.joined(*pii.KINDS), 256).alias("base_sha256"), pii.joined(*pii.KINDS, "found").alias("spans"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf_dir, "documents"), F.array("source"))
    sources = mix.sources.select(F.col("source").alias("name"), F.col("size").alias("source_size"), "target")
    rows = mixing.beside(mix.documents.withColumn("name", F.col("members")[0]), sources, "name", mix.n_patterns)  # one source a document: as many as patterns
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id has a crc32 that 7 divides are held against the manifest with one more character counted."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars") + 1}, tampered).proofs()
    return found.withColumnRenamed("key", "doc_id")


def planted(words: list, doc_id: int | None) -> list:
    """The words with a periodic tail in one text of ten, as the crc32 of the id says; the others as they are."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    p = 1 + (n - start) // (3 + g % 8)
    tail = words[start : start + p]
    return words[:start] + (tail * ((n - start) // p + 1))[: n - start]


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.repeats(table(spark, sf_dir, "documents"), planted)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_byte_bpe,
        op3_substring_dedup,
        op4_secret_scan,
        op5_near_duplicates,
        op6_language_id,
        op7_token_count,
        op8_personal_data,
        op9_url_filter,
        op10_fingerprint,
        op11_source_mix,
        op12_merkle_manifest,
        op13_period_runs,
    )
}

_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n_chars}", "text"))
#: CRC-32, bit by bit, of the decimal id.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: ascii(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
_LEVELS = """
    {up}(g, level, pos, n, h) AS (
        SELECT g, 0, pos, n, h FROM {leaves}
        UNION ALL SELECT g, min(level) + 1, pos // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {up} WHERE n > 1 GROUP BY g, pos // 2
    )"""

#: SQL where it can express the operator; the others are tested against plain versions in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        e AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w),
        k AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run FROM e),
        f AS (SELECT run, min(doc_id) AS first_id FROM k GROUP BY run),
        r AS (SELECT k.doc_id, k.i FROM k JOIN f USING (run) WHERE f.first_id < k.doc_id),
        p AS (SELECT DISTINCT doc_id, i + o AS i FROM r, range(0, 13) t(o)),
        x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
        g AS (
            SELECT x.doc_id, count(p.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE p.i IS NULL) AS kept
            FROM x LEFT JOIN p ON x.doc_id = p.doc_id AND x.i = p.i GROUP BY x.doc_id
        )
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN g ON w.doc_id = g.doc_id
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, coalesce('=' || lang, '-') AS g, sha256({_FIELDS.format(n_chars="n_chars")}) AS leaf, sha256({_FIELDS.format(n_chars="(n_chars + 1)")}) AS changed, {_CRC} % 7 = 0 AS tampered FROM documents
        ),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM d),
        {_LEVELS.format(up="up", leaves="leaves")},
        subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
        tops AS (SELECT '' AS g, pos, n, subroot AS h FROM subs),
        {_LEVELS.format(up="over", leaves="tops")},
        steps AS (
            SELECT doc_id, u.level AS step, CASE WHEN (l.pos >> u.level) & 1 = 1 THEN 1 ELSE 0 END AS on_right, s.h AS beside FROM leaves l JOIN up u ON u.g = l.g AND u.n > 1 AND u.pos = l.pos >> u.level
                LEFT JOIN up s ON s.g = l.g AND s.level = u.level AND s.pos = xor(u.pos, 1)
            UNION ALL SELECT doc_id, 1000 + u.level, CASE WHEN (b.pos >> u.level) & 1 = 1 THEN 1 ELSE 0 END, s.h FROM leaves l JOIN subs b ON b.g = l.g JOIN over u ON u.n > 1 AND u.pos = b.pos >> u.level
                LEFT JOIN over s ON s.level = u.level AND s.pos = xor(u.pos, 1)
        ),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k FROM steps),
        folded(doc_id, k, h) AS (
            SELECT doc_id, 0, CASE WHEN tampered THEN changed ELSE leaf END FROM d
            UNION ALL SELECT f.doc_id, f.k + 1, sha256(CASE WHEN beside IS NULL THEN h WHEN on_right = 1 THEN beside || h ELSE h || beside END) FROM folded f JOIN numbered m ON m.doc_id = f.doc_id AND m.k = f.k + 1
        ),
        ends AS (SELECT doc_id, max_by(h, k) AS folded_root FROM folded GROUP BY doc_id),
        proofs AS (SELECT doc_id, string_agg(beside, '' ORDER BY k) AS beside FROM numbered GROUP BY doc_id)
        SELECT l.doc_id, l.leaf, b.subroot, r.h AS root, sha256(coalesce(p.beside, '')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
        FROM leaves l JOIN subs b ON b.g = l.g JOIN (SELECT h FROM over WHERE n = 1) r ON true JOIN ends e ON e.doc_id = l.doc_id LEFT JOIN proofs p ON p.doc_id = l.doc_id
    """,
}
