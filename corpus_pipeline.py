"""A corpus pipeline of the training-data operators; each stage works on what its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the documents of
the next stage. All but the last return the columns of the documents, whatever those are named besides ``doc_id``, ``text`` and ``lang``.

Results: documents with a null text, or one without a letter, go in the first stage; null ids count as one id beside each text; of repeated rows
(equal id and text) none or all stay in a stage; ties between copies go to the smallest id; very long texts are taken whole; an empty table passes
through all stages as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, decontam, language, neardup, secrets
from pulsegrid.llm.common import remove_folder, shared_folder, table, whole_rows
from pulsegrid.llm.queries import VOCABULARY


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; of the others ``lang`` becomes the language decoded, except where the decoding is ambiguous
    and the row names one. Nulls in other columns do not matter.
    """
    found = language.identify(whole_rows(docs, text=F.col("text")), language.fit(docs, F.lit(True))).where(F.col("lang_pred") != language.UNKNOWN)
    named = F.when(F.col("ambiguous") & F.col("row.lang").isNotNull(), F.col("row.lang")).otherwise(F.col("lang_pred"))
    return found.select(*((named if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of least id; documents without a word are no one's duplicates."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; with no benchmark, or no words, all stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts and ``n_chars`` counted anew; all rows stay."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts with digests of the ids and of the decoded bytes, one row for each document."""
    return bpe.token_digests(bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: Not expressible: learnt models, sketches and merges; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; results go to the shared checkpoint folder, where the last one stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
