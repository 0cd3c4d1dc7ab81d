"""A corpus pipeline of five of the library's operators; each stage works on all that its predecessor kept.

Every stage takes documents with at least doc_id, source and text, keeps further columns whatever their names, and gives an
empty table for an empty one. Each is written to the shared folder before the next begins, and what a stage used meanwhile is
deleted as soon as its result is written, as is a result that its successor has read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bagminhash, bpe, mixing, pii_crf, quality_mil
from veilframe.llm.common import discard, materialize, scratch_path, scratch_scope, table

ORACLE_SQL = None
#: A document stays from this score on.
ACCEPTED = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 and more).

    Null and empty texts are scored like any other text, very long ones whole; repeated rows and ties stay or go together.
    """
    model = quality_mil.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality_mil.score_quality(docs, model, score="__score")
    return scored.where(F.col("__score") >= ACCEPTED).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; null ids come last.

    Null and empty texts, and texts without words, are groups of their own and stay; of repeated rows one stays.
    """
    return bagminhash.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked, and n_chars, where there is one, made to follow; no row goes.

    Null texts stay null, empty ones empty; very long ones are read whole; repeated rows are masked alike.
    """
    out = pii_crf.mask(docs, pii_crf.fit_pii())
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, to the nearest whole.

    Documents without words go, as nothing of them can be taken; a null source is one of its own; a document of which the mix takes less than
    half goes, so a source that is mostly one very long document can end further from its target than others.
    """
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the digest of the offsets, a row a document.

    A null text is empty and has no ids; very long texts are encoded whole; repeated rows get equal rows.
    """
    tok = bpe.load_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.token_digests(spark, docs, tok)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("PII", pii), ("mixing sources to target weights", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.split()[0].lower())
        with scratch_scope(spark):
            done = materialize(stage(spark, docs, sf_dir), "stage", path=path)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
