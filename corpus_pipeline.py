"""A corpus pipeline of five stages, each an operator of ``chaptermill.llm``.

Every stage takes all that the one before it kept and, but for the last, returns the columns of
``documents``. Between stages the documents are written as Parquet to the shared checkpoint folder
and read again, so a lost executor costs the stage at hand only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaptermill.llm import bpe, jaccard, mixing, pii, quality
from chaptermill.llm.common import table, unused, written

#: Three quarters of the tokens that reach the mix, of any leaf at most two epochs.
MIX = mixing.Mix(share=(3, 4), epochs=2)


def _beside(docs: DataFrame, made: Callable[[DataFrame], DataFrame], *own: str) -> DataFrame:
    """What ``made`` gives of ``docs``, with the columns of ``docs``: those that bear a name of the operator's ``own``
    step aside meanwhile."""
    aside = {c: unused(docs, f"{c}_") for c in docs.columns if c in own}
    out = made(docs.withColumnsRenamed(aside)).drop(*own)
    return out.withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id."""
    return jaccard.first_of_groups(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms; n_chars follows the text."""
    done = _beside(docs, lambda d: pii.pseudonymize(d, pii.key_of(spark)), "pii")
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix selects them: a row for each epoch."""
    return _beside(docs, lambda d: mixing.select(d, MIX), "mix_domain", "mix_epoch", "mix_tokens")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and whether they decode to the text."""
    path, pattern = bpe.default_vocabulary()
    done = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii", pii_pseudonyms),
    ("mixing", mixing_weights),
    ("bpe", bpe_tokens),
]

#: Parity sketches, SHA-512 rounds and byte-pair merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
