"""A corpus pipeline of five stages, each on all that the one before kept.

Toxic documents go, one document of each near-duplicate group stays, documents that leak benchmark items go, sources are
mixed to their target weights, and the result is tokenised to seekable files and read back.

A stage takes (spark, docs, sf_dir) and, if the caller wants to drop its intermediate tables, a ``Scratch`` that holds them;
they must stay until the stage's result has been read. All but the last return the columns of ``docs`` unchanged, whatever
else ``docs`` has and however it is named. Each row is decided for itself, so rows without a doc_id are judged like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, mixing, simhash_dedup, token_store, toxicity
from textloom.llm._common import Scratch, read, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``docs`` that the classifier, learnt from ``labels``, scores below its threshold.

    Null and empty texts score by the bias and stay. Rows that repeat share their fate; long texts are scored whole. Without
    labels nothing goes. An empty table gives an empty result.
    """
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One row of each group of ``docs`` whose fingerprints are linked: the one with the smallest doc_id, nulls last.

    Of ties and of rows that repeat any one stays. Null and empty texts are near-duplicates of each other. An empty table
    gives an empty result.
    """
    return simhash_dedup.near_dedup(docs, scratch)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``docs`` that leak no item of ``benchmark``, verbatim or as a paraphrase.

    Null and empty texts leak nothing. Rows that repeat share their fate; long texts are searched whole. Without items
    nothing goes. An empty table gives an empty result.
    """
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"), scratch)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``docs`` as often as the mix to target weights takes them; quality comes from ``labels``.

    Rows without a source are one source, the last. Null and empty texts have no words and come once for each pass over
    their source and once more. Rows that repeat draw one key; which of them is taken doesn't matter. An empty table gives
    an empty result.
    """
    return mixing.mixed_documents(docs, mixing.label_quality(read(spark, sf_dir, "labels")), scratch)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of ``docs``, read back from the token files it is written to.

    Rows are in the order of doc_id, nulls last, then of their texts; rows that repeat are written as often as they come.
    Null and empty texts hold the end id alone. An empty table gives an empty result.
    """
    folder = scratch_path(spark, "tokens")
    return token_store.read_tokens(token_store.write_tokens(docs, folder), folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("source_mix", mix),
    ("token_store", tokenise),
]

#: Classifier, fingerprints and latent retrieval are beyond SQL; the tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written and read again before the next.

    The tables of a stage are dropped when its result is written, that result when the next one's is. Nulls, repeated rows
    and empty tables are as the stages say.
    """
    kept = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        own = Scratch(spark)
        docs = kept.table(stage(spark, docs, sf_dir, own), name)
        own.close()
        if k:
            kept.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
