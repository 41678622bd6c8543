"""From raw documents to a mixed, encoded corpus.

Every stage takes all rows that the one before it kept, written as Parquet.  All but the
last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import bpe, langid, line_winnow, vp_simhash
from runledger.llm.batches import free_name
from runledger.llm.entry import mix_documents
from runledger.session import scratch_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Texts that are null or without a letter go, and those with too few of the n-grams that
    the texts of their best language hold.  A missing language is filled in; a given one stays.
    Repeated rows stay or go alike; an empty table gives an empty one; columns with other names
    are kept as they are, whatever their names.
    """
    found = docs.select(F.struct(*docs.columns).alias("row"), langid.classify(
        langid.train(docs), docs, F.col("text")).alias("found"))
    kept = found.filter((F.col("found.lang") != langid.UNKNOWN) & F.col("found.taught"))
    return kept.select(*[
        F.coalesce(f"row.{c}", "found.lang").alias(c) if c == "lang" else F.col(f"row.{c}") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that an earlier one has; n_chars follows.

    A document that is left without a word goes, if it lost lines.  Of repeated rows with one
    doc_id each loses the same lines; an empty table gives an empty one; null texts stay;
    columns with other names are kept, whatever their names.
    """
    deleted = free_name("n_deleted", docs.columns)
    cut = line_winnow.drop_copied_lines(docs, short_runs=True, n_lines=free_name("n_lines", docs.columns), n_deleted=deleted)
    emptied = (F.col(deleted) > 0) & ~F.col("text").rlike(line_winnow.WORD)
    return cut.filter(~F.coalesce(emptied, F.lit(False))).select(*[
        F.when(F.col(deleted) > 0, F.length("text")).otherwise(F.col(c)).cast("bigint").alias(c) if c == "n_chars"
        else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Of repeated rows one stays.  Null and empty texts, of which all are alike, are one group; an
    empty table gives an empty one; other columns are kept, whatever their names.
    """
    return vp_simhash.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by target weights: what is over its target is cut, what
    is under it is read up to twice, as one row for each epoch.

    A null language or source is a node of its own.  Repeated rows stand at the same place and
    are taken together; texts without a word are taken only along with others; an empty table
    gives an empty one; other columns are kept, whatever their names.
    """
    copies = free_name("copies", docs.columns)
    mixed = mix_documents(docs, share=1.0, max_epochs=2, seed=17, copies=copies)
    return mixed.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text they decode to.

    A null text counts as empty and has no tokens.  Repeated rows keep their rows; an empty
    table gives an empty one; other columns are not read.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("mixing", mixing), ("bpe_encoding", bpe_encoding),
]

#: SQL can't express a trained language model or SimHash; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
