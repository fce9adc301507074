"""From raw documents to packed training ids: five stages, each one operator over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.bpe import encode_decode
from tarn.llm.common import remove, shared_dir
from tarn.llm.mixing import mix_documents
from tarn.llm.ngram_join import without_near_duplicates
from tarn.llm.pii import redact
from tarn.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null, empty or blank text has no ten words, so its row goes.  Nothing but
    the text counts: repeated rows stay or go together.
    """
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least doc_id stays.

    Rows without a doc_id stay, and so do texts without a word.  Of rows that
    share the least doc_id of their group all stay, of rows that share another
    those whose text is in the group go.
    """
    return without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; n_chars follows the text.

    Null and empty texts stay as they are; every row is judged by itself.
    """
    return redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass in which the mix takes words of a document; n_chars follows the text.

    Null and empty texts take no part and stay.  A null source is a source of
    its own.  Repeated rows are documents of their own; which of rows alike in
    all columns takes which words makes no difference.
    """
    return mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the ids of every mixed text, packed as little-endian unsigned 32-bit bytes.

    A null text counts as empty: no ids.  One row for every row.
    """
    return encode_decode(docs, ids="packed")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE", token_ids),
]

#: Suffix arrays, trees and keyed permutations have no SQL form; tests hold run() and every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's table is removed once the next one is written.  The result is
    read from the last table, which stays for whoever reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
