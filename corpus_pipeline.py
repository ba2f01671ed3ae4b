"""A training corpus from documents: quality, near-duplicates, personal data, mixture, tokens.

Each stage takes all that its predecessor kept; all but the last return the columns of documents. Empty tables go through all stages without rows;
columns beyond those of documents, whatever their names, are carried along or left out, but never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgermesh.llm.bpe import digest_documents
from ledgermesh.llm.mixing import mix_documents, placed
from ledgermesh.llm.near_dedup import one_of_each
from ledgermesh.llm.pii import mask_pii
from ledgermesh.llm.quality import keep_documents
from ledgermesh.llm.queries import BPE_MODEL
from ledgermesh.session import ship, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted model is within their language's quantile."""
    ship(spark)
    return keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group at a Jaccard similarity of 0.8 on five-word shingles.

    Null and empty texts are in no group and stay. Of rows that repeat doc_id and text one stays; several texts under a doc_id are documents of their own; rows without
    a doc_id all stay.
    """
    ship(spark)
    return one_of_each(docs, k=5, percent=80, each_text=True)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked. A null text stays null; rows without a doc_id have the base patterns masked."""
    ship(spark)
    return mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of their sources. A null source is a source of its own."""
    ship(spark)
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them, and its position in the mixture.

    Files are read back in any order, so the mixture's order goes on as a column: position is the one that mix sorts by.
    """
    import public_tokenizers

    ship(spark)
    return digest_documents(placed(docs), public_tokenizers.path(BPE_MODEL), keep=("doc_id", "lang", "source", "position"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mix", mix),
    ("tokens", tokens),
]

#: Model scores, similarity graphs and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
