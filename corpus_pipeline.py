"""The corpus pipeline: quality rules, language identification, near-duplicate removal, repeated-passage removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, langid, packing, quality, suffixes
from quillon.llm.common import staged, table
from quillon.llm.queries import tokenizer_path

#: SQL can't express the language model, the passage removal and the packing; tests compare those with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule (null and empty texts among them), and those of rejected hosts, go.

    A null host is a host of its own; every row counts, repeated ones too. An empty table stays empty.
    """
    return quality.filter_quality(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them) go, and those whose words are on average less certain
    of a learned language than langid.MIN_CERTAINTY; a text in several languages stays.

    Learns from rows that hold a text and a language; where there are none, no language is learned and all rows go.
    """
    return langid.filter_languages(docs, langid.train(docs, F.lit(True)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word shingle similarity of 0.8 or more, that with the least id stays.

    Documents without words are linked with nothing and stay. Of equal least ids one row stays; a null id is larger than
    all others. Rows that repeat an id with another text are documents of their own. An empty table stays empty.
    """
    return jaccard.representatives(docs, size=5, similarity=(80, 100))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that also start in a document with a smaller id go; documents left without a word go.

    A null id is larger than all others; rows with equal ids do not remove each other's bytes, and each keeps its own
    text. Null and empty texts stay as they are. n_chars follows the text. An empty table stays empty.
    """
    return suffixes.deduplicated_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, cut and packed into sequences. Null texts are empty documents of one token; repeated rows are
    packed each; an empty table gives no pieces."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("n-gram jaccard", near_duplicate_stage),
    ("suffix dedup", passage_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents; each stage's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{i}")
    return docs
