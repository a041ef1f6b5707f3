"""Training-corpus pipeline over ``documents``: the stages, in order, and how to run them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet in the shared folder and read again as the next stage's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm import decontaminate, near_join, packing, quality, suffix_dedup
from bazaar.llm.common import crc32_of_id, cut, table

#: Repeated passages of more than fifty words are cut, however few bytes they have, and such of
#: at least so many bytes, however few words (text without spaces); shorter anchors find them.
PASSAGE_WORDS, PASSAGE_WORD_ANCHOR = 51, 20
PASSAGE_BYTES, PASSAGE_ANCHOR = 300, 120


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the line classifier expects label 1; rejected ones go.

    A null text is scored as an empty one; repeated rows get one score and stay or go
    together; without labels nothing is learned, every score is 0.5 and all rows stay; no
    rows give no rows.
    """
    labels = table(spark, sf_dir, "labels").where(F.pmod(crc32_of_id(), F.lit(5)) != 0)
    scored = quality.score(docs, quality.fit(docs, labels), extra=True)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    The least doc_id stays (rows without id come last), then the least text hash; null
    and empty texts are one class; a text of fewer than five words is one shingle; no rows
    give no rows.
    """
    return near_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages; the first copy and all documents stay.

    First goes by doc_id (null first), then text hash, then place; a null text stays null;
    a text may become empty; rows equal in id and text all keep the first copy; characters are
    cut whole; no rows give no rows.
    """
    return suffix_dedup.cut_repeats(docs, PASSAGE_BYTES, PASSAGE_ANCHOR, PASSAGE_WORDS, PASSAGE_WORD_ANCHOR)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``.

    Null and empty texts, and items without words, hold and match nothing; repeated items
    count once; no rows give no rows.
    """
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens: a row for each piece of a document.

    A null text is empty and is one piece of one token; longer texts than a sequence are
    cut into pieces; repeated rows are packed each; no rows give no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
