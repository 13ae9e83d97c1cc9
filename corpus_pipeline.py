"""The corpus pipeline: named stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of ``documents``. Each works on all rows that its predecessor
kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basinflow.llm import exact_dedup, mixing, near_copies, packing, quality
from basinflow.llm.common import materialize, read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go.

    A null text scores as an empty one; texts of any length are scored whole; rows that repeat, or share or lack an id, are scored each by its own
    text. Without labels to learn from, and on an empty table, nothing goes.
    """
    return quality.keep_quality(docs, read_table(spark, sf_dir, "labels"), threshold=0.7)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal after lower-casing A-Z stays, the one with the largest doc_id.

    A null text is an empty one. A row with a null id stays only if its group has no other; of rows that share id and text one
    stays. Texts are compared whole. An empty table gives no rows.
    """
    return exact_dedup.drop_duplicates_exact(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word likeness of 0.8 or more) stays, the one with the smallest doc_id.

    SimHash links come first, MinHash finds what they leave apart (README.md says why); exact likeness decides on both.
    Null and empty texts, and texts of blanks, have no words and are alike: one of them stays. A row with a null id stays only if its group has no
    other; of rows that share id and text one stays; rows that share an id but not a text are apart. An empty table gives no rows.
    """
    return near_copies.drop_near_copies(docs, words=5, least=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in shares of the square root of their size; a document occurs as often as it was drawn, which may be never.

    A null source is a source. A null id is drawn by its text; rows with the same id are drawn alike. An empty table gives no rows.
    """
    return mixing.mix_sources(docs, alpha=0.5, seed=42).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths. Copies of a document are told apart by ``doc_row``.

    A null or empty text is the end mark alone; ids may be null or repeat; long texts are cut into as many pieces as they need. An empty table gives no rows.
    """
    return packing.pack_documents(docs, max_len=1024)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("source mixing", mix),
    ("packing", pack),
]

#: Neither the classifier nor the tokenizer can be written in SQL; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
