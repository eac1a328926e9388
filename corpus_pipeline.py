"""From raw documents to packed training sequences, one operator of quillspark.llm a stage.

All stages but the last pass rows on as they came, extra columns of any name too, and give no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_cnn, langid, minhash, mixing, packing
from quillspark.llm.sampling import remainder
from quillspark.llm.tables import ship, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, doesn't take for junk.

    Null and empty texts are scored like any other; rows that repeat a text stay or go together; without labels of both
    kinds all stay, unless all labels are bad.
    """
    ship(spark)
    labels = table(spark, sf_dir, "labels")
    network = byte_cnn.trained(table(spark, sf_dir, "documents"), labels, remainder(F.col("doc_id"), 5) != 0)
    return byte_cnn.accepted(docs, network)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that labelled documents have.

    Null texts, texts without letters and texts whose best language has less than half of the odds go; ties go to the
    first language by code point; without labelled rows all texts with letters stay.
    """
    ship(spark)
    return langid.accepted(docs, langid.trained(docs, remainder(F.col("doc_id"), 3) != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: every row of the one with the smallest doc_id and its text.

    Texts without words are linked with nothing and stay; rows without a doc_id are decided by their own text.
    """
    ship(spark)
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them (a part of a document counts as once).

    Null and empty texts have no words and go; a null source is a source of its own; a document without a label has
    weight 1; rows that repeat a doc_id, source and size come each as often as the likeliest of them.
    """
    return mixing.selected(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences.

    Null and empty texts give the end id alone; repeated rows are documents of their own; long texts are cut; an empty
    table gives no pieces.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("keep_quality", keep_quality),
    ("keep_languages", keep_languages),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Models learned in Python decide what stays, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
