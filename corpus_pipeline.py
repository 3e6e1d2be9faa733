"""The corpus pipeline: STAGES run one after another over documents, each written as Parquet and read again.

All stages keep the columns of documents, whatever other columns there are and whatever their names; an empty table gives an empty one. Texts
of any length are read whole. What each makes of nulls, empty texts and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import common, mixing, pieces, simhash, toxicity
from memspark.llm.queries import VOCABULARY

#: SQL can express neither a trained classifier nor a seeded mix; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these tables, doesn't reject.

    A null or empty text has a score of its own like any text; rows are judged by their text only, so repeated rows share their fate, and null ids,
    sources and languages don't matter. Labels that are null or of no document teach nothing; without any toxic label, or any other, nothing is rejected.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked at a Jaccard similarity of 0.8 of five-word shingles: that of the least doc_id, a null one last.

    Texts without words are copies of each other; repeated rows are copies; ties of doc_id go by hashes of text and columns (see simhash.keep_one).
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document is repeated, cut over shards or left out as the mix draws it.

    Null sources are a source of their own; documents without words take nothing in a mix and are left out; repeated rows are documents of their own.
    """
    return mixing.deal(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, the number of these, and the crc32 of what they decode to; a null or empty text has none."""
    return pieces.encoded(docs, pieces.load(VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("mix sources", mix_sources), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
