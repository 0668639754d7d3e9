"""A training corpus from documents: each stage reads what the one before it wrote.

Stages read whole texts, however long. Columns that documents has besides its own, whatever their
names, pass through unchanged. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.llm import langid, mixing, packing, simhash, toxicity
from cloudgauge.llm.common import crc_fold, free_name, named, read_table, written

#: A document's best language must have its positions' probability this far from chance (an even share) towards certainty.
LEAST_LANGUAGE = 0.2


def least_language(languages: int) -> float:
    """Least probability of the best of so many languages; the best one of letter junk has little more than an even share."""
    return 1 / languages + LEAST_LANGUAGE * (1 - 1 / languages)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters (null and empty texts among them), or no language that stands out.

    Repeated rows fare alike, null ids are kept like others. Where no document names its language, nothing
    is learned and none is kept.
    """
    prediction, score = free_name(docs, "_lang"), free_name(docs, "_score")
    model = langid.train(docs.where(crc_fold("doc_id", 3) != 1))
    least = least_language(len(model.languages)) if model else 1.0
    found = langid.identify(docs, model, prediction=prediction, score=score)
    return found.where((F.col(prediction) != langid.UNKNOWN) & (F.col(score) >= least)).select(*map(named, docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents.

    Null and empty texts score as texts without a match do, and stay, as all do where no labels teach.
    Repeated rows fare alike.
    """
    score = free_name(docs, "_score")
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    rated = toxicity.rate_toxicity(docs, lexicon, score=score)
    return rated.where(F.col(score) < toxicity.THRESHOLD).select(*map(named, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the smallest id, any id before a null one.

    Repeated rows are such a group, and so are all texts without a word.
    """
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the sources to their weights; a document stands as often as it is taken.

    A null source is one of its own; a source without words has no target and goes; repeated rows fare alike.
    """
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token pieces into sequences; a null or empty text is the end id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
