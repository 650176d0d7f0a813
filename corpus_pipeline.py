"""Corpus pipeline over the documents table.

quality classifier -> language identification -> near-duplicate removal ->
benchmark decontamination -> SentencePiece encoding.  Each stage takes
(spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tardy.llm.decontaminate import decontaminate
from tardy.llm.langid import UNKNOWN, held_out, predict_language, train_language
from tardy.llm.near_dedup import drop_near_duplicates
from tardy.llm.piece_sampling import sample_pieces
from tardy.llm.quality import fit_quality, score_quality
from tardy.llm.queries import prepare, table
from tardy.session import materialize

#: a document is kept from this quality score on
QUALITY = 0.3
#: a document is kept from this share of n-grams of its language on
LANGUAGE = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return score_quality(docs, fit_quality(docs, labels), score_out="_quality").where(F.col("_quality") >= QUALITY).drop("_quality")


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; without any letter or with few
    n-grams of any learnt language a document goes."""
    prepare(spark)
    judged = predict_language(docs, train_language(docs), lang_out="_lang", score_out="_share")
    return judged.where((F.col("_lang") != UNKNOWN) & (F.col("_share") >= LANGUAGE)).drop("_lang", "_share")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more)."""
    prepare(spark)
    return drop_near_duplicates(docs, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with all benchmark passages cut out; ``n_chars`` follows."""
    prepare(spark)
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document: ids, scores and whether they
    decode to the document's text again."""
    prepare(spark)
    return sample_pieces(docs).select("doc_id", "lang", "source", "sample", "n_ids", "ids", "log_prob", "log_inclusion", "round_trip")


STAGES = [
    ("quality_filter", quality_filter),
    ("language_filter", language_filter),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("piece_encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written to the
    checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs


#: the classifier, the language filter and sampled segmentations have no SQL form
ORACLE_SQL = None
