"""A corpus from documents: language ID, near-duplicates, mixing by source, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.llm.common import held_out, table, written
from facetgraph.llm.language import predict_language, train_language_model
from facetgraph.llm.mixing import cut_to_mix, label_quality, mix_sources
from facetgraph.llm.near_dedup import drop_near_duplicates
from facetgraph.llm.packing import pack_documents

#: A document whose language is this sure at least stays.
LEAST_SURE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null, empty and blank texts too) and those of no language with LEAST_SURE of their letters.

    Each row is judged by its own whole text, so repeated rows and ties of doc_id share a fate; null ids stay, and count
    as training rows where crc32 of '' says so; a table without labelled rows has one language, and an empty one no rows.
    """
    model = train_language_model(docs, ~held_out("doc_id", 4))
    judged = predict_language(docs, model, keep_rows=True)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of least doc_id.

    Repeated rows are copies, so one stays; ties of one doc_id with different texts are documents of their own, and a tie
    inside a class goes to the least key of the text. Null texts are copies of empty ones; a null id stays only where
    its class has no other. Empty tables stay empty; columns stay whatever their names.
    """
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one a source's budget ends in is cut to the words taken.

    Documents that labels call good are drawn first more often, bad ones less; without labels all weigh the same. Null
    sources are one source, the last; null and blank texts have no words and go; ties and repeated rows are drawn each by
    itself in the order of their hashed keys; an empty table stays empty.
    """
    try:
        quality = label_quality(table(spark, sf_dir, "labels"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        quality = None
    return cut_to_mix(docs, mix_sources(docs, quality=quality, plain_quality=2.0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. Null texts are empty and have the end token alone; repeated rows and ties are
    packed each by itself; null ids stay null; an empty table gives no rows."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", identify_language), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: None: neither a trained model nor classes of linked documents are SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
