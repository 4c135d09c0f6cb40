"""A training corpus from documents: five stages, each reading what the one before it has written.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of
documents. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again, so a lost executor costs part of one stage;
what a stage has stored goes when its rows are written, the tables between the stages when the last one is done.

Every row is a document of its own: repeated rows, and rows that share a doc_id or have none, are judged by their texts. Documents whose lines
all stay elsewhere go with the line dedup. An empty table gives no rows; extra columns, of whatever names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratamesh.llm import bpe, lines, ngramjoin, rules, winnowing
from stratamesh.llm.storage import Scratch, stored

#: Words of a shingle and Jaccard percentage from which documents are near copies; op9_ngram_join has its own.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return rules.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal lines one stays in the corpus; n_chars follows the text; documents left without text go."""
    return lines.deduplicated(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id."""
    return ngramjoin.deduplicated(docs, k=SHINGLE, percent=PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages beyond the limit go."""
    return winnowing.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text they decode to."""
    return bpe.encoded_rows(docs, bpe.vocabulary())


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", tokens)]

#: Fuzzy lines and tokens are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as tables:
        for name, stage in STAGES:
            with Scratch(spark) as own:
                docs = own.keep(stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower()))
        tables.keep(docs)
    return docs
