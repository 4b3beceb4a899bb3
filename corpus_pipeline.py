"""A corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark passages, SentencePiece.

Each stage takes the documents its predecessor kept. The first three drop rows and leave
the columns as they are; the last gives, for each document that stayed, what its pieces
and their decoding are. Null texts count as empty in all stages; rows are judged one by
one, whatever ids they share; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytelode.llm import decontaminate, piece_transducer, simhash, toxicity
from bytelode.llm.common import fresh_dir, table
from bytelode.llm.queries import TOXIC_FROM, tokenizer_file, toxicity_model

#: Byte-pair pieces and compression lengths have no SQL form; the whole is tested against plain Python.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that score as toxic, by a model of the labels that are not held out. Empty texts stay; rows that repeat are judged alike."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir), TOXIC_FROM)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, of the least id (null ids last); texts without words are one group."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a passage of ``benchmark``. Texts without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: how many pieces its text has, their digest, and what they decode to."""
    return piece_transducer.encode_and_decode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
