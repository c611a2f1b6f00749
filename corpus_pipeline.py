"""A training corpus from documents, in five stages.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``. Rows that repeat, also in all their
columns, are documents of their own to every stage but the second, which keeps one of them;
rows of one doc_id with different texts are different documents. Null ids, sources and labels
stay as they are, and an empty table goes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import language_id, mixing, packing, secret_scan, simhash
from tallyweave.llm._shared import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null text, or no letter in it) go.
    Ambiguous ones stay: they have a language, if not surely the one predicted."""
    model = language_id.train_on(docs)
    return docs.filter(language_id.prediction(docs["text"], model)["lang_pred"] != language_id.UNKNOWN)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays. Near copies
    are those of op 9: fingerprints of three-word shingles within 2 bits, linked in chains."""
    return simhash.keep_one(docs, spark)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, ``n_chars`` follows."""
    clean = docs.withColumn("text", secret_scan.without_secrets(docs["text"]))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them: never, once or twice."""
    return mixing.mixed_documents(docs, spark)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: its bucket and batch."""
    return packing.pack(docs, spark)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", remove_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: SQL can express neither the trained classifier nor XXH64; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = Scratch.opened()
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name, files_a_core=None)
        Scratch.release(*others)  # what the stage needed; its result is stored
    return STAGES[-1][1](spark, docs, sf_dir)
