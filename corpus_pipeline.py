"""Corpus pipeline: five stages from raw documents to token ids, each written as Parquet and read by the next.

Defined cases: null and empty texts are empty documents, of which one stays after the near-dedup; rows of
one doc_id are documents of their own; further columns, whatever their names, stay as they are up to the last
stage, which returns doc_id, ids and digests; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ratebook.llm import bpe, decontaminate, lines, minhash, quality
from ratebook.llm.common import shielded, table
from ratebook.llm.queries import tokenizer
from ratebook.session import ensure_checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.5 or more)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = shielded(docs, ["doc_id", "text"])
    scored = quality.score(rows, model, "_score", "_predicted")
    return back(scored.where("_predicted = 1").drop("_score", "_predicted"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which nothing is left."""
    return lines.drop_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return minhash.drop_copies(docs, rare=float("inf"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and digests of the ids and of the bytes that they decode to."""
    return bpe.encode(docs.select("doc_id", "text"), *tokenizer(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep_text=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]

#: compression, weighted sampling and BPE aren't expressible in SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what lies between is written in the shared folder of the session."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
