"""A training-corpus pipeline of five stages; each is written as Parquet and read again by the next.

Every stage works on all that its predecessor kept, and its decision takes effect: rejected,
repeated and contaminated documents go, secrets are masked in the texts that stay, and what is left is
packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import cotrain, decontaminate, minhash, packing, secretscan
from frameloom.llm.shared import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good and not toxic.

    Null and empty texts go, however a document's other columns look; a null source or language is a value of its own and a
    row with a null doc_id teaches nothing but is judged.  Long texts are judged whole, repeated rows alike.  No labels (or
    none of a class) filter nothing by that target; no documents give none.  Further columns pass, whatever their names.
    """
    return cotrain.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near copies (five words, similarity 0.8).

    Null and empty texts and rows with a null doc_id are in no group and stay.  Ties go to the least doc_id; rows that repeat
    a doc_id stay or go together.  Long texts are compared whole; no documents give none.  Further columns pass, whatever
    their names.
    """
    return minhash.without_near_duplicates(docs, minhash.Similarity(k=5, num=80, den=100))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs.

    Null and empty texts stay, and so do rows with a null in any other column if their text is clean.  Long texts are searched
    whole, repeated rows alike; null or empty items match nothing.  No documents give none.  Further columns pass, whatever
    their names.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind in brackets, n_chars set to the new length.

    A null text stays null with its n_chars; an empty one stays empty.  Long texts are masked whole, repeated rows alike; no
    documents give none.  Further columns pass, whatever their names.
    """
    return secretscan.redact(docs, "text", "n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences.

    A null or empty text is its end token alone; a long one is cut into as few pieces as it needs.  Repeated rows are packed
    each for itself; ties go by place in the table.  No documents give none.  Further columns are left out.
    """
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Classifier, sketches and tokenizer aren't SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; their tables go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/frameloom/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}-{name}")
    return docs
