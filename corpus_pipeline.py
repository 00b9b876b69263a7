"""The training-corpus pipeline: stages applied in order to ``documents``, each one's rows written and read again.

1. toxicity: documents that the classifier marks as toxic go;
2. quality: documents above their language's perplexity limit go;
3. near-duplicates: one document of each group stays;
4. decontamination: words inside benchmark passages are cut out of the texts;
5. encoding: byte-level BPE ids of every document that is left.

All but the last return the columns of ``documents``. Null and empty texts pass
every stage (an empty text is no copy of another) and have no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontam, neardup, quality, store, toxicity


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document that is left."""
    del spark, sf_dir
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity.stage),
    ("quality", quality.stage),
    ("near-duplicates", neardup.stage),
    ("decontamination", decontam.stage),
    ("encoding", tokens),
]

#: Trained models, sketches and suffix arrays have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store.written(docs, f"stage-{number}-{name}")
            if before is not None:
                store.drop(before)
            before = docs
    return docs
