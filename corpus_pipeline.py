"""A training-data pipeline in five stages; each one's documents are written as Parquet and read by the next.

1. toxicity: documents that the classifier chain rejects go;
2. near_duplicates: one document of each group stays;
3. decontamination: contaminated documents go;
4. surrogates: personal data in the texts is replaced (``n_chars`` follows);
5. packing: token ids of all documents that are left, placed in sequences.

Nulls, repeated rows and empty tables are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.decontamination import without_contaminated
from wayfare.llm.neardup import without_duplicates
from wayfare.llm.packing import pack_documents
from wayfare.llm.pii import with_surrogates
from wayfare.llm.tokens import vocabulary
from wayfare.llm.toxicity import toxicity
from wayfare.plans.scratch import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: f"documents' {c}" for c in docs.columns if c == "is_toxic" or c.startswith("p_")}  # named like the chain's results
    kept = toxicity(docs.withColumnsRenamed(own), _table(spark, sf_dir, "labels")).where("not is_toxic")
    return kept.drop(*own).withColumnsRenamed({new: old for old, new in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_duplicates(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_surrogates(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary(), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("packing", packing),
]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
