"""A corpus pipeline of five stages; each reads what the stage before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statspark.llm import decontam, packing, pii, quality, simhash, store
from statspark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learnt from ``labels``, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more): the one of the least doc_id."""
    return simhash.keep_one(docs, k=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars to match."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; ids as their CRC-32."""
    return packing.digest(packing.pack_documents(docs, tokenizer_path()))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The model, the connected components and the tokenizer are beyond SQL; tests/llm/test_pipeline.py compares every stage and the whole with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``, each to the written result of the one before; scratch tables of a stage go once it is written."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with store.scratch(spark) as kept:
            kept.append(store.table(stage(spark, out, sf_dir), name))
        store.drop(out)
        out = kept[0]
    return STAGES[-1][1](spark, out, sf_dir)
