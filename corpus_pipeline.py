"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents:

1. toxicity: documents at or above the model's threshold go;
2. near_dedup: one document of each group of near copies stays;
3. decontaminate: documents that hold a benchmark item's passage go;
4. pii: entities and terms that disclose them are masked in `text`, and `n_chars` follows;
5. pack: token pieces with their bins.

A null text passes the first four stages unchanged.  A row with a null id is judged by its text in toxicity, and may go; it is no copy and no
leak, so near_dedup and decontaminate keep it; pii masks it like any other.  Repeated rows are one document after near_dedup.  Each stage's tables and
its predecessor's result are deleted once its own result is written; the last result stays in the shared folder, since the returned DataFrame reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet import ship
from quillet.llm import decontaminate as decontamination
from quillet.llm import disclosure, packing, simhash
from quillet.llm import toxicity as mil
from quillet.llm.common import delete, fresh_path, scope


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship.ensure(spark)
    return mil.drop_toxic(docs, mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship.ensure(spark)
    return simhash.drop_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship.ensure(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship.ensure(spark)
    clean = docs.withColumn("text", disclosure.sanitised_text(disclosure.fit(docs), docs["text"]))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship.ensure(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("pack", pack)]

#: The fitted model, fingerprints and best fit can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}", keep=True)
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
