"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and is written as Parquet before
the next one reads it, so a lost executor costs at most one stage's tasks. All stages but the last return the columns
of ``documents``. A stage's table goes when the next one's is written; that of the last but one stays in the shared
folder, as the result reads it.

toxicity          rows scored toxic go
near_duplicates   one row of each class of near duplicates stays
repeats           strings of 100 bytes that occur earlier are cut out of the texts; n_chars follows; every row stays
decontamination   rows that hold a benchmark item, also an edited one, go
packing           the texts' tokens in sequences of at most 4096
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.llm.common import documents, remove, shared_folder
from rippletrace.llm.decontaminate import without_leaks
from rippletrace.llm.jaccard_join import one_of_each_class
from rippletrace.llm.packing import harmonic_packing
from rippletrace.llm.repeats import without_repeats
from rippletrace.llm.toxicity import is_held_out, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), is_held_out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if "n_chars" not in docs.columns:
        return without_repeats(docs)
    count = "n_removed"
    while count in docs.columns:
        count += "_"
    out = without_repeats(docs, count)
    follows = F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", follows).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmonic_packing(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("packing", packing)]

#: Training, prefix-free parsing and the tokenizer can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline_{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
