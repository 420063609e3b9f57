"""From the table of documents to packed training sequences, in five stages.

Every stage takes what its predecessor kept, reread from Parquet, and all but the last return
the columns of ``documents``. The first four drop or change documents: toxic ones go, of near
copies one stays, secrets are masked, and the mix is brought to its target shares.

Defined results: without labels nothing is toxic, and an empty table gives no rows. Null and blank
texts are copies of each other, of which the smallest doc_id stays (nulls last). Rows with equal
ids and different texts all count as documents of their own, but are sampled together. Columns
beyond those of ``documents`` are carried along up to packing, whatever their names, except that
one named ``topic`` is a dimension of the mix. ``run`` deletes a stage's table when the next is
written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordgauge.llm import pu_toxicity, secret_scan, simhash_index, source_mixing, window_packing
from recordgauge.plans.scratch import discard, staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_index.one_per_component(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return window_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned scores, fingerprints and token ids have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        docs, path = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *before)
        before = [path]
    return docs
