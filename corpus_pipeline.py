"""The corpus pipeline: quality, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir); its rows are written and read again as the next one's docs.
SQL can express neither the classifier nor the fingerprints, so ORACLE_SQL is None; tests compare run()
with plain programs for each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import Scratch
from factloom.llm.mixing import repeat_rows
from factloom.llm.packing import pack_documents
from factloom.llm.quality import keep_good
from factloom.llm.secrets import mask_secrets
from factloom.llm.simhash import keep_first

STAGES = [
    ("quality", keep_good),
    ("near-duplicates", keep_first),
    ("secrets", mask_secrets),
    ("mixture", repeat_rows),
    ("packing", pack_documents),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, before = Scratch(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
