"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.common import ensure_checkpoint_dir, table
from riskweave.llm.langid import stage_langid
from riskweave.llm.mixing import stage_mix
from riskweave.llm.packing import stage_pack
from riskweave.llm.simhash import stage_simhash
from riskweave.llm.toxicity import stage_toxicity

STAGES = [
    ("language_id", stage_langid),
    ("toxicity", stage_toxicity),
    ("simhash_near_dedup", stage_simhash),
    ("mixing", stage_mix),
    ("best_fit_packing", stage_pack),
]

#: Trained models and fingerprints are beyond SQL; the pipeline is tested against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                remove(spark, before)
            before = path
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stage's folder; the next stage's is written, and nothing reads this one any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
