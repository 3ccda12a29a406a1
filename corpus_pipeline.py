"""A training-corpus pipeline: quality rules, near-dedup, decontamination, secret scans, packing.

Each stage takes what its predecessor kept, as Parquet, and its decisions take effect. All but the
last return the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, packing, quality, secrets, simhash
from tidelog.llm.common import shared_folder
from tidelog.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays.

    Candidates come by op8's fingerprints, blocks and Hamming check, and by bands for what differs
    in more bits.
    """
    return simhash.keep_one_of_each(docs, shingle=5, distance=3, spare=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten benchmark words go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and the sequences that they fill."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", pack),
]

#: SimHash components and BPE ids aren't expressible; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and reread.

    A stage's files go once those of the next one are written; the last one's stay.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{n}")
        docs = spark.read.parquet(f"{root}/{n}")
        if n:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
