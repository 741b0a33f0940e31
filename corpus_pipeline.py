"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Stages whose rows pass through Python as they are made write them themselves, as only there texts go in small batches:
at Spark's defaults the Python workers, Arrow's buffers and the heap keep several times as much for the rest of the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, decontaminate, exact_dedup, minhash, packing, quality
from quillgraph.llm.common import small_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    with small_batches(spark):
        model = quality.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
        return written(quality.kept(docs, model), "quality-classifier")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item: for training, one item is one too many (op7's query reports two or more, as its contract says)."""
    with small_batches(spark):
        return written(decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"), min_items=1), "benchmark-decontamination")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    return packing.packed(packing.pieces(docs, bpe.default_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: Stages that have written what they return.
WRITTEN = {quality_stage, benchmark_stage}

#: The classifier, the consistent samples and the tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = made if stage in WRITTEN else written(made, name.replace(" ", "-"))
    return written(STAGES[-1][1](spark, docs, sf_dir), "packed")
