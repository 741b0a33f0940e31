"""Reading reviews and gold tables, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "review_id string, created_date string, stars int, Title string, Text string, source string, language string"
GOLD = ("gold_reviews", "gold_aspect_mentions", "gold_entities", "gold_relations", "gold_interests", "gold_review_interests")


def bronze(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of a CSV file with a header, typed: UTC time, no null texts, one code for Norwegian."""
    raw = spark.read.schema(RAW).csv(path, header=True, multiLine=True, escape='"')
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select("review_id", "stars", empty("Title").alias("title"), empty("Text").alias("text"), "source", F.when(F.col("language") == "nb", "no").otherwise(F.col("language")).alias("language"), F.to_timestamp("created_date").alias("created_at"))


def save(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, names: tuple[str, ...] = GOLD) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def load_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if there else None


def json_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines (key, seq, ...): the last of each key, of equal seq the largest by all columns."""
    records = spark.read.schema(schema).json(path)
    last = records.groupBy("key").agg(F.max_by(F.struct(*records.columns), F.struct("seq", *(c for c in records.columns if c not in ("key", "seq")))).alias("record"))
    return last.select("record.*")


def append_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def graph_json(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines, kind first; weights to 3 places."""
    nodes = entities.select(F.to_json(F.struct(F.lit("node").alias("type"), *entities.columns)).alias("value"))
    links = edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), F.col("src").alias("source"), F.col("dst").alias("target"), F.round("weight", 3).alias("weight"), F.array_sort("kinds").alias("kinds"))).alias("value"))
    nodes.unionByName(links).write.mode("overwrite").text(path)
