"""Deterministic stratified samples and modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_or_other(df: DataFrame, column: str, k: int) -> DataFrame:
    """df plus <column>_group: the value if it is one of the k most frequent (ties by value), else 'other'."""
    top = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k).select(F.col(column).alias("top_value"))
    return df.join(F.broadcast(top), df[column] == top["top_value"], "left").withColumn(f"{column}_group", F.coalesce("top_value", F.lit("other"))).drop("top_value")


def star_quotas(reviews: DataFrame, n: int) -> DataFrame:
    """(stars, quota) by largest remainders; the quotas add up to n, ties to fewer stars."""
    counted = reviews.groupBy("stars").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy(F.lit(0))
    parts = counted.withColumn("total", F.sum("count").over(whole)).select("stars", F.floor(F.lit(n) * F.col("count") / F.col("total")).alias("base"), (F.lit(n) * F.col("count") % F.col("total")).alias("rest"))
    rank = F.row_number().over(whole.orderBy(F.desc("rest"), "stars"))
    return parts.select("stars", (F.col("base") + (rank <= F.lit(n) - F.sum("base").over(whole)).cast("long")).alias("quota"))


def midpoint_ranks(pool: DataFrame, seed: int = 42, languages: int = 4) -> DataFrame:
    """pool plus lang_group, a random key that depends on review and seed only, and midpoint: the place in (stars, lang_group, source_group), from 0 to 1."""
    named = top_or_other(pool, "language", languages).withColumnRenamed("language_group", "lang_group")
    keyed = named.withColumn("key", F.substring(F.md5(F.concat_ws("-", F.col("review_id").cast("string"), F.lit(str(seed))).cast("binary")), 1, 13))
    own = Window.partitionBy("stars", "lang_group", "source_group")
    return keyed.withColumn("midpoint", (F.row_number().over(own.orderBy("key", "review_id")) - 0.5) / F.count(F.lit(1)).over(own))


def stratified_sample(reviews: DataFrame, pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of pool with the stars' mix of reviews, and inside each stars value that of languages and channels. All of pool if n is at least the number of reviews."""
    if n >= reviews.count():
        return pool
    ranked = midpoint_ranks(pool, seed).join(F.broadcast(star_quotas(reviews, n)), "stars")
    place = F.row_number().over(Window.partitionBy("stars").orderBy("midpoint", "key", "review_id"))
    return ranked.withColumn("place", place).where("place <= quota").drop("place", "quota", "midpoint", "key", "lang_group")


def modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the least, and its count."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).where("rank = 1").drop("rank")


def display_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows to look at, by the least MD5 of key and seed: the same on any engine and partitioning."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)
