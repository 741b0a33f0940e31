"""Cleaned reviews: one projection of column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.config import DEFAULT, Config


def reviews_clean(bronze: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Cleaned title and body, the text for extraction, and whether it has content."""
    groups = F.create_map(*(F.lit(x) for pair in config.source_groups for x in pair))
    cleaned = bronze.withColumns({"title_clean": T.canonical_brand(T.normalize_text(F.col("title")), config.brand), "body_clean": T.canonical_brand(T.normalize_text(F.col("text")), config.brand)})
    merged = cleaned.withColumn("merged", T.merge_title(F.col("title_clean"), F.col("body_clean"))).withColumn("text_for_extraction", F.col("merged.text"))
    counted = merged.withColumn("n_words", T.n_words(F.col("text_for_extraction")))
    kept = [c for c in ("review_id", "created_at", "stars") if c in bronze.columns]
    return counted.select(*kept, "source", "language", F.coalesce(groups[F.col("source")], F.lit("other")).alias("source_group"), "title_clean", "body_clean", "text_for_extraction", F.col("merged.kept").alias("title_kept"), "n_words", (F.col("n_words") < config.low_content_words).alias("is_low_content"))


def informative(reviews: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return reviews.where(~F.col("is_low_content") & (F.col("n_words") >= config.min_words))
