"""Analysis tables: entity statistics, interests, weights of reviews in interests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import DEFAULT, Config
from ..shared import written
from .graph import bridge, touches


def entity_stats(entities: DataFrame, mentions: DataFrame, triplets: DataFrame, reviews: DataFrame, clusters: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Counts and means over all touches of each entity of the partition; means stay null without touches."""
    touched = touches(mentions, triplets).join(reviews.select("review_id", "stars"), "review_id", "left")
    stats = touched.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("mention_count"), F.countDistinct("review_id").alias("review_count"), F.avg("stars").alias("avg_stars"), F.avg((F.col("sentiment") == "negative").cast("double")).alias("pct_negative")
    )
    out = entities.join(stats, "entity_id", "left").join(clusters, "entity_id")
    if ranks is not None:
        out = out.join(ranks, "entity_id", "left").fillna({"pagerank": 0.0})
    return out.fillna({"mention_count": 0, "review_count": 0})


def interests(clusters: DataFrame, mentions: DataFrame, triplets: DataFrame, reviews: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per community of enough entities: macro ones, and micro ones that aren't all of their macro."""
    macro = clusters.where("macro_cluster >= 0").select("entity_id", F.lit("macro").alias("level"), F.col("macro_cluster").cast("string").alias("cluster"), F.lit(None).cast("string").alias("parent"))
    micro = clusters.where("macro_cluster >= 0").select("entity_id", F.lit("micro").alias("level"), F.col("micro_cluster").alias("cluster"), F.col("macro_cluster").cast("string").alias("parent"))
    # Written, so that Spark knows how small it is: a join of all touches by their few entities would put most of them into few tasks.
    members = written(macro.unionByName(micro), "members")
    sizes = members.groupBy("level", "cluster", "parent").agg(F.count(F.lit(1)).alias("n_entities")).where(F.col("n_entities") >= config.min_interest_entities)
    parents = sizes.where("level = 'macro'").select(F.col("cluster").alias("parent"), F.col("n_entities").alias("of"))
    kept = sizes.join(parents, "parent", "left").where("level = 'macro' or of is null or n_entities <> of").select("level", "cluster", "parent", "n_entities")
    touched = bridge(mentions, triplets, members).join(members.select("entity_id", "level", "cluster"), "entity_id").select("review_id", "level", "cluster").distinct()
    stats = touched.join(reviews.select("review_id", "stars"), "review_id").groupBy("level", "cluster").agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("stars").alias("avg_stars"), F.avg((F.col("stars") <= 2).cast("double")).alias("pct_negative_reviews"))
    found = kept.join(stats, ["level", "cluster"], "left").select(
        F.concat_ws("_", "level", "cluster").alias("interest_id"), "level", "cluster", F.when(F.col("level") == "micro", F.concat_ws("_", F.lit("macro"), "parent")).alias("parent_interest_id"), "n_entities", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), "avg_stars", "pct_negative_reviews"
    )
    # A few rows, which weights and trends read again.
    return written(found, "interests")


def review_weights(clusters: DataFrame, mentions: DataFrame, triplets: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of a review's entities in each kept interest of a level, among those in any kept interest of it."""
    long = clusters.select("entity_id", F.explode(F.array(F.struct(F.lit("macro").alias("level"), F.col("macro_cluster").cast("string").alias("cluster")), F.struct(F.lit("micro").alias("level"), F.col("micro_cluster").alias("cluster")))).alias("c")).select("entity_id", "c.level", "c.cluster")
    long = written(long.join(kept.select("level", "cluster", "interest_id"), ["level", "cluster"]).select("entity_id", "level", "interest_id"), "members")
    counts = bridge(mentions, triplets, long).join(long, "entity_id").groupBy("review_id", "interest_id", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("review_id", "interest_id", "level", (F.col("n") / F.sum("n").over(Window.partitionBy("review_id", "level"))).alias("weight"))


def primary_interests(weights: DataFrame) -> DataFrame:
    """Each review's heaviest macro interest; ties to the least id."""
    best = F.row_number().over(Window.partitionBy("review_id").orderBy(F.desc("weight"), "interest_id"))
    return weights.where("level = 'macro'").withColumn("rank", best).where("rank = 1").select("review_id", F.col("interest_id").alias("primary_macro_interest_id"))


def gold_reviews(reviews: DataFrame, mentions: DataFrame, weights: DataFrame) -> DataFrame:
    counted = mentions.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_aspects"))
    return reviews.join(counted, "review_id", "left").join(primary_interests(weights), "review_id", "left").fillna({"n_aspects": 0})


def quotes(mentions: DataFrame, entity_ids: DataFrame, k: int = 8) -> DataFrame:
    """k mentions for a summary: of frequent entities first, then by sentiment and review; one a review; blanks dropped last."""
    own = mentions.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi")
    own = own.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("entity_id")))
    first = F.row_number().over(Window.partitionBy("review_id").orderBy(F.desc("often"), "sentiment", "entity_id", "evidence"))
    return own.withColumn("rank", first).where("rank = 1").orderBy(F.desc("often"), "sentiment", "review_id").limit(k).where("trim(coalesce(evidence, '')) <> ''").select("review_id", "entity_id", "sentiment", "evidence")


def summaries(kept: DataFrame, stats: DataFrame, clusters: DataFrame, entities: int = 5) -> DataFrame:
    """A title, sentence and label for each interest from its most mentioned entities."""
    long = clusters.select("entity_id", F.explode(F.array(F.concat_ws("_", F.lit("macro"), "macro_cluster"), F.concat_ws("_", F.lit("micro"), "micro_cluster"))).alias("interest_id"))
    ranked = long.join(stats.select("entity_id", "name", "mention_count"), "entity_id").withColumn("rank", F.row_number().over(Window.partitionBy("interest_id").orderBy(F.desc("mention_count"), "name"))).where(F.col("rank") <= entities)
    names = ranked.groupBy("interest_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("key_entities"))
    label = F.when(F.col("pct_negative_reviews") > 0.6, "negative").when(F.col("pct_negative_reviews") < 0.25, "positive").otherwise("mixed")
    title = F.array_join(F.slice("key_entities", 1, 3), ", ")
    return kept.join(names, "interest_id", "left").select("interest_id", F.coalesce(title, F.concat(F.lit("Cluster "), "cluster")).alias("title"), F.format_string("%d reviews name %s.", "n_reviews", F.array_join("key_entities", ", ")).alias("summary"), label.alias("sentiment_label"), "key_entities")
