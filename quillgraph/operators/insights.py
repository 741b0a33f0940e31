"""Shares by period, trends, stakeholder views and headline figures, each for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import DEFAULT, Config, Stakeholder
from ..shared import spread, written


def with_period(reviews: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return reviews.withColumn("period", F.date_format("created_at", config.period))


def valid_periods(reviews: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(period, total) of periods with enough reviews."""
    return with_period(reviews, config).groupBy("period").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= config.min_period_reviews)


def trend_class(early: Column, late: Column, n: Column, config: Config = DEFAULT) -> Column:
    change = (late - early) * 100
    enough = lambda sign: (sign * change >= config.min_change_pp) & (sign * (late - early) >= config.min_change_rel * early)
    return F.when(early.isNull() | (n < config.min_trend_reviews), "too few reviews").when(enough(1), "rising").when(enough(-1), "falling").otherwise("stable")


def shares(keyed: DataFrame, reviews: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(key, period, n, share) of keyed (key, review_id): distinct reviews over the period's total, 0 where there are none."""
    dated = with_period(reviews, config).select("review_id", "period")
    periods = valid_periods(reviews, config)
    # A key's periods come from one row with all of them: at most a few hundred.
    all_periods = periods.agg(F.array_sort(F.collect_list(F.struct("period", "total"))).alias("periods")).first()["periods"]
    pairs = written(spread(keyed.select("key", "review_id"), "review_id").distinct(), "pairs")
    counted = spread(pairs, "review_id").join(dated, "review_id").groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*(F.struct(F.lit(p["period"]).alias("period"), F.lit(p["total"]).alias("total")) for p in all_periods)) if all_periods else F.array().cast("array<struct<period:string,total:bigint>>")
    keys = pairs.select("key").distinct().select("key", F.explode(grid).alias("p")).select("key", "p.period", "p.total")
    return keys.join(counted, ["key", "period"], "left").select("key", "period", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def trends(keyed: DataFrame, reviews: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(key, n_reviews, early_share, late_share, change_pp, trend) over the first and last periods."""
    order = Window.partitionBy("key")
    placed = shares(keyed, reviews, config).withColumns({"first": F.row_number().over(order.orderBy("period")), "last": F.row_number().over(order.orderBy(F.desc("period")))})
    both = placed.groupBy("key").agg(F.sum("n").alias("n_reviews"), F.avg(F.when(F.col("first") <= config.window, F.col("share"))).alias("early_share"), F.avg(F.when(F.col("last") <= config.window, F.col("share"))).alias("late_share"))
    return both.select("key", "n_reviews", "early_share", "late_share", ((F.col("late_share") - F.col("early_share")) * 100).alias("change_pp"), trend_class(F.col("early_share"), F.col("late_share"), F.col("n_reviews"), config).alias("trend"))


def interest_trends(weights: DataFrame, interests: DataFrame, reviews: DataFrame, level: str, config: Config = DEFAULT) -> DataFrame:
    keyed = weights.where(F.col("level") == level).select(F.col("interest_id").alias("key"), "review_id")
    rates = interests.select(F.col("interest_id").alias("key"), "pct_negative_reviews")
    found = trends(keyed, reviews, config).join(rates, "key")
    return found.withColumnRenamed("key", "interest_id")


def of_stakeholder(mentions: DataFrame, s: Stakeholder) -> DataFrame:
    if s.categories is not None:
        mentions = mentions.where(F.col("category").isin(*s.categories))
    return mentions.where(F.col("sentiment") == s.sentiment) if s.sentiment else mentions


def _by_stakeholder(mentions: DataFrame, reviews: DataFrame, stakeholders) -> DataFrame:
    """Mentions of present reviews once for each stakeholder that they concern, in one pass."""
    fits = []
    for s in stakeholders:
        fit = F.lit(True) if s.categories is None else F.col("category").isin(*s.categories)
        fits.append(F.when(fit & ((F.col("sentiment") == s.sentiment) if s.sentiment else F.lit(True)), F.lit(s.name)))
    met = spread(mentions, "review_id").join(reviews.select("review_id", "stars", "source_group", "language"), "review_id")
    return met.withColumn("stakeholder", F.explode(F.array_compact(F.array(*fits))))


def stakeholder_metrics(mentions: DataFrame, reviews: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per stakeholder: reviews, share, mean stars and organic share over all periods, and the trend over valid ones."""
    own = _by_stakeholder(mentions, reviews, config.stakeholders)
    single = own.select("stakeholder", "review_id", "stars", "source_group").distinct()
    total = reviews.count()
    stats = single.groupBy(F.col("stakeholder").alias("key")).agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("stars").alias("avg_stars"), F.avg((F.col("source_group") == "organic").cast("double")).alias("organic_share"))
    moved = trends(own.select(F.col("stakeholder").alias("key"), "review_id"), reviews, config).withColumnRenamed("n_reviews", "n_reviews_trend")
    return stats.join(moved, "key").select(F.col("key").alias("stakeholder"), "n_reviews", (F.col("n_reviews") / max(total, 1)).alias("share_of_reviews"), "avg_stars", "organic_share", "n_reviews_trend", "early_share", "late_share", "change_pp", "trend")


def stakeholder_entities(mentions: DataFrame, reviews: DataFrame, hubs: DataFrame, config: Config = DEFAULT, k: int = 8) -> DataFrame:
    """The k entities of most mentions for each stakeholder, hubs left out."""
    own = _by_stakeholder(mentions, reviews, config.stakeholders).join(hubs, "entity_id", "left_anti")
    # First by review, where the rows lie by the join: one row a review and entity goes into the few groups' partial sums.
    single = own.groupBy("stakeholder", "entity_id", "review_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars"), F.count("stars").alias("n_stars"))
    counted = single.groupBy("stakeholder", "entity_id").agg(F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_reviews"), (F.sum("stars") / F.sum("n_stars")).alias("avg_stars"))
    rank = F.row_number().over(Window.partitionBy("stakeholder").orderBy(F.desc("n_mentions"), "entity_id"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def stakeholder_quotes(mentions: DataFrame, reviews: DataFrame, hubs: DataFrame, config: Config = DEFAULT, first_language: str = "en", entities: int = 4, k: int = 3) -> DataFrame:
    """Up to k quotes for each stakeholder from its top entities: the first language first, then few stars; one a review, then one an entity."""
    top = stakeholder_entities(mentions, reviews, hubs, config, entities).select("stakeholder", "entity_id")
    own = _by_stakeholder(mentions, reviews, config.stakeholders).join(top, ["stakeholder", "entity_id"]).where("trim(coalesce(evidence, '')) <> ''")
    order = [(F.col("language") != first_language), F.col("stars"), F.col("review_id"), F.col("entity_id"), F.col("evidence")]
    for keys in (["stakeholder", "review_id"], ["stakeholder", "entity_id"]):
        own = own.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank = 1")
    place = F.row_number().over(Window.partitionBy("stakeholder").orderBy(*order))
    return own.withColumn("rank", place).where(F.col("rank") <= k).select("stakeholder", "rank", "review_id", "entity_id", "stars", "language", "evidence")


def requests(relations: DataFrame, k: int = 8) -> DataFrame:
    return relations.where("predicate = 'REQUESTS'").orderBy(F.desc("weight"), "source_id", "target_id").limit(k).select("source_id", "target_id", "weight")


def causes(relations: DataFrame, entity_ids: DataFrame, hubs: DataFrame, not_sources: DataFrame, k: int = 8) -> DataFrame:
    """The heaviest causal relations that touch the given entities other than hubs."""
    wanted = entity_ids.select("entity_id").distinct().join(hubs, "entity_id", "left_anti")
    causal = relations.where("predicate in ('CAUSED_BY', 'LEADS_TO')").join(not_sources.select(F.col("entity_id").alias("source_id")), "source_id", "left_anti")
    by_source = causal.join(wanted.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi").select("source_id", "predicate", "target_id", "weight")
    by_target = causal.join(wanted.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi").select("source_id", "predicate", "target_id", "weight")
    met = by_source.unionByName(by_target).distinct().orderBy(F.desc("weight"), "source_id", "predicate", "target_id").limit(k)
    return met.select("source_id", "predicate", "target_id", "weight", F.concat_ws(" ", "source_id", F.lower(F.replace("predicate", F.lit("_"), F.lit(" "))), "target_id").alias("text"))


def channel_periods(reviews: DataFrame, channels: tuple[str, ...] = ("invited", "organic", "other"), config: Config = DEFAULT) -> DataFrame:
    """Mean stars by period and channel, one column a channel."""
    dated = with_period(reviews, config).join(valid_periods(reviews, config).select("period"), "period", "left_semi")
    return dated.groupBy("period").pivot("source_group", list(channels)).agg(F.avg("stars"))


def channel_stats(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("source_group").agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("stars").alias("avg_stars"), F.avg((F.col("stars") == 1).cast("double")).alias("pct_one_star"))


def negative_drivers(trended: DataFrame, k: int = 5) -> DataFrame:
    """Interests by estimated negative reviews: those of valid periods times the share over all."""
    count = F.floor(F.col("n_reviews") * F.col("pct_negative_reviews") + 0.5).cast("long")
    return trended.select("interest_id", "n_reviews", count.alias("negative_reviews")).orderBy(F.desc("negative_reviews"), "interest_id").limit(k)


def headline(reviews: DataFrame, interests: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of figures."""
    made = reviews.agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("stars").alias("avg_stars"), F.avg((F.col("stars") <= 2).cast("double")).alias("pct_negative"), F.avg((F.col("source_group") == "organic").cast("double")).alias("organic_share"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    counts = interests.where("level = 'macro'").count(), entities.count()
    return made.select("*", F.lit(counts[0]).cast("long").alias("n_macro"), F.lit(counts[1]).cast("long").alias("n_entities"))


def badge(trend: Column, sentiment: Column) -> Column:
    moving = trend.isin("rising", "falling") & sentiment.isNotNull()
    return F.when(~F.coalesce(moving, F.lit(False)), "flat").when((trend == "rising") == (sentiment == "positive"), "good").otherwise("bad")


def interest_sentiment(weights: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of each macro interest by stars as negative, neutral, positive."""
    mood = F.when(F.col("stars") <= 2, "negative").when(F.col("stars") == 3, "neutral").otherwise("positive")
    met = weights.where("level = 'macro'").join(reviews.select("review_id", "stars"), "review_id")
    return met.groupBy("interest_id", mood.alias("mood")).agg(F.count(F.lit(1)).alias("n"))


def filtered(reviews: DataFrame, stars=None, sources=None, languages=None) -> DataFrame:
    """Reviews of the given values; None for all."""
    for column, values in (("stars", stars), ("source_group", sources), ("language", languages)):
        if values is not None:
            reviews = reviews.where(F.col(column).isin(*values))
    return reviews


def period_matrix(shared: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """shares as one row a key and one column a period; periods, if known, save a pass that looks for them."""
    return shared.groupBy("key").pivot("period", periods).agg(F.first("share"))
