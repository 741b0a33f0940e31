"""Extraction of aspects and relations behind an interface; the default works offline from a word list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, truncate_text
from ..plans.config import CATEGORIES, DEFAULT, PREDICATES, SENTIMENTS, Config

SCHEMA = "aspects array<struct<aspect:string,category:string,opinion:string,sentiment:string,evidence:string>>, triplets array<struct<subject:string,predicate:string,object:string,sentiment:string>>, overall_sentiment string, is_about_brand boolean"
# Fixed values of the offline extractor: stems and their categories, words of mood.
STEMS = {"remov": "review_moderation", "delet": "review_moderation", "fake": "fake_reviews", "scam": "scam_fraud", "fraud": "scam_fraud", "support": "customer_support", "verif": "account_verification", "account": "account_verification", "email": "emails_notifications", "easy": "ease_of_use", "simple": "ease_of_use", "check": "research_before_buying", "honest": "trust_credibility", "trust": "trust_credibility", "pric": "business_tools_pricing", "token": "account_verification", "password": "account_verification"}
GOOD = ("good", "great", "easy", "helpful", "honest", "excellent", "simple")
BAD = ("bad", "fake", "scam", "fraud", "removed", "deleted", "stupid", "idiot", "trash", "scum", "worthless", "moron", "loser", "clown")


def cache_key(id_: Column, version: str, model: str) -> Column:
    return F.concat_ws("|", id_.cast("string"), F.lit(version), F.lit(model))


def message(header: dict[str, Column], text: Column, most: int | None = None) -> Column:
    """A header line for each field, an empty line, the text."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(""))) for name, value in header.items()]
    return F.concat_ws("\n", *lines, F.lit(""), truncate_text(text, most) if most else text)


def missing(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows of wanted without a cached answer."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def latest(cache: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    return cache.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rank = 1").drop("rank")


def parsed(raw: Column) -> Column:
    """JSON as an extraction; null if it isn't one."""
    return F.from_json(raw, SCHEMA)


def capped(extraction: Column, config: Config = DEFAULT) -> Column:
    """At most so many aspects and triplets, of known categories, predicates and sentiments."""
    known = lambda values, v: F.coalesce(v.isin(*values), F.lit(False))
    aspects = F.filter(extraction["aspects"], lambda a: known(CATEGORIES, a["category"]) & known(SENTIMENTS, a["sentiment"]))
    triplets = F.filter(extraction["triplets"], lambda t: known(PREDICATES, t["predicate"]) & known(SENTIMENTS, t["sentiment"]))
    return F.when(extraction.isNotNull(), F.struct(F.slice(aspects, 1, config.max_aspects).alias("aspects"), F.slice(triplets, 1, config.max_triplets).alias("triplets"), extraction["overall_sentiment"].alias("overall_sentiment"), extraction["is_about_brand"].alias("is_about_brand")))


def offline(texts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(ids..., extraction) from a word list: each listed stem in the text is an aspect, with the words around it as evidence."""
    words = tokens(F.lower(F.coalesce(F.col("text"), F.lit(""))))
    mood = lambda w: F.when(F.arrays_overlap(w, F.array(*map(F.lit, BAD))), "negative").when(F.arrays_overlap(w, F.array(*map(F.lit, GOOD))), "positive").otherwise("neutral")
    stems = F.create_map(*(F.lit(x) for pair in STEMS.items() for x in pair))
    half = config.evidence_words // 2

    def aspect(k: Column) -> Column:
        near = F.slice("w", F.greatest(k - half + 1, F.lit(1)), F.lit(config.evidence_words))
        stem = F.filter(F.map_keys(stems), lambda s: F.startswith(F.get("w", k), s))
        return F.struct(F.get("w", k).alias("aspect"), stems[F.get(stem, 0)].alias("category"), F.get("w", k + 1).alias("opinion"), mood(near).alias("sentiment"), F.array_join(near, " ").alias("evidence"))

    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), lambda k: F.coalesce(F.get("w", k), F.lit("")).rlike("^(?:" + "|".join(STEMS) + ")"))
    found = texts.withColumn("w", words).withColumn("aspects", F.transform(F.slice(at, 1, config.max_aspects), aspect))
    relation = lambda a: F.struct(F.lit(config.brand.name.lower()).alias("subject"), F.when(a["sentiment"] == "negative", "HAS_ISSUE").when(a["sentiment"] == "positive", "PRAISES").otherwise("USED_FOR").alias("predicate"), a["aspect"].alias("object"), a["sentiment"].alias("sentiment"))
    whole = F.struct("aspects", F.transform(F.slice("aspects", 1, config.max_triplets), relation).alias("triplets"), mood(F.col("w")).alias("overall_sentiment"), F.array_contains("w", config.brand.name.lower()).alias("is_about_brand"))
    return found.withColumn("extraction", F.when(F.size("w") > 0, whole)).drop("w", "aspects")


def extract(reviews: DataFrame, cache: DataFrame | None, extractor: Callable[[DataFrame], DataFrame], key: str = "review_id", order: str | None = None) -> DataFrame:
    """One answer a review: cached ones, the last by `order` (without it the largest), and the extractor's for the rest. A null extraction is a failure, is never taken from the cache and is asked for anew."""
    if cache is None:
        return extractor(reviews).select(key, "extraction")
    known = cache.where("extraction is not null")
    best = F.max_by("extraction", F.struct(order, "extraction")) if order else F.max("extraction")
    old = reviews.select(key).join(known.groupBy(key).agg(best.alias("extraction")), key)
    return old.unionByName(extractor(missing(reviews, known, key)).select(key, "extraction"))
