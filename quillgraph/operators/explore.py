"""Exploration of texts: censuses, themes, distinctive terms, spelling candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, nfkc_casefold, strip_accents, tokens
from ..shared import written
from . import graph

# The themes' patterns.
THEMES = {
    "review removed / deleted": r"\bremov|\bdelet|took down|taken down",
    "review flagged / reported": r"\bflag|\breport",
    "fake reviews": r"\bfake|\bbought review|paid review|\bgenuine",
    "scam / fraud": r"\bscam|\bfraud",
    "business side (as a company)": r"\bour (?:business|company|customers)|\bmy (?:business|company)\b",
    "account / verification": r"\baccount|\bverif",
    "harass / threat / extort": r"harass|threat|extort|blackmail",
    "easy / simple to use": r"\beasy|\bsimple|\buser.friendly",
    "helpful / useful": r"\bhelpful|\buseful|\bhelps? me",
    "trust / honest / reliable": r"\breliab|\bhonest|\btrustworthy|\btransparen",
    "check before buying": r"before (?:i |you )?(?:buy|purchas|order|shop)|check(?:ing)? (?:a |the )?(?:company|reviews)",
}
NOISE = {
    "url": r"https?://[^ \n]+|www\.[^ \n]+", "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+", "hashtag": r"(?:^|[^A-Za-z0-9_])#[A-Za-z0-9_]+", "phone": r"\+?[0-9][0-9 -]{7,}[0-9]",
    "date": r"(?:^|[^0-9])[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}(?:[^0-9]|$)", "money": r"[£$€] ?[0-9]|[0-9] ?(?:€|eur|usd)", "number": r"(?:^|[^\p{L}\p{N}])[0-9]+(?:[^\p{L}\p{N}]|$)",
}
PUNCTUATION = {"quotes": "[\"“”]", "ellipsis": r"\.\.\.|…", "exclaimed": "!!", "dashes": "[–—]| - ", "starred": r"\*\*\*"}


def lower_words(text: Column) -> Column:
    return tokens(F.lower(F.coalesce(text, F.lit(""))))


def words_of(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per word occurrence."""
    return docs.select(*keep, F.explode(lower_words(F.col("text"))).alias("word"))


def led(pattern: str) -> str:
    """The pattern behind a look at the next character, where each alternative begins with a plain letter: most places of a text then need one step, not a try of all alternatives."""
    starts = [re.match(r"(?:\\b|\(\?:)*([a-z])(?![?*{])", one) for one in pattern.split("|")]
    return f"(?=[{''.join(sorted({m[1] for m in starts}))}])(?:{pattern})" if all(starts) else pattern


def shares_of(docs: DataFrame, patterns: dict[str, str], group: Column, flags: str = "(?i)") -> DataFrame:
    """(pattern, grp, n, share) of texts that match, from one pass."""
    hit = [F.struct(F.lit(name).alias("pattern"), F.coalesce(F.col("text"), F.lit("")).rlike(flags + led(p)).alias("hit")) for name, p in patterns.items()]
    long = docs.select(group.alias("grp"), F.explode(F.array(*hit)).alias("m"))
    return long.groupBy(F.col("m.pattern").alias("pattern"), "grp").agg(F.count_if("m.hit").alias("n"), F.avg(F.col("m.hit").cast("double")).alias("share"))


def distinctive(docs: DataFrame, positive: Column, least: int = 10, k: int = 15) -> DataFrame:
    """Words of the largest and the smallest smoothed log odds between two groups of texts (by texts that hold them)."""
    held = docs.select(positive.alias("side"), F.explode(F.array_distinct(lower_words(F.col("text")))).alias("word"))
    counts = held.groupBy("word").agg(F.count_if("side").alias("a"), F.count_if(~F.col("side")).alias("b")).where(F.col("a") + F.col("b") >= least)
    sizes = docs.agg(F.count_if(positive).alias("na"), F.count_if(~positive).alias("nb")).first()
    odds = counts.withColumn("log_odds", F.log((F.col("a") + 0.5) / (sizes["na"] + 1)) - F.log((F.col("b") + 0.5) / (sizes["nb"] + 1)))
    top = odds.orderBy(F.desc(F.round("log_odds", 9)), "word").limit(k).withColumn("end", F.lit("top"))
    return top.unionByName(odds.orderBy(F.round("log_odds", 9), "word").limit(k).withColumn("end", F.lit("bottom")))


def bigrams(docs: DataFrame, least: int = 5) -> DataFrame:
    words = lower_words(F.col("text"))
    pairs = docs.select(words.alias("w")).select(F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda k: k < F.size("w")), lambda k: F.concat_ws(" ", F.get("w", k - 1), F.get("w", k)))).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def spelling_candidates(docs: DataFrame, rare: int = 2, often: int = 20, size: int = 5) -> DataFrame:
    """(rare_word, frequent_word) at one edit: words of plain letters that share a form with one letter left out, then checked."""
    counted = words_of(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= size) & F.col("word").rlike("^[a-z]+$"))
    forms = lambda df, name: df.select(F.col("word").alias(name), F.explode(F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.substring("word", F.lit(1), k - 1), F.substring("word", k + 1, F.length("word"))))))).alias("form"))
    low, high = forms(counted.where(F.col("n") <= rare), "rare_word"), forms(counted.where(F.col("n") >= often), "frequent_word")
    met = low.join(high, "form").select("rare_word", "frequent_word").distinct()
    swapped = lambda k: F.concat(F.substring("rare_word", F.lit(1), k - 1), F.substring("rare_word", k + 1, F.lit(1)), F.substring("rare_word", k, F.lit(1)), F.substring("rare_word", k + 2, F.length("rare_word")))
    neighbours = F.exists(F.sequence(F.lit(1), F.length("rare_word") - 1), lambda k: swapped(k) == F.col("frequent_word"))
    return met.where((F.levenshtein("rare_word", "frequent_word") == 1) | neighbours)


def case_forms(docs: DataFrame, least: int = 3) -> DataFrame:
    """Words written in several cases."""
    raw = docs.select(F.explode(tokens(F.coalesce("text", F.lit("")))).alias("raw"))
    return raw.groupBy(F.lower("raw").alias("word")).agg(F.countDistinct("raw").alias("forms"), F.count(F.lit(1)).alias("n")).where(F.col("forms") >= least)


def document_frequency(docs: DataFrame, least: float = 0.02) -> DataFrame:
    total = docs.count()
    held = docs.select(F.explode(F.array_distinct(lower_words(F.col("text")))).alias("word"))
    return held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", "n", (F.col("n") / max(total, 1)).alias("share")).where(F.col("share") >= least)


def accent_collisions(docs: DataFrame) -> DataFrame:
    """Words of one language that differ by accents only."""
    held = words_of(docs, "lang").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return held.withColumn("bare", strip_accents("word")).groupBy("lang", "bare").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n")).where("forms > 1")


def vocabulary_funnel(docs: DataFrame) -> DataFrame:
    """Distinct words by language: as written, lower case, folded, without accents."""
    raw = docs.select("lang", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("raw")).distinct()
    return raw.withColumns({"folded": nfkc_casefold("raw"), "bare": strip_accents(F.lower("raw"))}).groupBy("lang").agg(F.count(F.lit(1)).alias("raw"), F.countDistinct(F.lower("raw")).alias("lower"), F.countDistinct("folded").alias("folded"), F.countDistinct("bare").alias("bare"))


def term_communities(docs: DataFrame, hierarchy, config, per_text: int = 6, low: int = 3) -> DataFrame:
    """Communities of the terms that stand together in texts: each text's terms of the largest tf-idf, however many texts hold them."""
    total = docs.count()
    counts = words_of(docs, "doc_id").where(F.length("word") >= 5).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    # Counting tf keeps both uses of counts alike, so that texts are split once.
    df = counts.groupBy("word").agg(F.count_if(F.col("tf") > 0).alias("df")).where(F.col("df") >= low)
    score = F.round(F.col("tf") * F.log(F.lit(float(max(total, 1))) / F.col("df")), 9)
    best = counts.join(df, "word").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(score), "word"))).where(F.col("rank") <= per_text)
    mentions = written(best.select(F.col("doc_id").alias("review_id"), F.col("word").alias("entity_id"), F.lit("neutral").alias("sentiment")), "terms")
    none = mentions.limit(0).select("review_id", F.col("entity_id").alias("subject_id"), F.lit("").alias("predicate"), F.col("entity_id").alias("object_id"), "sentiment")
    edges = written(graph.edges(mentions, none), "edges")
    return hierarchy(mentions.select("entity_id").distinct(), edges.select("src", "dst", "weight"), config.macro_resolution, config.micro_resolution)
