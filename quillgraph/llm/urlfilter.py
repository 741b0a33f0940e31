"""URL verdicts from written rules, and from association rules mined by FP-growth where none fits.

Labelled urls become transactions: each suffix of the host, the words of host and path that aren't numbers, the
names of query parameters, and the label. FP-growth finds the frequent combinations; a rule "these tokens -> block"
stays if its support (a share of the labelled urls, and `min_count` of them), its confidence and the lower end of its confidence's
95 % interval (Wilson; `SURE`) reach their bounds and no rule over a part of its tokens is as confident. The interval keeps out
combinations that a few labels made by chance. Tokens that stand in exactly the same labelled urls are mined as
one, words before paths, queries and hosts, and the longest of these: this loses no rule, and a host's suffixes don't multiply the combinations.

FP-growth takes the urls of at most `MOST_ITEMS` such tokens, whose 2^k combinations it can hold. Tokens blocked too seldom for any rule
don't count. Urls of more are mined level by level instead, over the rows that hold each combination (`_levels`): every combination
that such a blocked url holds is counted in all urls, long and short, unless a part of it makes it needless: a part in
the same urls, or one that is always blocked. FP-growth's rules get the other long urls' counts added. So no token is dropped and all counts
are whole; many long urls that share most, but not all, of their tokens still have very many combinations, and all are counted.

Rules are a table. They match by an inverted index from their rarest token: the distinct urls that no written rule decides
look up their tokens there, by broadcast where the index has at most `SMALL` tokens and else by a shuffle, and only
the rules found are compared. Pruning uses the same index. Nothing of it is collected.

DataFrame functions only. Defined cases: null urls and urls without :// have an empty host and path and the method's
verdict on no tokens (allow); a very long url is taken whole; without labels nothing is mined and every url without a written rule
is allowed; a page whose labels disagree counts as blocked; repeated rows each get the answer; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, SURE, MOST_ITEMS, SMALL, CHUNK = 0.002, 5, 0.7, 0.5, 12, 200_000, 1000
BLOCK = "label=block"
#: Written rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A url with one of these words in its host is a labelled example of "block", whatever else is known of it.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "viagra")
RULE = "tokens array<string>, confidence double, support double"
COUNTED = "tokens array<string>, n long, bad long"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def written_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]

    def first(values: list[str]) -> Column:
        return F.coalesce(*(F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True))) if values else F.lit(None).cast("string")

    return first([h + p for _, h, p in ordered]), first([v for v, _, _ in ordered])


def _words(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda w: ~w.rlike(r"^\d*$"))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url."""
    parts = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(parts, k, F.size(parts)), ".")))
    words = F.transform(_words(host_of(url), r"[._-]+"), lambda w: F.concat(F.lit("word="), w))
    steps = F.transform(_words(path_of(url), r"[/._-]+"), lambda w: F.concat(F.lit("path="), w))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda n: F.concat(F.lit("query="), n))
    none = F.array().cast("array<string>")
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(suffixes, words, steps, names))).otherwise(none)


def _lower_end(share: Column, n: Column) -> Column:
    """The lower end of the 95 % interval of a share of n (Wilson)."""
    z = 1.96
    return (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def _items(labelled: DataFrame, least_rows: float) -> DataFrame:
    """(items, n, bad, place): each distinct set of tokens, of which those that are blocked often enough, one for each set of urls that tokens share, with its rows and the blocked ones."""
    # Equal urls are one row with their counts, so that a hot url is no hot task.
    known = labelled.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("blocked", F.lit(False))).alias("bad")).withColumn("place", F.xxhash64("tokens"))
    known = written(known, "known-urls")
    spread = known.select(F.explode("tokens").alias("token"), "n", "bad", "place")
    # Tokens of equal counts and hash sums stand in the same urls.
    seen = spread.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.expr("sum(cast(place as decimal(20, 0)))").alias("where"), F.bit_xor("place").alias("marks")).where(F.col("bad") >= least_rows)
    chosen = seen.groupBy("n", "bad", "where", "marks").agg(F.max_by("token", F.struct(F.substring_index("token", "=", 1), F.length("token"), "token")).alias("token")).select("token")
    return spread.join(_small(chosen), "token").groupBy("place", "n", "bad").agg(F.array_sort(F.collect_list("token")).alias("items")).select("items", "n", "bad", "place")


def _baskets(sets: DataFrame) -> DataFrame:
    """(items, blocked): sets as one row for each of their rows."""
    parts = sets.select("items", "n", "bad", "place", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)")).alias("first"))
    again = F.transform(F.expr(f"sequence(first, least(first + {CHUNK}, n) - 1)"), lambda k: k < F.col("bad"))
    return parts.repartition("place", "first").select("items", F.explode(again).alias("blocked"))


def _grown(sets: DataFrame, least_rows: float, min_confidence: float) -> DataFrame:
    """Rules (tokens, n, bad) of sets by FP-growth."""
    baskets = written(_baskets(sets), "baskets")
    every = baskets.count()
    if not every or least_rows > every:
        return sets.sparkSession.createDataFrame([], COUNTED)
    transactions = baskets.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least_rows / every), minConfidence=min_confidence).fit(transactions)
    bad = F.round(F.col("support") * every)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK)))
    return found.select(F.array_sort("antecedent").alias("tokens"), F.round(bad / F.col("confidence")).cast("long").alias("n"), bad.cast("long").alias("bad"))


def _elsewhere(found: DataFrame, far: DataFrame) -> DataFrame:
    """found (tokens, n, bad) of other sets than far: those that no blocked set of far holds, with the rows of far added."""
    index = index_of(found.select("tokens", F.lit(0.0).alias("confidence"))).drop("own_confidence")
    spread = far.select("place", "n", "bad", "items", F.explode("items").alias("token"))
    held = spread.join(index, "token").where(F.size(F.array_except("own", "items")) == 0).groupBy(F.col("own").alias("tokens")).agg(F.sum("n").alias("more"), F.sum("bad").alias("far_bad"))
    both = found.join(held, "tokens", "left").where(F.coalesce("far_bad", F.lit(0)) == 0)
    return both.select("tokens", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "bad")


def _levels(sets: DataFrame, far: DataFrame, least_rows: float) -> DataFrame:
    """(tokens, n, bad), counted in all sets: the combinations that a blocked set of far holds and that are blocked in least_rows rows or
    more, without those of which a part stands in the same rows or is always blocked: none of these is a rule that stays."""
    within = far.where("bad > 0").select("place", F.lit(True).alias("far"))
    marked = sets.join(within, "place", "left").select("place", "n", "bad", "items", F.coalesce("far", F.lit(False)).alias("far"))
    tokens = far.where("bad > 0").select(F.explode("items").alias("token")).distinct()
    rows = marked.select("place", "n", "bad", "far", F.explode("items").alias("token")).join(_small(tokens), "token").select(F.array("token").alias("tokens"), "place", "n", "bad", "far")
    out, size, before = None, 1, None
    while True:
        rows = written(rows, "held")
        counts = rows.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("far").alias("far")).where(F.col("far") & (F.col("bad") >= least_rows)).drop("far")
        if before is not None:
            parts = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda k: F.filter("tokens", lambda _, at: at != k))
            part = counts.select("tokens", "n", F.explode(parts).alias("part")).join(before.select(F.col("tokens").alias("part"), F.col("n").alias("part_n")), "part")
            counts = counts.join(part.groupBy("tokens", "n").agg(F.count(F.lit(1)).alias("parts"), F.min("part_n").alias("least")).where((F.col("parts") == size) & (F.col("least") > F.col("n"))).select("tokens"), "tokens")
        counts = written(counts, "level")
        out = counts if out is None else out.unionByName(counts)
        before = counts.where("bad < n")
        if before.isEmpty():
            return out
        open_ = rows.join(before.select("tokens"), "tokens", "left_semi").select("place", F.slice("tokens", 1, size - 1).alias("start"), F.element_at("tokens", -1).alias("last"), "n", "bad", "far")
        other = open_.select("place", "start", F.col("last").alias("next"))
        rows = open_.join(other, ["place", "start"]).where("last < next").select(F.concat("start", F.array("last", "next")).alias("tokens"), "place", "n", "bad", "far")
        size += 1


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, sure: float = SURE, most_items: int = MOST_ITEMS) -> DataFrame:
    """Rules for blocking (tokens in order, confidence, support), from labelled (tokens array<string>, blocked boolean). most_items: of urls that FP-growth takes; the others are mined by level."""
    rows = labelled.where(F.size("tokens") > 0).count()
    least = max(min_support, min_count / rows) if rows else 2.0
    if least > 1:
        return labelled.sparkSession.createDataFrame([], RULE)
    least_rows = least * rows - 1e-9
    sets = written(_items(labelled, least_rows), "sets")
    far = sets.where(F.size("items") > most_items)
    found = _grown(sets.where(F.size("items") <= most_items), least_rows, min_confidence)
    if not far.isEmpty():
        found = _elsewhere(written(found, "grown"), far).unionByName(_levels(sets, far, least_rows))
    found = found.select("tokens", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(rows)).alias("support"), "n")
    found = found.where((F.col("confidence") >= min_confidence) & (_lower_end(F.col("confidence"), F.col("n")) >= sure)).drop("n")
    return written(pruned(written(found, "found")), "rules")


def index_of(rules: DataFrame) -> DataFrame:
    """(token, own, own_confidence): each rule under its rarest token."""
    spread = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("own"), F.col("confidence").alias("own_confidence"))
    uses = spread.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return spread.join(uses, "token").groupBy("own", "own_confidence").agg(F.min_by("token", F.struct("uses", "token")).alias("token")).select("token", "own", "own_confidence")


def pruned(rules: DataFrame) -> DataFrame:
    """rules without those that a rule over a part of their tokens equals or beats in confidence."""
    spread = rules.select(F.explode("tokens").alias("token"), "tokens", "confidence")
    beaten = spread.join(index_of(rules), "token").where((F.size("own") < F.size("tokens")) & (F.size(F.array_except("own", "tokens")) == 0) & (F.col("own_confidence") >= F.col("confidence")))
    return rules.join(beaten.select("tokens").distinct(), "tokens", "left_anti").select("tokens", "confidence", "support")


def _small(table: DataFrame) -> DataFrame:
    """table, marked for broadcast where it has at most SMALL rows."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls (url) of which some rule's tokens are all there, by the inverted index."""
    index = written(index_of(rules), "rule-index")
    spread = urls.distinct().select("url", tokens_of(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("token"))
    return spread.join(_small(index), "token").where(F.size(F.array_except("own", "tokens")) == 0).select("url").distinct()


def verdicts(pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict. labelled: (url, blocked)."""
    found = mined(labelled.select(tokens_of(F.col("url")).alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked")), min_support, min_confidence, min_count)
    rule, verdict = written_rule(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("*", rule.alias("rule"), verdict.alias("q_verdict"))
    blocked = written(blocked_urls(named.where("rule is null and url is not null").select("url"), found), "blocked-urls")
    judged = named.join(_small(blocked.withColumn("q_block", F.lit(True))), "url", "left")
    method = F.when(F.col("q_block"), F.lit("block")).otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("q_verdict", method).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(url, blocked) of all urls: blocked if the url has a seed word in its host or ends in the number of a labelled document that
    is of low quality or toxic. A url of which nothing is known counts as not blocked, so that a rule must hold against all pages."""
    number = F.regexp_extract(path_of(F.col("url")), r"(\d{1,18})[^/\d]*/?$", 1)
    seeded = F.arrays_overlap(F.split(host_of(F.col("url")), "[._-]+"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    named = pages.where("url is not null").select("url", seeded.alias("q_seeded"), F.when(number != "", number.cast("long")).alias("q_doc"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("q_doc")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("q_bad"))
    return named.join(marks, "q_doc", "left").select("url", (F.col("q_seeded") | F.coalesce("q_bad", F.lit(False))).alias("blocked"))
