"""Graph, insight and sampling queries over the relational tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import canonical, connector, gold, graph, insights, report, sampling
from . import adapters as A
from .config import DEFAULT, Config, Stakeholder

#: Stakeholders over the adapter's categories (part types).
STAKEHOLDERS = (Stakeholder("leadership", "", None, "negative", "channels"), Stakeholder("product", "", ("economy", "small"), "negative", "requests"), Stakeholder("support", "", ("promo",), None, "causes"), Stakeholder("brand", "", ("standard", "large", "medium"), "positive"))
CONFIG = Config(stakeholders=STAKEHOLDERS, hubs=("economy", "promo", "brand 7"))
YEARLY = Config(period="yyyy")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Means and shares to 6 places, so that the order of addition doesn't show."""
    return df.withColumns({n: F.round(n, 6) for n in names})


HUBS = "hubs as (select entity_id from entities where name in ('economy', 'promo', 'brand 7'))"
VALID = "valid as (select period, count(*) total from reviews group by period having count(*) >= 30)"
BRIDGE = "bridge as (select review_id, entity_id from mentions union select review_id, subject_id from triplets union select review_id, object_id from triplets)"
EDGES = """own as (select *, count(*) over (partition by review_id) k from bridge),
pairs as (select least(subject_id, object_id) src, greatest(subject_id, object_id) dst, 2.0 w, predicate kind from triplets where subject_id <> object_id
  union all select a.entity_id, b.entity_id, 1.0 / (a.k - 1), 'co_mention' from own a join own b on a.review_id = b.review_id and a.entity_id < b.entity_id),
edges as (select src, dst, sum(cast(w as double)) weight, array_to_string(list_sort(list_distinct(list(kind))), ',') kinds from pairs group by src, dst)"""
GRAPH = A.sql("mentions", "triplets", "entities", "clusters") + f",\n{BRIDGE},\n{EDGES},\n{HUBS}"
MEMBERS = "members as (select entity_id, 'macro' as level, cast(macro_cluster as varchar) as cluster, null parent from clusters where macro_cluster >= 0 union all select entity_id, 'micro', micro_cluster, cast(macro_cluster as varchar) from clusters where macro_cluster >= 0)"
INTERESTS = f"""{MEMBERS},
sizes as (select level, cluster, parent, count(*) n_entities from members group by all having count(*) >= 3),
kept as (select s.* from sizes s left join sizes p on p.level = 'macro' and p.cluster = s.parent where s.level = 'macro' or p.n_entities is null or s.n_entities <> p.n_entities),
touched as (select distinct review_id, level, cluster from bridge join members using (entity_id)),
stats as (select level, cluster, count(*) n_reviews, avg(stars) avg_stars, avg(case when stars <= 2 then 1.0 else 0.0 end) pct_negative_reviews from touched join reviews using (review_id) group by level, cluster),
interests as (select k.level || '_' || k.cluster interest_id, k.level, k.cluster, case when k.level = 'micro' then 'macro_' || parent end parent_interest_id, n_entities, coalesce(n_reviews, 0) n_reviews, avg_stars, pct_negative_reviews from kept k left join stats s on k.level = s.level and k.cluster = s.cluster),
counted as (select review_id, interest_id, m.level, count(*) n from bridge join members m using (entity_id) join interests i on i.level = m.level and i.cluster = m.cluster group by all),
weights as (select review_id, interest_id, level, cast(n as double) / sum(n) over (partition by review_id, level) weight from counted)"""
GOLD = A.sql("reviews", "mentions", "triplets", "entities", "clusters") + f",\n{BRIDGE},\n{INTERESTS}"


def trend_sql(keyed: str) -> str:
    """CTEs from keyed (key, review_id) to trends."""
    return f"""keyed as ({keyed}),
{VALID},
counts as (select key, period, count(distinct review_id) n from keyed join reviews using (review_id) group by key, period),
shares as (select k.key, v.period, coalesce(n, 0) n, coalesce(n, 0) / cast(total as double) share from (select distinct key from keyed) k cross join valid v left join counts c on c.key = k.key and c.period = v.period),
placed as (select *, row_number() over (partition by key order by period) a, row_number() over (partition by key order by period desc) b from shares),
moved as (select key, cast(sum(n) as bigint) n_reviews, avg(share) filter (a <= 3) early_share, avg(share) filter (b <= 3) late_share from placed group by key),
trends as (select *, (late_share - early_share) * 100 change_pp, case when early_share is null or n_reviews < 20 then 'too few reviews'
  when (late_share - early_share) * 100 >= 0.5 and late_share - early_share >= 0.25 * early_share then 'rising' when (early_share - late_share) * 100 >= 0.5 and early_share - late_share >= 0.25 * early_share then 'falling' else 'stable' end trend from moved)"""


def _all(spark, d):
    return A.reviews(spark, d), A.mentions(spark, d), A.triplets(spark, d), A.entities(spark, d), A.clusters(spark, d)


def _by_brand(spark, d):
    return A.mentions(spark, d).select(F.col("entity_id").alias("key"), "review_id")


@query(A.sql("reviews") + f", {VALID} select period, total from valid")
def i02_valid_months(spark, d):
    return insights.valid_periods(A.reviews(spark, d))


@query(A.sql("reviews", "mentions") + ", " + trend_sql("select entity_id as key, review_id from mentions") + " select key, period, n, round(share, 6) share from shares")
def i04_monthly_shares(spark, d):
    return rounded(insights.shares(_by_brand(spark, d), A.reviews(spark, d)), "share")


TREND = ("early_share", "late_share", "change_pp")
_T = "key, n_reviews, round(early_share, 6) early_share, round(late_share, 6) late_share, round(change_pp, 6) change_pp, trend"


@query(A.sql("reviews", "mentions") + ", " + trend_sql("select entity_id as key, review_id from mentions") + f" select {_T} from trends")
def i05_entity_trends(spark, d):
    return rounded(insights.trends(_by_brand(spark, d), A.reviews(spark, d)), *TREND)


@query(A.sql("reviews", "mentions").replace("'%Y-%m'", "'%Y'") + ", " + trend_sql("select entity_id as key, review_id from mentions") + f" select {_T} from trends")
def i05_entity_trends_by_year(spark, d):
    return rounded(insights.trends(_by_brand(spark, d), A.reviews(spark, d), YEARLY), *TREND)


@query(A.sql("reviews", "mentions") + ", r as (select * from reviews where stars in (1, 2) and source_group in ('organic', 'invited')), " + trend_sql("select entity_id as key, review_id from mentions").replace("reviews", "r").replace("n_r ", "n_reviews ").replace("n_r,", "n_reviews,").replace("n_r <", "n_reviews <").replace("too few r'", "too few reviews'") + f" select {_T} from trends")
def i17_filtered_trends(spark, d):
    return rounded(insights.trends(_by_brand(spark, d), insights.filtered(A.reviews(spark, d), stars=[1, 2], sources=["organic", "invited"])), *TREND)


@query(GOLD + ", " + trend_sql("select interest_id as key, review_id from weights where level = 'macro'") + " select key interest_id, t.n_reviews, round(early_share, 6) early_share, round(late_share, 6) late_share, round(change_pp, 6) change_pp, trend, round(pct_negative_reviews, 6) pct_negative_reviews from trends t join interests i on i.interest_id = t.key")
def i05_interest_trends(spark, d):
    r, m, t, e, c = _all(spark, d)
    kept = gold.interests(c, m, t, r)
    return rounded(insights.interest_trends(gold.review_weights(c, m, t, kept), kept, r, "macro"), *TREND, "pct_negative_reviews")


FITS = "own as (select s.stakeholder, m.*, r.stars, r.source_group, r.language from mentions m join reviews r using (review_id) join (values ('leadership', null, 'negative'), ('product', 'economy small', 'negative'), ('support', 'promo', null), ('brand', 'standard large medium', 'positive')) s(stakeholder, cats, mood) on (cats is null or list_contains(string_split(cats, ' '), category)) and (mood is null or sentiment = mood))"
SH = A.sql("reviews", "mentions", "entities") + f", {HUBS}, {FITS}"
TOP = "tops as (select *, row_number() over (partition by stakeholder order by n_mentions desc, entity_id) as rank from (select stakeholder, entity_id, count(*) n_mentions, count(distinct review_id) n_reviews, avg(stars) avg_stars from own where entity_id not in (select entity_id from hubs) group by all))"


@query(SH + ", " + trend_sql("select stakeholder as key, review_id from own") + ", base as (select stakeholder, count(*) n_reviews, count(*) / cast((select count(*) from reviews) as double) share_of_reviews, avg(stars) avg_stars, avg(case when source_group = 'organic' then 1.0 else 0.0 end) organic_share from (select distinct stakeholder, review_id, stars, source_group from own) group by all) select stakeholder, b.n_reviews, round(share_of_reviews, 6) share_of_reviews, round(avg_stars, 6) avg_stars, round(organic_share, 6) organic_share, t.n_reviews n_reviews_trend, round(early_share, 6) early_share, round(late_share, 6) late_share, round(change_pp, 6) change_pp, trend from base b join trends t on t.key = b.stakeholder")
def i07_stakeholder_metrics(spark, d):
    return rounded(insights.stakeholder_metrics(A.mentions(spark, d), A.reviews(spark, d), CONFIG), "share_of_reviews", "avg_stars", "organic_share", *TREND)


def _hubs(spark, d):
    return graph.hub_ids(A.entities(spark, d), CONFIG.hubs)


@query(SH + f", {TOP} select stakeholder, entity_id, n_mentions, n_reviews, round(avg_stars, 6) avg_stars, rank from tops where rank <= 8")
def i07_stakeholder_entities(spark, d):
    return rounded(insights.stakeholder_entities(A.mentions(spark, d), A.reviews(spark, d), _hubs(spark, d), CONFIG).withColumn("rank", F.col("rank").cast("long")), "avg_stars")


_Q = "order by language <> 'BUILDING', stars, review_id, entity_id, evidence"


@query(SH + f", {TOP}, a as (select * from (select own.*, row_number() over (partition by own.stakeholder, review_id {_Q.replace('entity_id', 'own.entity_id')}) x from own join tops t on t.stakeholder = own.stakeholder and t.entity_id = own.entity_id and t.rank <= 4) where x = 1), b as (select * from (select *, row_number() over (partition by stakeholder, entity_id {_Q}) y from a) where y = 1), c as (select *, row_number() over (partition by stakeholder {_Q}) as rank from b) select stakeholder, rank, review_id, entity_id, stars, language, evidence from c where rank <= 3")
def i07_stakeholder_quotes(spark, d):
    return insights.stakeholder_quotes(A.mentions(spark, d), A.reviews(spark, d), _hubs(spark, d), CONFIG, "BUILDING").withColumn("rank", F.col("rank").cast("long"))


REL = "relations as (select subject_id source_id, predicate, object_id target_id, count(*) weight, array_to_string(list_sort(list_distinct(list(review_id))), ',') review_ids from triplets group by all)"


@query(A.sql("triplets") + f", {REL} select source_id, target_id, weight from relations where predicate = 'REQUESTS' order by weight desc, source_id, target_id limit 8")
def i08_requests(spark, d):
    return insights.requests(graph.relations(A.triplets(spark, d)))


@query(SH + ", " + A.SQL["triplets"] + f", {REL}, wanted as (select distinct entity_id from own where stakeholder = 'support' and entity_id not in (select entity_id from hubs)) select source_id, predicate, target_id, weight, source_id || ' ' || lower(replace(predicate, '_', ' ')) || ' ' || target_id as text from relations where predicate in ('CAUSED_BY', 'LEADS_TO') and source_id <> 'e_brand_1' and (source_id in (from wanted) or target_id in (from wanted)) order by weight desc, source_id, predicate, target_id limit 8")
def i09_causes(spark, d):
    own = insights.of_stakeholder(A.mentions(spark, d), CONFIG.stakeholders[2])
    not_sources = A.entities(spark, d).where("name = 'brand 1'").select("entity_id")
    return insights.causes(graph.relations(A.triplets(spark, d)), own, _hubs(spark, d), not_sources)


@query(A.sql("reviews") + f", {VALID} select period, round(avg(stars) filter (source_group = 'invited'), 6) invited, round(avg(stars) filter (source_group = 'organic'), 6) organic, round(avg(stars) filter (source_group = 'other'), 6) other from reviews join valid using (period) group by period")
def i10_channel_months(spark, d):
    return rounded(insights.channel_periods(A.reviews(spark, d)), "invited", "organic", "other")


@query(A.sql("reviews") + " select source_group, count(*) n_reviews, round(avg(stars), 6) avg_stars, round(avg(case when stars = 1 then 1.0 else 0.0 end), 6) pct_one_star from reviews group by source_group")
def i10_channel_stats(spark, d):
    return rounded(insights.channel_stats(A.reviews(spark, d)), "avg_stars", "pct_one_star")


@query(GOLD + ", " + trend_sql("select interest_id as key, review_id from weights where level = 'macro'") + " select interest_id, t.n_reviews, cast(floor(t.n_reviews * pct_negative_reviews + 0.5) as bigint) negative_reviews from trends t join interests i on i.interest_id = t.key order by negative_reviews desc, interest_id limit 5")
def i10_negative_drivers(spark, d):
    r, m, t, e, c = _all(spark, d)
    kept = gold.interests(c, m, t, r)
    return insights.negative_drivers(insights.interest_trends(gold.review_weights(c, m, t, kept), kept, r, "macro"))


@query(GOLD + " select count(*) n_reviews, round(avg(stars), 6) avg_stars, round(avg(case when stars <= 2 then 1.0 else 0.0 end), 6) pct_negative, round(avg(case when source_group = 'organic' then 1.0 else 0.0 end), 6) organic_share, min(created_at) as first, max(created_at) as last, (select count(*) from interests where level = 'macro') n_macro, (select count(*) from entities) n_entities from reviews")
def i11_headline(spark, d):
    r, m, t, e, c = _all(spark, d)
    return rounded(insights.headline(r, gold.interests(c, m, t, r), e), "avg_stars", "pct_negative", "organic_share")


@query(A.sql("reviews", "mentions") + ", " + trend_sql("select entity_id as key, review_id from mentions") + ", moods(mood) as (values ('positive'), ('negative'), (null)) select key, mood, case when trend not in ('rising', 'falling') or mood is null then 'flat' when (trend = 'rising') = (mood = 'positive') then 'good' else 'bad' end badge from trends, moods")
def i12_badges(spark, d):
    found = insights.trends(_by_brand(spark, d), A.reviews(spark, d))
    moods = F.explode(F.array(F.lit("positive"), F.lit("negative"), F.lit(None).cast("string")))
    return found.select("key", "trend", moods.alias("mood")).select("key", "mood", insights.badge(F.col("trend"), F.col("mood")).alias("badge"))


@query(GOLD + " select interest_id, case when stars <= 2 then 'negative' when stars = 3 then 'neutral' else 'positive' end mood, count(*) n from weights join reviews using (review_id) where level = 'macro' group by all")
def i16_interest_sentiment(spark, d):
    r, m, t, e, c = _all(spark, d)
    return insights.interest_sentiment(gold.review_weights(c, m, t, gold.interests(c, m, t, r)), r)


@query(GOLD + " select review_id, created_at, stars, language, source_group, m.name, m.opinion from weights w join reviews using (review_id) join mentions m using (review_id) where w.interest_id = 'macro_2' and stars = 1")
def i19_review_browser(spark, d):
    r, m, t, e, c = _all(spark, d)
    w = gold.review_weights(c, m, t, gold.interests(c, m, t, r)).where("interest_id = 'macro_2'").select("review_id")
    return r.where("stars = 1").join(w, "review_id", "left_semi").join(m.select("review_id", "name", "opinion"), "review_id")


@query(A.sql("triplets") + f", {REL}, moods as (select subject_id source_id, predicate, object_id target_id, '{{' || string_agg('\"' || sentiment || '\":' || n, ',' order by sentiment) || '}}' sentiment_mix from (select subject_id, predicate, object_id, sentiment, count(*) n from triplets group by all) group by all) select r.*, sentiment_mix from relations r join moods using (source_id, predicate, target_id)")
def g01_relations(spark, d):
    return graph.relations(A.triplets(spark, d)).withColumn("review_ids", F.array_join("review_ids", ","))


def _edges(spark, d):
    return graph.edges(A.mentions(spark, d), A.triplets(spark, d))


@query(GRAPH + " select src, dst, round(weight, 6) weight, kinds from edges")
def g02_edges(spark, d):
    return rounded(_edges(spark, d), "weight").withColumn("kinds", F.array_join("kinds", ","))


@query(GRAPH + " select entity_id from hubs")
def g03_hubs(spark, d):
    return _hubs(spark, d)


@query(GRAPH + " select src, dst, round(weight, 6) weight from edges where src not in (from hubs) and dst not in (from hubs)")
def g04_core_graph(spark, d):
    return rounded(graph.core_edges(_edges(spark, d), _hubs(spark, d)), "weight").drop("kinds")


@query(A.sql("entities", "clusters") + ", sizes as (select micro_cluster, count(*) as size, row_number() over (order by count(*) desc, micro_cluster) - 1 as number from clusters group by micro_cluster) select entity_id, micro_cluster, size, number from clusters join sizes using (micro_cluster)")
def g06_renumbered_clusters(spark, d):
    return graph.renumbered(A.clusters(spark, d).select("entity_id", "micro_cluster"), "micro_cluster").withColumn("number", F.col("number").cast("long"))


@query(GRAPH + " select entity_id, count(src) degree from entities left join edges on entity_id in (src, dst) group by entity_id")
def g08_degrees(spark, d):
    return graph.degrees(A.entities(spark, d), _edges(spark, d))


@query(None)
def g09_pagerank(spark, d):
    return rounded(graph.pagerank(A.entities(spark, d), _edges(spark, d)), "pagerank")


TOUCH = "touch as (select review_id, entity_id, sentiment from mentions union all select review_id, subject_id, sentiment from triplets union all select review_id, object_id, sentiment from triplets)"


@query(A.sql("reviews", "mentions", "triplets", "entities", "clusters") + f", {TOUCH} select entity_id, name, macro_cluster, micro_cluster, count(t.review_id) mention_count, count(distinct t.review_id) review_count, round(avg(stars), 6) avg_stars, round(avg(case when t.review_id is null then null when sentiment = 'negative' then 1.0 else 0.0 end), 6) pct_negative from entities join clusters using (entity_id) left join touch t using (entity_id) left join reviews using (review_id) group by all")
def g10_entity_stats(spark, d):
    r, m, t, e, c = _all(spark, d)
    return rounded(gold.entity_stats(e, m, t, r, c), "avg_stars", "pct_negative")


@query(A.sql("mentions", "triplets") + f", {BRIDGE} select review_id, entity_id from bridge")
def g11_review_entities(spark, d):
    return graph.bridge(A.mentions(spark, d), A.triplets(spark, d))


@query(GOLD + " select interest_id, level, cluster, parent_interest_id, n_entities, n_reviews, round(avg_stars, 6) avg_stars, round(pct_negative_reviews, 6) pct_negative_reviews from interests")
def g12_interests(spark, d):
    r, m, t, e, c = _all(spark, d)
    return rounded(gold.interests(c, m, t, r), "avg_stars", "pct_negative_reviews")


@query(GOLD + " select review_id, interest_id, level, round(weight, 3) weight from weights")
def g13_review_weights(spark, d):
    r, m, t, e, c = _all(spark, d)
    return gold.review_weights(c, m, t, gold.interests(c, m, t, r)).withColumn("weight", F.round("weight", 3))


@query(GOLD + ", prim as (select * from (select review_id, interest_id, row_number() over (partition by review_id order by weight desc, interest_id) k from weights where level = 'macro') where k = 1) select r.review_id, created_at, stars, language, source_group, coalesce(n, 0) n_aspects, interest_id primary_macro_interest_id from reviews r left join (select review_id, count(*) n from mentions group by review_id) using (review_id) left join prim using (review_id)")
def g14_gold_reviews(spark, d):
    r, m, t, e, c = _all(spark, d)
    return gold.gold_reviews(r, m, gold.review_weights(c, m, t, gold.interests(c, m, t, r)))


@query(GRAPH + ", seen as (select entity_id from mentions group by entity_id having count(*) >= 600 and entity_id not in (from hubs)) select src, dst, round(weight, 6) weight from edges where src in (from seen) and dst in (from seen)")
def g15_visible_edges(spark, d):
    often = A.mentions(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 600").join(_hubs(spark, d), "entity_id", "left_anti")
    shown = _edges(spark, d)
    for end in ("src", "dst"):
        shown = shown.join(often.select(F.col("entity_id").alias(end)), end, "left_semi")
    return rounded(shown.select("src", "dst", "weight"), "weight")


@query(GRAPH + ", sides as (select src, dst, weight, src one, dst other from edges union all select src, dst, weight, dst, src from edges), r as (select *, row_number() over (partition by one order by round(weight, 9) desc, other) k from sides) select distinct src, dst, round(weight, 6) weight from r where k <= 2")
def w08_strongest_edges(spark, d):
    return rounded(graph.strongest(_edges(spark, d).withColumn("weight", F.round("weight", 9))), "weight")


@query(GRAPH + " select least(a.macro_cluster, b.macro_cluster) cluster_a, greatest(a.macro_cluster, b.macro_cluster) cluster_b, round(sum(weight), 6) weight from edges join clusters a on a.entity_id = src join clusters b on b.entity_id = dst where a.macro_cluster >= 0 and b.macro_cluster >= 0 and a.macro_cluster <> b.macro_cluster group by 1, 2")
def j17_between_clusters(spark, d):
    return rounded(graph.between_clusters(_edges(spark, d), A.clusters(spark, d)), "weight")


@query(A.sql("reviews", "mentions", "clusters", "entities").replace("entities as", "entities as", 1).replace("clusters as (select entity_id, coalesce", "clusters as (select entity_id, coalesce") + " select entity_id, review_id, sentiment, evidence from (select *, row_number() over (partition by review_id order by often desc, sentiment, entity_id, evidence) k from (select *, count(*) over (partition by entity_id) often from mentions where entity_id in (select entity_id from clusters where macro_cluster = 2))) where k = 1 order by often desc, sentiment, review_id limit 8")
def x11_quotes(spark, d):
    return gold.quotes(A.mentions(spark, d), A.clusters(spark, d).where("macro_cluster = 2"))


ORACLE_SQL["x11_quotes"] = ORACLE_SQL["x11_quotes"].replace(A.sql("reviews", "mentions", "clusters", "entities"), A.sql("mentions", "entities", "clusters"))

QUOTAS = "quotas as (select stars, fl + case when row_number() over (order by fr desc, stars) <= 1000 - sum(fl) over () then 1 else 0 end quota from (select stars, cast(floor(1000.0 * n / total) as bigint) fl, 1000 * n % total fr from (select stars, count(*) n, sum(count(*)) over () total from reviews group by stars)))"
KEYED = "pool as (select *, substr(md5(review_id || '-42'), 1, 13) h from reviews), tops as (select language from pool group by language order by count(*) desc, language limit 4), grouped as (select p.*, case when language in (from tops) then language else 'other' end lang_group from pool p), placed as (select *, (row_number() over (partition by stars, lang_group, source_group order by h, review_id) - 0.5) / count(*) over (partition by stars, lang_group, source_group) mid from grouped)"


@query(A.sql("reviews") + f", {QUOTAS} select stars, cast(quota as bigint) quota from quotas")
def x02_star_quotas(spark, d):
    return sampling.star_quotas(A.reviews(spark, d), 1000)


@query(A.sql("reviews") + f", {KEYED} select review_id, stars, lang_group, source_group, round(mid, 6) midpoint from placed")
def w01_midpoint_ranks(spark, d):
    return rounded(sampling.midpoint_ranks(A.reviews(spark, d)).select("review_id", "stars", "lang_group", "source_group", "midpoint"), "midpoint")


@query(A.sql("reviews") + f", {QUOTAS}, {KEYED} select review_id, stars, language, source_group from (select *, row_number() over (partition by stars order by mid, h, review_id) k from placed) join quotas using (stars) where k <= quota")
def x03_stratified_sample(spark, d):
    return sampling.stratified_sample(A.reviews(spark, d), A.reviews(spark, d), 1000).select("review_id", "stars", "language", "source_group")


@query(A.sql("mentions") + " select entity_id, category, n from (select *, row_number() over (partition by entity_id order by n desc, category) k from (select entity_id, category, count(*) n from mentions group by all)) where k = 1")
def a08_modal_category(spark, d):
    return sampling.modes(A.mentions(spark, d), "entity_id", "category")


@query("select p_brand, quantile_cont(l_quantity, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])[1] p10, quantile_cont(l_quantity, 0.25) p25, quantile_cont(l_quantity, 0.5) median, quantile_cont(l_quantity, 0.75) p75, quantile_cont(l_quantity, 0.9) p90, quantile_cont(l_quantity, 0.99) p99 from lineitem join part on l_partkey = p_partkey group by p_brand")
def a13_percentiles(spark, d):
    met = A.table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(A.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    p = met.groupBy("p_brand").agg(F.percentile("l_quantity", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)))).alias("p"))
    return p.select("p_brand", *(F.col("p")[k].alias(n) for k, n in enumerate(("p10", "p25", "median", "p75", "p90", "p99"))))


@query("select count(*) as count, round(avg(o_totalprice), 4) mean, round(stddev_samp(o_totalprice), 4) std, min(o_totalprice) as min, max(o_totalprice) as max from orders")
def a14_describe(spark, d):
    c = "o_totalprice"
    return A.table(spark, d, "orders").agg(F.count(c).alias("count"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


@query("select round(corr(l_quantity, l_extendedprice), 6) r from lineitem")
def a15_correlation(spark, d):
    return A.table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(A.sql("reviews") + " select source_group, " + ", ".join(f"round(count(*) filter (stars = {k}) / cast(count(*) as double), 6) s{k}" for k in range(1, 6)) + " from reviews group by source_group")
def a16_star_mix_by_source(spark, d):
    return A.reviews(spark, d).groupBy("source_group").agg(*(F.round(F.avg((F.col("stars") == k).cast("double")), 6).alias(f"s{k}") for k in range(1, 6)))


@query(A.sql("reviews") + " select stars, count(*) n, round(count(*) / cast(sum(count(*)) over () as double), 6) share from reviews group by stars")
def n03_star_shares(spark, d):
    counted = A.reviews(spark, d).groupBy("stars").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total), F.lit(True)).select("stars", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(A.sql("reviews") + " select 'month' as kind, period as key, count(*) n from reviews group by all union all select 'source', source_group, count(*) from reviews group by all union all select 'language', language, count(*) from reviews group by all")
def n02_counts(spark, d):
    r = insights.with_period(A.reviews(spark, d))
    one = r.select(F.explode(F.create_map(F.lit("month"), F.col("period"), F.lit("source"), F.col("source_group"), F.lit("language"), F.col("language"))).alias("kind", "key"))
    return one.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(date_trunc('week', ts - interval 1 day) + interval 7 day as date) week_end, event_type, count(*) n from events group by all")
def n07_weekly_volume(spark, d):
    """Weeks that end on Monday."""
    week = F.date_add(F.date_trunc("week", F.col("ts") - F.expr("interval 1 day")).cast("date"), 7)
    return A.table(spark, d, "events").groupBy(week.alias("week_end"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select dayname(ts) as day, hour(ts) as hour, count(*) n from events group by all")
def n08_weekday_hours(spark, d):
    return A.table(spark, d, "events").groupBy(F.date_format("ts", "EEEE").alias("day"), F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(A.sql("reviews") + ", top as (select language from reviews group by language order by count(*) desc, language limit 3) select case when language in (from top) then language else 'other' end as language, count(*) n, round(avg(stars), 6) avg_stars, round(avg(case when source_group = 'organic' then 1.0 else 0.0 end), 6) organic_share, round(avg(stars) filter (source_group = 'invited'), 6) invited_stars from reviews group by 1")
def n06_languages(spark, d):
    r = A.reviews(spark, d)
    named = sampling.top_or_other(r, "language", 3)
    return named.groupBy(F.col("language_group").alias("language")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("stars"), 6).alias("avg_stars"), F.round(F.avg((F.col("source_group") == "organic").cast("double")), 6).alias("organic_share"), F.round(F.avg(F.when(F.col("source_group") == "invited", F.col("stars"))), 6).alias("invited_stars"))


@query(GOLD + ", shown as (select interest_id, n_reviews, n_entities from interests) unpivot shown on n_reviews, n_entities into name measure value amount")
def u07_unpivoted_interests(spark, d):
    r, m, t, e, c = _all(spark, d)
    return gold.interests(c, m, t, r).select("interest_id", "n_reviews", "n_entities").unpivot("interest_id", ["n_reviews", "n_entities"], "measure", "amount")


@query(None)
def g05_communities(spark, d):
    from ..operators import communities, explore

    docs = A.table(spark, d, "documents")
    return explore.term_communities(docs, communities.hierarchy, DEFAULT)


def flagship(spark, d):
    return i05_entity_trends_by_year(spark, d)


_LINED = "used as (select string_split(p_name, ' ')[1] raw, p_partkey from part union all select upper(string_split(p_name, ' ')[2]), p_partkey from part), forms as (select raw, lower(raw) normalized, regexp_replace(lower(raw), '(e|s|ed|ing)$', '') canonical, count(*) n_mentions from used group by raw), lined as (select *, canonical entity_id, case when normalized = canonical then 'exact' else 'fuzzy' end as merge, round(100.0 * length(canonical) / length(normalized), 1) fuzzy_score from forms)"


def _lined(spark, d):
    """Words of part names as raw forms; a name without its ending stands for its canonical name."""
    part = A.table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    used = part.select(F.col("w")[0].alias("raw"), F.col("p_partkey").alias("review_id"), F.lit("first").alias("role")).unionByName(part.select(F.upper(F.col("w")[1]).alias("raw"), F.col("p_partkey").alias("review_id"), F.lit("second").alias("role")))
    named = canonical.lineage(used, F.lower("raw")).withColumn("canonical", F.regexp_replace("normalized", "(e|s|ed|ing)$", ""))
    score = F.round(F.length("canonical") * 100.0 / F.length("normalized"), 1)
    return named.withColumns({"entity_id": F.col("canonical"), "merge": F.when(F.col("normalized") == F.col("canonical"), "exact").otherwise("fuzzy"), "fuzzy_score": score})


@query(f"with {_LINED} select count(distinct raw) raw_forms, count(distinct normalized) normalized_names, count(distinct canonical) canonical_names, count(*) filter (merge = 'fuzzy') fuzzy_merges from lined")
def i18_lineage_metrics(spark, d):
    return canonical.lineage_metrics(_lined(spark, d))


@query(f"with {_LINED} select entity_id, count(distinct raw) n_forms, cast(sum(n_mentions) as bigint) n_mentions from lined group by entity_id")
def i18_entity_forms(spark, d):
    return canonical.entity_forms(_lined(spark, d))


@query(f"with {_LINED} select normalized, canonical, fuzzy_score, n_mentions, raw from lined where merge = 'fuzzy'")
def i18_fuzzy_merges(spark, d):
    return canonical.fuzzy_merges(_lined(spark, d))


_YEARS = [str(y) for y in range(1992, 1999)]


@query((GOLD + ", " + trend_sql("select interest_id as key, review_id from weights where level = 'macro'")).replace("'%Y-%m'", "'%Y'") + " select key interest_id, " + ", ".join(f"round(max(share) filter (period = '{y}'), 6) share_{y}" for y in _YEARS) + " from shares group by key")
def u08_interest_years(spark, d):
    """Shares of the macro interests, one column a year."""
    r, m, t, e, c = _all(spark, d)
    weights = gold.review_weights(c, m, t, gold.interests(c, m, t, r)).where("level = 'macro'")
    matrix = insights.period_matrix(insights.shares(weights.select(F.col("interest_id").alias("key"), "review_id"), r, YEARLY), _YEARS)
    return matrix.select(F.col("key").alias("interest_id"), *(F.round(F.col(f"`{y}`"), 6).alias(f"share_{y}") for y in _YEARS))


@query(A.sql("reviews") + " select review_id, stars, language, source_group from reviews order by md5(review_id || '-42'), review_id limit 10")
def t08_display_sample(spark, d):
    """Ten rows to look at: the limit is the feature."""
    return sampling.display_sample(A.reviews(spark, d), "review_id", 10).select("review_id", "stars", "language", "source_group")


@query("select count(*) calls, cast(sum(length(coalesce(text, ''))) as bigint) input_tokens, cast(sum(coalesce(n_chars, 0)) as bigint) output_tokens, cast(0 as bigint) cache_write_tokens, cast(count(text) as bigint) cache_read_tokens, round((2.0 * sum(length(coalesce(text, ''))) + 10.0 * sum(coalesce(n_chars, 0)) + 0.2 * count(text)) / 1e6, 6) cost_usd from documents")
def a20_usage(spark, d):
    """Calls, tokens and cost, with lengths of documents as tokens."""
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    counts = A.table(spark, d, "documents").select(F.lit(1).alias("calls"), size.alias("input_tokens"), F.col("n_chars").cast("long").alias("output_tokens"), F.lit(0).alias("cache_write_tokens"), F.col("text").isNotNull().cast("int").alias("cache_read_tokens"))
    return connector.usage(counts)


@query(A.sql("entities", "clusters") + f", sizes as (select micro_cluster as cluster, count(*) size from clusters where micro_cluster <> '-1' group by all) select cluster, size, coalesce(([{', '.join(repr(c) for c in report.PALETTE)}])[row_number() over (order by size desc, cluster)], '{report.OTHER}') color from sizes")
def g17_cluster_colors(spark, d):
    return report.cluster_colors(A.clusters(spark, d), "micro")
