"""The entity graph: relations, weighted edges, degrees, core, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import spread, written


def relations(triplets: DataFrame) -> DataFrame:
    """One row per subject, predicate and object: weight, sorted distinct review_ids, sentiment counts as JSON."""
    keys = ["subject_id", "predicate", "object_id"]
    by_sentiment = triplets.groupBy(*keys, "sentiment").agg(F.count(F.lit(1)).alias("n"), F.collect_set("review_id").alias("ids"))
    mix = F.map_from_entries(F.array_sort(F.collect_list(F.struct("sentiment", "n"))))
    return by_sentiment.groupBy(*keys).agg(F.sum("n").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("review_ids"), F.to_json(mix).alias("sentiment_mix")).select(F.col("subject_id").alias("source_id"), "predicate", F.col("object_id").alias("target_id"), "weight", "review_ids", "sentiment_mix")


def bridge(mentions: DataFrame, triplets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Distinct (review_id, entity_id) of mentions and both ends of triplets, of the given entities or all; dealt out by review."""
    touched = touches(mentions, triplets).select("review_id", "entity_id")
    if of is not None:
        touched = touched.join(of.select("entity_id"), "entity_id", "left_semi").select("review_id", "entity_id")
    return spread(touched, "review_id").distinct()


def touches(mentions: DataFrame, triplets: DataFrame) -> DataFrame:
    """Every mention and triplet end, repeated as often as it occurs."""
    return (
        mentions.select("review_id", "entity_id", "sentiment")
        .unionByName(triplets.select("review_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id"), "sentiment"))
    )


def edges(mentions: DataFrame, triplets: DataFrame) -> DataFrame:
    """Undirected (src < dst, weight, kinds): 2 for each triplet, 1 / (k - 1) for each pair of a review's k entities."""
    said = triplets.where("subject_id <> object_id").select(F.least("subject_id", "object_id").alias("src"), F.greatest("subject_id", "object_id").alias("dst"), F.lit(2.0).alias("w"), F.col("predicate").alias("kind"))
    own = bridge(mentions, triplets).groupBy("review_id").agg(F.array_sort(F.collect_set("entity_id")).alias("ids")).where(F.size("ids") > 1)
    # Pairs are made inside the row: a review names few entities.
    first = own.select((1.0 / (F.size("ids") - 1)).alias("w"), "ids", F.posexplode("ids").alias("k", "src"))
    together = first.select("src", F.explode(F.slice("ids", F.col("k") + 2, F.size("ids"))).alias("dst"), "w", F.lit("co_mention").alias("kind"))
    parts = said.unionByName(together).groupBy("src", "dst", "kind").agg(F.sum("w").alias("w"))
    return parts.groupBy("src", "dst").agg(F.sum("w").alias("weight"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def _ends(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.explode(F.array("src", "dst")).alias("entity_id"))


def degrees(entities: DataFrame, edges_: DataFrame) -> DataFrame:
    """Number of neighbours of each entity; 0 for one alone."""
    counted = _ends(edges_).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))
    return entities.select("entity_id").join(counted, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def hub_ids(entities: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return entities.where(F.col("name").isin(*names)).select("entity_id")


def core_edges(edges_: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges between entities that aren't hubs."""
    for end in ("src", "dst"):
        edges_ = edges_.join(hubs.select(F.col("entity_id").alias(end)), end, "left_anti")
    return edges_.select("src", "dst", "weight", "kinds")


def strongest(edges_: DataFrame, k: int = 2) -> DataFrame:
    """Edges among the k heaviest of either end; ties by the other end's id."""
    both = edges_.select("src", "dst", "weight", F.col("src").alias("at"), F.col("dst").alias("other")).unionByName(edges_.select("src", "dst", "weight", F.col("dst").alias("at"), F.col("src").alias("other")))
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("weight"), "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "weight").distinct()


def between_clusters(edges_: DataFrame, clusters: DataFrame) -> DataFrame:
    """Weight between each pair of different macro clusters."""
    own = clusters.where("macro_cluster >= 0").select("entity_id", "macro_cluster")
    a, b = own.select(F.col("entity_id").alias("src"), F.col("macro_cluster").alias("a")), own.select(F.col("entity_id").alias("dst"), F.col("macro_cluster").alias("b"))
    met = edges_.join(a, "src").join(b, "dst").where("a <> b")
    return met.groupBy(F.least("a", "b").alias("cluster_a"), F.greatest("a", "b").alias("cluster_b")).agg(F.sum("weight").alias("weight"))


def renumbered(labels: DataFrame, label: str = "label") -> DataFrame:
    """labels with numbers from 0 by falling size, then by old label."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    order = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.desc("size"), label)) - 1)
    return labels.join(order, label)


def pagerank(entities: DataFrame, edges_: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Weighted rank on the undirected graph by power iteration; what entities without edges hold is spread evenly."""
    nodes, edges_ = written(entities.select("entity_id").distinct(), "nodes"), written(edges_.select("src", "dst", "weight"), "edges")
    n = nodes.count()
    if not n or edges_.isEmpty():
        return nodes.select("entity_id", F.lit(0.0).alias("pagerank"))
    links = edges_.select("src", "dst", "weight").unionByName(edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = links.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = written(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "shares")
    lonely = nodes.join(out.select(F.col("src").alias("entity_id")), "entity_id", "left_anti")
    ranks = written(nodes.join(lonely.withColumn("lonely", F.lit(True)), "entity_id", "left").select("entity_id", F.coalesce("lonely", F.lit(False)).alias("lonely"), F.lit(1.0 / n).alias("rank")), "ranks")
    # What lonely entities hold changes by the same rule for all of them, so it is a number that needs no pass.
    alone, held = lonely.count(), 1.0 / n
    for k in range(rounds):
        sent = shares.join(ranks.select(F.col("entity_id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("entity_id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        base = (1 - damping) / n + damping * alone * held / n
        ranks = ranks.join(sent, "entity_id", "left").select("entity_id", "lonely", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        held = base
        if k % 5 == 4:
            ranks = written(ranks, "ranks")
    return ranks.select("entity_id", F.col("rank").alias("pagerank"))
