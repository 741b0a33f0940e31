"""python -m quillgraph run CSV FOLDER [--sample N] | report FOLDER: builds the gold tables, or the report from them."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import functions as F

from .operators import canonical, communities, extraction, gold, graph, insights, report, sampling, silver
from .plans.config import DEFAULT
from .session import session, ship
from .shared import remove_written, written
from .sources import reviews as source


def build(spark, csv: str, folder: str, sample: int | None = None, config=DEFAULT) -> None:
    clean = written(silver.reviews_clean(source.bronze(spark, csv), config), "silver")
    n = config.sample_size if sample is None else sample
    pool = clean.where("n_words > 0") if n >= clean.count() else silver.informative(clean, config)
    chosen = written(sampling.stratified_sample(clean, pool, n, config.seed), "sample")
    found = written(extraction.offline(chosen.select("review_id", F.col("text_for_extraction").alias("text")), config).select("review_id", "extraction"), "extractions")
    made = {k: written(v, k) for k, v in canonical.canonicalize(found, config).items()}
    mentions, triplets, entities = made["mentions"], made["triplets"], made["entities"]
    edges = written(graph.edges(mentions, triplets), "edges")
    core = graph.core_edges(edges, graph.hub_ids(entities, config.hubs))
    clusters = written(communities.hierarchy(entities, core, config.macro_resolution, config.micro_resolution), "clusters")
    stats = gold.entity_stats(entities, mentions, triplets, chosen, clusters, graph.pagerank(entities, edges))
    stats = stats.join(graph.degrees(entities, edges), "entity_id", "left")
    kept = written(gold.interests(clusters, mentions, triplets, chosen, config), "interests")
    weights = written(gold.review_weights(clusters, mentions, triplets, kept), "weights")
    told = gold.summaries(kept, stats, clusters)
    source.save(
        {
            "gold_reviews": gold.gold_reviews(chosen, mentions, weights), "gold_aspect_mentions": mentions, "gold_entities": stats, "gold_entity_lineage": made["lineage"],
            "gold_relations": graph.relations(triplets), "gold_interests": kept.join(told, "interest_id", "left"), "gold_review_interests": weights,
        },
        folder,
    )
    source.graph_json(stats.select("entity_id", "name"), edges, f"{folder}/graph.json")


def write_report(spark, folder: str, config=DEFAULT) -> str:
    t = source.load(spark, folder)
    reviews, interests, mentions = t["gold_reviews"], t["gold_interests"], t["gold_aspect_mentions"]
    trends = insights.interest_trends(t["gold_review_interests"], interests, reviews, "macro", config)
    hubs = graph.hub_ids(t["gold_entities"], config.hubs)
    return report.render(insights.headline(reviews, interests, t["gold_entities"]), insights.channel_stats(reviews), insights.negative_drivers(trends), trends, insights.stakeholder_metrics(mentions, reviews, config), insights.stakeholder_quotes(mentions, reviews, hubs, config))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("csv")
    run.add_argument("folder")
    run.add_argument("--sample", type=int)
    shown = commands.add_parser("report")
    shown.add_argument("folder")
    shown.add_argument("--out", default="report.html")
    given = parser.parse_args(arguments)
    spark = session()
    ship(spark)
    if given.command == "run":
        build(spark, given.csv, given.folder, given.sample)
        remove_written(spark)
    else:
        Path(given.out).write_text(write_report(spark, given.folder))


if __name__ == "__main__":
    main()
