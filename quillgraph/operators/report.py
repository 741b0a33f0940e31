"""A one-page report from small result tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sparkline(shares: list[float], width: int = 120, height: int = 28) -> str:
    """SVG points from zero."""
    if not shares:
        return ""
    top, step = max(shares) or 1.0, width / max(len(shares) - 1, 1)
    return " ".join(f"{k * step:.1f},{height - s / top * height:.1f}" for k, s in enumerate(shares))


def findings(channels: list[dict], drivers: list[dict], trends: list[dict]) -> list[str]:
    """The channel gap, the largest source of negative reviews, the largest mover."""
    by, out = {c["source_group"]: c for c in channels}, []
    if {"organic", "invited"} <= by.keys():
        out.append(f"Organic reviews average {by['organic']['avg_stars']:.1f} stars, invited ones {by['invited']['avg_stars']:.1f}.")
    if drivers:
        out.append(f"{drivers[0]['interest_id']} accounts for about {drivers[0]['negative_reviews']} negative reviews.")
    moving = sorted((t for t in trends if t["trend"] in ("rising", "falling")), key=lambda t: (-abs(t["change_pp"]), str(t["interest_id"])))
    out.append(f"{moving[0]['interest_id']} moved most: {moving[0]['change_pp']:+.1f} points." if moving else "No interest rises or falls clearly.")
    return out


def render(headline: DataFrame, channels: DataFrame, drivers: DataFrame, trends: DataFrame, stakeholders: DataFrame, quotes: DataFrame) -> str:
    """HTML; each frame holds a few rows. A quote appears once over all cards."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    head, used, cards = rows(headline)[0], set(), []
    said = rows(quotes)
    for s in rows(stakeholders):
        own = [q for q in said if q["stakeholder"] == s["stakeholder"] and q["evidence"] not in used]
        used.update(q["evidence"] for q in own)
        lines = "".join(f"<blockquote>{html.escape(q['evidence'])}</blockquote>" for q in own)
        cards.append(f"<section><h2>{html.escape(s['stakeholder'])}</h2><p>{s['n_reviews']} reviews, {s['trend']}</p>{lines}</section>")
    figures = f"{head['n_reviews']:,} reviews, {head['avg_stars']:.2f} stars, {head['pct_negative']:.0%} negative"
    points = "".join(f"<li>{html.escape(f)}</li>" for f in findings(rows(channels), rows(drivers), rows(trends)))
    return f"<!doctype html><meta charset=utf-8><title>Summary</title><h1>{figures}</h1><ul>{points}</ul>{''.join(cards)}"


def lineage_dot(raws: list[tuple[str, str]], name: str) -> str:
    """The forms that lead to a name, as a DOT graph."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "digraph { rankdir=LR; " + " ".join(f"{quote(raw)} -> {quote(step)}; {quote(step)} -> {quote(name)};" for raw, step in raws) + " }"


# Colours by rank, and of all further clusters.
PALETTE = ("#2a78d6", "#eb6834", "#1baf7a", "#eda100", "#e87ba4", "#008300", "#4a3aa7", "#e34948")
OTHER = "#b4b2a9"


def cluster_colors(clusters: DataFrame, level: str = "macro") -> DataFrame:
    """(cluster, size, color): clusters by falling size take the palette in turn, the rest share one colour. One row a cluster, so the window is small."""
    sizes = clusters.select(F.col(f"{level}_cluster").cast("string").alias("cluster")).where("cluster <> '-1'").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(Window.orderBy(F.desc("size"), "cluster"))
    return sizes.withColumn("color", F.coalesce(F.get(F.array(*map(F.lit, PALETTE)), place - 1), F.lit(OTHER)))


def cluster_titles(clusters: DataFrame, interests: DataFrame, level: str = "macro") -> DataFrame:
    """(cluster, title): the interest's title (level, cluster, title); a micro cluster without one takes its macro cluster's, and what has none a general one."""
    found = clusters.select(F.col(f"{level}_cluster").cast("string").alias("cluster")).distinct()
    titles = lambda of, c, t: interests.where(F.col("level") == of).select(F.col("cluster").cast("string").alias(c), F.col("title").alias(t))
    named = found.join(titles(level, "cluster", "own"), "cluster", "left").withColumn("above", F.substring_index("cluster", ".", 1)).join(titles("macro", "above", "macro_title"), "above", "left")
    return named.select("cluster", F.coalesce("own", "macro_title", F.concat(F.lit("Minor cluster "), F.col("cluster"))).alias("title"))
