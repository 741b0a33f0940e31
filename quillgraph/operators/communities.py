"""Communities by the Leiden method (Traag, Waltman, van Eck 2019) on the Reichardt-Bornholdt objective.

Connected components can't share communities, so each is one group; the objective uses the whole graph's weight, so the
groups' results are those of the whole graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .graph import renumbered

#: Nodes in order, where the links of each begin and end, the links' other ends and weights, and the nodes' degrees.
Rows = tuple[list[int], list[int], list[int], memoryview, memoryview, list[float]]


def components(edges: DataFrame) -> DataFrame:
    """(entity_id, component): the least id of each component, by repeated minimum labels."""
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    labels = written(both.groupBy(F.col("src").alias("entity_id")).agg(F.min("dst").alias("near")).select("entity_id", F.least("entity_id", "near").alias("component")), "component")
    while True:
        offered = both.join(labels.withColumnRenamed("entity_id", "dst"), "dst").groupBy(F.col("src").alias("entity_id")).agg(F.min("component").alias("offer"))
        jump = labels.select(F.col("entity_id").alias("least"), F.col("component").alias("far"))
        after = labels.join(offered, "entity_id").withColumn("least", F.least("component", "offer")).join(jump, "least", "left")
        after = written(after.select("entity_id", F.coalesce(F.least("least", "far"), "least").alias("new"), "component"), "component")
        labels = after.select("entity_id", F.col("new").alias("component"))
        if after.where("new <> component").isEmpty():
            return labels


def _moved(rows: Rows, part: list[int], gamma: float, total: float, inside: list[int] | None = None) -> bool:
    """Moves nodes to the neighbouring community of the largest gain until none gains; inside: communities that may not be left, in which only nodes still alone move."""
    nodes, starts, ends, dst, w, degree = rows
    weight, size = [0.0] * len(part), [0] * len(part)
    for v in nodes:
        weight[part[v]] += degree[v]
        size[part[v]] += 1
    queue, changed = range(len(part)), False
    while queue:
        again: set[int] = set()
        for v in queue:
            here, own = part[v], degree[v]
            if inside is not None and size[here] > 1:
                continue
            near: dict[int, float] = {}
            beside = dst[starts[v] : ends[v]].tolist()
            for u, x in zip(beside, w[starts[v] : ends[v]].tolist(), strict=True):
                if u != v and (inside is None or inside[u] == inside[v]):
                    c = part[u]
                    near[c] = near.get(c, 0.0) + x
            weight[here] -= own
            scaled = gamma * own
            best, most = here, near.get(here, 0.0) - scaled * weight[here] / total
            for c in sorted(near):
                gain = near[c] - scaled * weight[c] / total
                if gain > most + 1e-12:
                    best, most = c, gain
            weight[best] += own
            if best != here:
                size[here] -= 1
                size[best] += 1
                part[v], changed = best, True
                again.update([u for u in beside if part[u] != best and u != v])
        queue = sorted(again)
    return changed


def _rows(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed links with repeated ones summed, each node's in one piece; nodes and neighbours in the order in which they first come."""
    n = int(src.max()) + 1
    _, came, place = np.unique(src, return_index=True, return_inverse=True)
    keys, first, at = np.unique(came[place] * n + dst, return_index=True, return_inverse=True)
    w, order = np.bincount(at, w, len(keys)), np.lexsort((first, keys // n))
    return src[first[order]], dst[first[order]], w[order]


def _settled(a: np.ndarray, b: np.ndarray, w: np.ndarray, gamma: float, total: float | None) -> np.ndarray:
    """The community of each of the nodes 0 to n - 1 as one of its nodes. Flat arrays hold the links: lists and dicts of them take ten times the memory."""
    src, dst, w = _rows(np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel(), np.repeat(w, 2))
    n = int(src.max()) + 1
    degree, names, owner, part = None, np.arange(n), np.arange(n), list(range(n))
    while True:
        cuts = np.flatnonzero(np.r_[True, src[1:] != src[:-1], True])
        nodes, starts, ends = src[cuts[:-1]], np.zeros(n, int), np.zeros(n, int)
        starts[nodes], ends[nodes] = cuts[:-1], cuts[1:]
        starts, ends, flat = starts.tolist(), ends.tolist(), memoryview(np.ascontiguousarray(w))
        if degree is None:
            degree = np.array([sum(flat[i:k].tolist()) for i, k in zip(starts, ends, strict=True)])
            total = total or sum(degree[nodes].tolist())
        rows = nodes.tolist(), starts, ends, memoryview(np.ascontiguousarray(dst)), flat, degree.tolist()
        _moved(rows, part, gamma, total)
        if len(set(part)) == n:
            return names[owner]
        fine = list(range(n))
        _moved(rows, fine, gamma, total, inside=part)
        if len(set(fine)) == n:
            fine = list(part)
        # The refined communities become the nodes of the next round, each in the community it came from.
        kinds, place = np.unique(fine, return_inverse=True)
        degree, came = np.bincount(place[nodes], degree[nodes], len(kinds)), np.zeros(len(kinds), int)
        came[place] = part
        _, first, at = np.unique(came, return_index=True, return_inverse=True)
        names, owner, part, n = names[kinds], place[owner], first[at].tolist(), len(kinds)
        src, dst, w = _rows(place[src], place[dst], w)


def leiden(links: list[tuple[int, int, float]], gamma: float, total: float | None = None) -> dict[int, int]:
    """Node to community. total: twice the weight of the whole graph."""
    if not links:
        return {}
    a, b, w = (np.array(x) for x in zip(*links, strict=True))
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    found = names[_settled(place[: len(a)], place[len(a) :], w.astype(float), gamma, total)]
    return dict(zip(names.tolist(), found.tolist(), strict=True))


def _labels(edges: DataFrame, by: str, gamma: float, whole: float | None) -> DataFrame:
    """by and (id, label): Leiden in each group of edges between numbered nodes."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b, w = (frame[c].to_numpy() for c in ("src", "dst", "weight"))
        order = np.lexsort((b, a))
        names, place = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
        found = _settled(place[: len(a)], place[len(a) :], w[order], gamma, whole)
        return pd.DataFrame({by: key[0], "id": names, "label": names[found]})

    # A number of partitions that is given keeps Spark from joining them by bytes: the work of a group is far more than its size tells.
    dealt = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    # Written, as it is read more than once.
    return written(dealt.groupBy(by).applyInPandas(run, f"{by} {edges.schema[by].dataType.simpleString()}, id long, label long"), "labels")


def hierarchy(entities: DataFrame, core: DataFrame, macro_gamma: float, micro_gamma: float) -> DataFrame:
    """(entity_id, macro_cluster, micro_cluster): macro communities by size, micro ones inside those of more than 3 members; -1 outside the core."""
    core = written(core.select("src", "dst", "weight"), "core")
    outside = entities.select("entity_id").distinct()
    if core.isEmpty():
        return outside.select("entity_id", F.lit(-1).alias("macro_cluster"), F.lit("-1").alias("micro_cluster"))
    whole = 2 * core.agg(F.sum("weight")).first()[0]
    # Numbers in the order of the names stand for them until the end: ties fall as by name.
    names = written(core.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct().orderBy("entity_id").withColumn("id", F.monotonically_increasing_id()), "names")
    links = core
    for end in ("src", "dst"):
        links = links.join(names.select(F.col("entity_id").alias(end), F.col("id").alias(f"{end}_id")), end)
    links = written(links.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight"), "links")
    grouped = links.join(components(links).withColumnRenamed("entity_id", "src"), "src")
    macro = written(renumbered(_labels(grouped, "component", macro_gamma, whole).select("id", "label")).select("id", F.col("number").alias("macro_cluster"), "size"), "macro")
    a, b = macro.select(F.col("id").alias("src"), F.col("macro_cluster").alias("macro"), "size"), macro.select(F.col("id").alias("dst"), F.col("macro_cluster").alias("macro_b"))
    inner = links.join(a, "src").join(b, "dst").where("macro = macro_b and size > 3").select("src", "dst", "weight", "macro")
    fine = _labels(inner, "macro", micro_gamma, None)
    sizes = fine.groupBy("macro", "label").agg(F.count(F.lit(1)).alias("n"))
    order = sizes.withColumn("number", F.row_number().over(Window.partitionBy("macro").orderBy(F.desc("n"), "label")) - 1)
    micro = fine.join(order, ["macro", "label"]).select("id", "number")
    named = macro.join(micro, "id", "left").join(names, "id").select("entity_id", "macro_cluster", F.concat_ws(".", F.col("macro_cluster").cast("string"), F.coalesce("number", F.lit(0)).cast("string")).alias("micro_cluster"))
    return outside.join(named, "entity_id", "left").select("entity_id", F.coalesce("macro_cluster", F.lit(-1)).alias("macro_cluster"), F.coalesce("micro_cluster", F.lit("-1")).alias("micro_cluster"))
