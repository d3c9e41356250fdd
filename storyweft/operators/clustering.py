"""Clusters of a window (HDBSCAN, from the published algorithm), their guard, and stable ids between runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .density import cluster, dense_tree, tree_labels
from .vectors import distances


def hdbscan(x: np.ndarray, least: int = 2, samples: int = 1, epsilon: float = 0.0) -> np.ndarray:
    """Labels (-1: noise) of a few points held in memory; `density.cluster` is the same over tables."""
    n = len(x)
    if n < max(least, 2):
        return np.full(n, -1)
    d = distances(x, x)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    return tree_labels(n, *dense_tree(np.maximum(d, np.maximum(core[:, None], core[None]))), least, epsilon)


def cluster_window(vectors: DataFrame, least: int = 2, samples: int = 1) -> DataFrame:
    """(window, id, label) of vectors(window, id, vector)."""
    return cluster(vectors, least, samples)


def degenerate(members: DataFrame, most: float = 0.25) -> bool:
    """Whether one cluster holds so much of the window that the result is to be rejected."""
    row = members.groupBy("label").count().agg(F.max(F.when(F.col("label") >= 0, F.col("count"))).alias("m"), F.sum("count").alias("n")).first()
    return bool(row["m"] and row["m"] / row["n"] > most)


def match_clusters(previous: dict[int, set], current: dict[int, set], share: float = 0.5) -> dict[int, int]:
    """New label -> id kept: greedy one to one by members shared, Jaccard, old id, label; at least `share` of the smaller side."""
    found = []
    for old, a in previous.items():
        for new, b in current.items():
            both = len(a & b)
            if both and both / min(len(a), len(b)) >= share:
                found.append((-both, -both / len(a | b), old, new))
    out: dict[int, int] = {}
    for *_, old, new in sorted(found):
        if new not in out and old not in out.values():
            out[new] = old
    return out


def continuity(old: DataFrame, new: DataFrame, share: float = 0.5) -> DataFrame:
    """(label, cluster_id) kept, for old (cluster_id, article_id) and new (label, article_id): the greedy order of `match_clusters`, as rounds in which pairs that are each other's best are matched, until none is open; the best of all is matched in each."""
    a = old.groupBy("cluster_id").agg(F.count("*").alias("na"))
    b = new.groupBy("label").agg(F.count("*").alias("nb"))
    both = old.join(new, "article_id").groupBy("cluster_id", "label").agg(F.count("*").alias("shared")).join(a, "cluster_id").join(b, "label")
    rank = F.struct((-F.col("shared")).alias("s"), (-F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("j"), "cluster_id", "label")
    open_ = both.where(F.col("shared") / F.least("na", "nb") >= share).select("cluster_id", "label", rank.alias("k")).checkpoint()
    done = None
    while True:
        first = open_.groupBy("cluster_id").agg(F.min("k").alias("k")).select("k").intersect(open_.groupBy("label").agg(F.min("k").alias("k")).select("k")).select("k.label", "k.cluster_id").checkpoint()
        done = first if done is None else done.unionByName(first)
        open_ = open_.join(first.select("label"), "label", "left_anti").join(first.select("cluster_id"), "cluster_id", "left_anti").checkpoint()
        if not open_.head(1):
            return done
