"""Stories over a sliding window, run after run: ids continue, changed stories lose their analysis, and all tables change at once.

A run writes new versions of its tables and then one row of a manifest that names them all. Readers take the newest
row, so they see the state before a run or after it, whenever it ends.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .clustering import continuity
from .density import cluster
from .snapshots import checkpoint_ready, cut
from .vectors import coherence

MEMBERS = "cluster_id long, article_id long"
CLUSTERS = "cluster_id long, article_count long, coherence double, status string, run long"
ANALYSES = "cluster_id long, analysis string"


class Degenerate(Exception):
    """One cluster holds more of the window than is believable; nothing was written."""


class Overtaken(Exception):
    """Another run was committed in between; nothing was changed."""


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """(run, path by table) of the newest row; (0, {}) before the first."""
    try:
        rows = spark.read.parquet(f"{root}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    newest = rows.orderBy(F.desc("run"), "stamp").first()
    return (newest["run"], dict(newest["paths"])) if newest else (0, {})


def state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest committed run."""
    return {name: spark.read.parquet(path) for name, path in _manifest(spark, root)[1].items()}


def commit_all(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int | None = None) -> int:
    """Writes a version of each table, then the manifest row that makes them, with the tables not named, the state; returns its run number.

    With `after`, it is refused if the newest run is another one. Of two rows of one run the earlier holds.
    """
    run, paths = _manifest(spark, root)
    if after is not None and run != after:
        raise Overtaken(f"run {run} came after {after}")
    stamp = time.time_ns()
    for name, df in tables.items():
        paths[name] = f"{root}/{name}/v-{run + 1}-{stamp}"
        df.write.parquet(paths[name])
    if after is not None and _manifest(spark, root)[0] != after:
        raise Overtaken(f"a run came after {after}")
    row = spark.createDataFrame([(run + 1, stamp, paths)], "run long, stamp long, paths map<string,string>")
    row.coalesce(1).write.mode("append").parquet(f"{root}/_manifest")
    return run + 1


def recluster(spark: SparkSession, root: str, articles: DataFrame, days: int = 7, least: int = 2, samples: int = 1, share: float = 0.5, most: float = 0.25) -> dict[str, int]:
    """articles(article_id, vector, published): clusters the last `days` before the newest and commits members, clusters and analyses at once; how many stories are unchanged, changed, new and ended.

    A story that shares `share` of the smaller side with one of the state keeps its id, the best matches first; new ids
    are never reused. One whose members are the same keeps status and analysis, others become pending; ended ones go.
    Raises Degenerate, and changes nothing, if one cluster has more than `most` of the window.
    """
    checkpoint_ready(spark)
    run, paths = _manifest(spark, root)
    held = {n: spark.read.parquet(paths[n]) if n in paths else spark.createDataFrame([], kind) for n, kind in (("members", MEMBERS), ("clusters", CLUSTERS), ("analyses", ANALYSES))}
    newest = articles.agg(F.max("published").alias("newest"))
    window = cut(articles.crossJoin(F.broadcast(newest)).where(F.col("published") >= F.col("newest") - F.make_dt_interval(F.lit(days))).select(F.lit(0).cast("long").alias("window"), F.col("article_id").alias("id"), "vector"))
    found = cut(cluster(window, least, samples).where("label >= 0").select("label", F.col("id").alias("article_id")))
    largest = found.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    if largest > most * window.count():
        raise Degenerate(f"one cluster has {largest} articles")
    kept = continuity(held["members"], found, share) if paths else spark.createDataFrame([], "label long, cluster_id long")
    # A run's new stories are numbered within its own range of ids.
    ids = found.select("label").distinct().join(kept, "label", "left").select("label", F.coalesce("cluster_id", F.lit(run + 1) * (1 << 32) + F.col("label")).alias("cluster_id"), F.col("cluster_id").isNotNull().alias("continues"))
    ids = cut(ids)
    members = cut(found.join(ids, "label").select("cluster_id", "article_id"))
    before, now = (m.groupBy("cluster_id").agg(F.count("*").alias(n)) for m, n in ((held["members"], "old"), (members, "article_count")))
    both = members.join(held["members"], ["cluster_id", "article_id"]).groupBy("cluster_id").agg(F.count("*").alias("both"))
    tight = coherence(members.join(window.select(F.col("id").alias("article_id"), "vector"), "article_id"), "cluster_id", "vector").select("cluster_id", "coherence")
    same = F.coalesce((F.col("old") == F.col("both")) & (F.col("article_count") == F.col("both")), F.lit(False))
    states = now.join(before, "cluster_id", "left").join(both, "cluster_id", "left").join(tight, "cluster_id").join(held["clusters"].select("cluster_id", F.col("status").alias("was"), F.col("run").alias("since")), "cluster_id", "left")
    clusters = cut(states.select("cluster_id", "article_count", "coherence", F.when(same, F.col("was")).otherwise("pending").alias("status"), F.when(same, F.col("since")).otherwise(F.lit(run + 1)).cast("long").alias("run"), same.alias("same"), F.col("old").isNotNull().alias("continues")))
    analyses = held["analyses"].join(clusters.where("same").select("cluster_id"), "cluster_id", "left_semi")
    unchanged, changed, new = clusters.agg(F.count_if("same"), F.count_if(F.col("continues") & ~F.col("same")), F.count_if(~F.col("continues"))).first()
    counts = {"unchanged": unchanged, "changed": changed, "new": new, "ended": before.count() - unchanged - changed}
    commit_all(spark, root, {"members": members, "clusters": clusters.drop("same", "continues"), "analyses": analyses}, after=run)
    return counts


def each_batch(root: str, history: str, **settings) -> Callable[[DataFrame, int], None]:
    """foreachBatch for a stream of articles(article_id, vector, published): keeps each batch in `history`, written over if it is replayed, and clusters the window anew over all of them."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")
        seen = spark.read.parquet(history).drop("batch").dropDuplicates(["article_id"])
        if seen.head(1):
            recluster(spark, root, seen, **settings)

    return run
