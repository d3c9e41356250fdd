"""Benchmark runs of scoring methods: what a method and version have scored is not scored again, and a method is taken up only on evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import external
from .evalstats import bootstrap, classed

CACHE = "key string, version string, score double"


def cached(spark: SparkSession, path: str) -> DataFrame:
    """Scores kept under a path; none before the first run."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def predictions(items: DataFrame, methods: dict[str, tuple[list[str], str]], cache: str, timeout: float = 30.0) -> tuple[DataFrame, dict[str, int]]:
    """items(id, text, ...) with a score column of each method (command, version), and how many texts each was asked for. New scores are added to `cache`, so that a second run asks for none."""
    spark, out, asked = items.sparkSession, items, {}
    for name, (command, version) in methods.items():
        scored, new = external.scored(items.select("id", "text"), "text", command, version, cached(spark, cache), timeout=timeout)
        asked[name] = new.count()
        if asked[name]:
            new.write.mode("append").parquet(cache)
        out = out.join(scored.select("id", F.col("score").alias(name)), "id", "left")
    return out, asked


def decision(scored: DataFrame, present: str, proposed: str, thresholds: dict[str, float], by: str = "set", times: int = 5000, seed: int = 0) -> DataFrame:
    """(set, n, value, low, high, ahead, adopt) of scored(set, gold, scores): the lead of the proposed method over the present one in macro F1 with its paired interval, by set. It is adopted if it is ahead, the whole interval above 0, on every set."""
    rows = scored.withColumn("a", classed(F.col(proposed), thresholds[proposed])).withColumn("b", classed(F.col(present), thresholds[present]))
    names = [r[0] for r in rows.select(by).where(F.col(by).isNotNull()).distinct().orderBy(by).collect()]
    if not names:
        raise ValueError("no set to decide on")
    each = reduce(DataFrame.unionByName, (bootstrap(rows.where(F.col(by) == n), "gold", "a", "b", times, seed).select(F.lit(n).alias(by), "*") for n in names))
    each = each.withColumn("ahead", F.coalesce(F.col("low") > 0, F.lit(False)))
    return each.crossJoin(F.broadcast(each.agg(F.bool_and("ahead").alias("adopt"))))


def disagreements(scored: DataFrame, present: str, proposed: str, thresholds: dict[str, float]) -> DataFrame:
    """Distinct texts on which two methods' classes differ: text, gold, both classes, and which of them is right (neither, if none is)."""
    a, b = (classed(F.col(m), thresholds[m]) for m in (present, proposed))
    rows = scored.select("text", "gold", a.alias("present"), b.alias("proposed")).where("present <> proposed").dropDuplicates(["text"])
    return rows.withColumn("right", F.when(F.col("gold") == F.col("present"), "present").when(F.col("gold") == F.col("proposed"), "proposed").otherwise("neither"))
