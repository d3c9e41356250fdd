"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; a temporary one only where it is unset, as in local tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: the lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fanout(spark: SparkSession) -> int:
    """How many buckets keyed data is dealt to: the session's shuffle partitions, so that it grows with what the cluster is set up for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def unused(taken: list[str], *names: str) -> list[str]:
    """`names`, with as many underscores before them as keep them apart from columns that are there."""
    held, mark = {c.lower() for c in taken}, "_"
    while any((mark + n).lower() in held for n in names):
        mark += "_"
    return [mark + n for n in names]


def lowered(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(column, n: int):
    """A bucket in [0, n) from a column's hash; null has a bucket too."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of `edges(a, b)`: rows `(id, component)` for every id that has an edge, component being the least id reachable.

    Alternating large-star and small-star rounds, each cut in the shared folder; ends when a round changes nothing.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        pairs = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    stars = pairs.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("id"), "component").unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
