"""The published story list, with all its parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SORTS = {"outlets": ["outlets", "article_count"], "latest": ["latest"]}


def stories(members: DataFrame, floor: float | None = None, topic: str | None = None, source: str | None = None, least_outlets: int = 2) -> DataFrame:
    """One row per cluster of `members` (cluster_id, article_id, source, title, category, published, coherence): filters are added only where set."""
    if floor is not None:
        members = members.where(F.col("coherence") >= floor)
    rows = members.groupBy("cluster_id").agg(
        F.countDistinct("source").alias("outlets"), F.count("*").alias("article_count"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.max("published").alias("latest"), F.max_by("title", F.struct("published", "article_id")).alias("latest_title"), F.max("category").alias("topic"),
        *([F.bool_or(F.col("source") == source).alias("wanted")] if source is not None else []),
    )
    rows = rows.where(F.col("outlets") >= least_outlets)
    if topic is not None:
        rows = rows.where(F.coalesce("topic", F.lit("General")) == topic)
    return rows.where("wanted").drop("wanted") if source is not None else rows


def page(rows: DataFrame, sort: str = "outlets", limit: int = 20, offset: int = 0) -> DataFrame:
    if sort not in SORTS or not 1 <= limit <= 100 or not 0 <= offset <= 100_000:
        raise ValueError("sort must be outlets or latest, limit 1 to 100, offset 0 to 100000")
    return rows.orderBy(*[F.desc_nulls_last(c) for c in SORTS[sort]], "cluster_id").offset(offset).limit(limit)


def status(row_analysed, row_headline):
    return F.when(row_analysed, "analysed").when(row_headline, "headline only").otherwise("not analysed")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed merge: what `new` has wins, other columns and rows of `old` stay; the next snapshot of a table."""
    a, b = old.alias("a"), new.alias("b")
    cols = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}") for c in old.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*cols)


def insert_new(known: DataFrame, candidates: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates that are not known, the first of each key."""
    first = candidates.groupBy(key).agg(F.min_by(F.struct(*candidates.columns), order).alias("row")).select("row.*")
    return first.join(known.select(key), key, "left_anti")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stories whose members changed between snapshots (cluster_id, article_id): their analyses are void."""
    both = old.select("cluster_id", "article_id", F.lit(1).alias("o")).join(new.select("cluster_id", "article_id", F.lit(1).alias("n")), ["cluster_id", "article_id"], "full_outer")
    return both.where("o is null or n is null").select("cluster_id").distinct()


def comparable(readable: Column, facts: Column) -> Column:
    """A story that can be compared: two readable outlets or more and a shared fact; unknown while its facts are."""
    return F.when(facts.isNotNull(), (F.size(F.array_compact(readable)) >= 2) & (F.size(F.array_compact(facts)) > 0))


def next_status(current: Column, asked: Column, error: Column) -> Column:
    """A story's state after a run: a deep analysis stays, an error is recorded, else what was asked for is there."""
    return F.when(current == "deep", current).when(error.isNotNull(), "failed").otherwise(asked)
