"""What outlets of one story share and differ in: coverage, figure digest, differences, contention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def coverage(claims: DataFrame, outlets: DataFrame) -> DataFrame:
    """claims (story, grp, source, same) and outlets (story, source, readable) -> per group: reported_by, related, omitted_by. An outlet that couldn't be read never omits."""
    readable = outlets.where("readable").groupBy("story").agg(F.array_sort(F.collect_set("source")).alias("readable"))
    groups = claims.groupBy("story", "grp").agg(F.array_sort(F.collect_set(F.when(F.col("same"), F.col("source")))).alias("reported_by"), F.array_sort(F.collect_set(F.when(~F.col("same"), F.col("source")))).alias("maybe"))
    related = F.array_except("maybe", "reported_by")
    return groups.join(readable, "story", "left").select("story", "grp", "reported_by", related.alias("related"), F.array_except(F.array_except(F.coalesce("readable", F.array().cast("array<string>")), "reported_by"), related).alias("omitted_by"))


#: Tasks that stories are dealt over for each task that reads figures.
SHARE = 16


def digest(figures: DataFrame) -> DataFrame:
    """figures (story, pos, source, sentence, unit, value): the largest of each outlet's sentence and unit, the rest as breakdown; repeats dropped; peers = same unit, other outlet.

    Stories are dealt once, over so many tasks that each has a SHARE of what a reading task reads: what a task sorts does
    not grow with the table."""
    spark = figures.sparkSession
    figures = figures.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), SHARE * figures.rdd.getNumPartitions()), "story")
    own = Window.partitionBy("story", "source", "sentence", "unit").orderBy(F.desc("value"), "pos")
    all_ = Window.partitionBy("story", "source", "sentence", "unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = figures.withColumn("rn", F.row_number().over(own)).withColumn("breakdown", F.collect_list("value").over(all_)).where("rn = 1")
    first = Window.partitionBy("story", "source", "value", "unit").orderBy("pos")
    top = top.withColumn("k", F.row_number().over(first)).where("k = 1")
    unit, both = Window.partitionBy("story", "unit"), Window.partitionBy("story", "unit", "source")
    peers = F.count("*").over(unit) - F.count("*").over(both)
    return top.select("story", "pos", "source", "unit", "value", F.filter("breakdown", lambda v: v != F.col("value")).alias("breakdown"), peers.alias("peers"), F.when(peers > 0, "shared").otherwise("single").alias("tier"))


def spread_holds(low: Column, high: Column, casualties: Column) -> Column:
    """Rival figures are comparable up to a factor of 3, of 100 for casualties."""
    return high <= low * F.when(casualties, 100).otherwise(3)


def differences(related: Column, figure_groups: Column, relations: Column, gap: Column) -> Column:
    """Related facts, rival figure groups, changed quotes, and one if tone is half a point apart. Omissions count for nothing."""
    changed = F.size(F.filter(relations, lambda r: ~r.isin("first", "same")))
    return F.coalesce(related, F.lit(0)) + F.coalesce(figure_groups, F.lit(0)) + F.greatest(changed, F.lit(0)) + F.when(F.coalesce(gap, F.lit(0.0)) >= 0.5, 1).otherwise(0)


def contention(disputed_share: Column, topic_hot: Column, contested_quotes: Column) -> Column:
    return disputed_share + F.when(topic_hot, 0.25).otherwise(0.0) + 0.25 * contested_quotes


def number_sections(figures: DataFrame, groups: DataFrame) -> DataFrame:
    """Each digest figure as grouped, ungrouped (its unit has peers) or solo."""
    held = groups.select("story", "pos", F.lit(True).alias("g"))
    return figures.join(held, ["story", "pos"], "left").withColumn("section", F.when(F.col("g"), "grouped").when(F.col("peers") > 0, "ungrouped").otherwise("solo")).drop("g")
