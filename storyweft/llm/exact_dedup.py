"""Exact dedup with a heavy-hitter split, in built-in DataFrame functions only.

Digests are computed once. Misra-Gries counters (DataFrame.freqItems, at most 1/support of them) propose frequent
digests; their exact counts verify the winners, which are broadcast, so that their rows never move. The rest is dealt
by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import lowered

#: A digest with more than this share of all rows is certain to be proposed; at most 1 / SUPPORT are, so at most that many are broadcast.
SUPPORT = 1 / 1000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256; equal texts (A-Z lower-cased) form a group and its largest id stays.

    Null text counts as empty. A null id never stays beside another id; in a group of null ids only, keep_id is null
    and kept is false. Repeated ids are separate rows, each counted; all rows with the group's largest id are kept. An
    empty table gives no rows; other columns are ignored.
    """
    from .common import shared_dir

    shared_dir(docs.sparkSession)
    digests = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(lowered(F.col(text_col)), 256)).alias("digest")).checkpoint()
    proposed = digests.select(F.hex("digest").alias("h")).freqItems(["h"], support).select(F.explode("h_freqItems").alias("h")).select(F.unhex("h").alias("digest"))
    heavy = (
        digests.join(F.broadcast(proposed), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("id").alias("keep"))
        .crossJoin(F.broadcast(digests.agg(F.count("*").alias("rows"))))
        .where(F.col("n") > F.col("rows") * support)
        .select("digest", "n", "keep")
        .checkpoint()
    )
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    own = Window.partitionBy("digest")
    rest = marked.where("n is null").select("id", "digest", F.count("*").over(own).alias("n"), F.max("id").over(own).alias("keep"))
    return (
        marked.where("n is not null").select("id", "digest", "n", "keep")
        .unionByName(rest)
        .select(
            F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
            F.coalesce(F.col("id") == F.col("keep"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
