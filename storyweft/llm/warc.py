"""Merkle fixity audit of WARC replicas, in built-in DataFrame functions.

A file holds the records of a range of ids. Leaves hash whole WARC records; every inner node hashes the ordered digests
of a fixed-width range of slots, so a lost or added record changes its own branch only, and carries the byte range it
spans in the file. Replicas compare roots, then only the children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Slots of a file, and how many children a node has.
SLOTS, FAN = 1000, 10


def record(url: Column, body: Column) -> Column:
    """A WARC/1.0 response record of a page; null counts as empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, file, slot, length, digest) per row. Rows without an id go to the files -1 to -64 by digest."""
    whole = record(F.col(url_col), F.col(body_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"))
    lost = F.pmod(F.xxhash64("digest"), F.lit(64 * SLOTS))
    return rows.withColumn("file", F.when(F.col("id").isNull(), -1 - F.floor(lost / SLOTS)).otherwise(F.floor(F.col("id") / SLOTS)).cast("long")).withColumn(
        "slot", F.coalesce(F.pmod("id", F.lit(SLOTS)), F.pmod(lost, F.lit(SLOTS))).cast("long")
    )


def manifest(pages: DataFrame, **cols: str) -> DataFrame:
    """`records` with each record's offset in its file; records stand by slot, those of one slot by digest."""
    own = Window.partitionBy("file").orderBy("slot", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records(pages, **cols).withColumn("offset", F.coalesce(F.sum("length").over(own), F.lit(0)))


def tree(entries: DataFrame) -> DataFrame:
    """(level, file, node, digest, start, stop): level 0 is a slot, the highest level the file's root."""
    level = entries.groupBy("file", F.col("slot").alias("node")).agg(
        F.sha2(F.concat_ws("", F.array_sort(F.collect_list("digest"))), 256).alias("digest"), F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop")
    )
    out, depth, width = level.withColumn("level", F.lit(0)), 0, SLOTS
    while width > 1:
        depth, width = depth + 1, -(-width // FAN)
        level = level.groupBy("file", F.floor(F.col("node") / FAN).alias("node")).agg(
            F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node", "digest")))), 256).alias("digest"), F.min("start").alias("start"), F.max("stop").alias("stop")
        )
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out


def descend(left: DataFrame, right: DataFrame) -> DataFrame:
    """Slots at which two trees differ, (file, node, start, stop, in_left, in_right): roots first, then only below nodes that differ."""
    depth, width = 0, SLOTS
    while width > 1:
        depth, width = depth + 1, -(-width // FAN)
    open_ = None
    for level in range(depth, -1, -1):
        sides = []
        for t in (left, right):
            t = t.where(F.col("level") == level)
            if open_ is not None:
                t = t.withColumn("up", F.floor(F.col("node") / FAN)).join(open_.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi")
            sides.append(t.select("file", "node", "digest", "start", "stop"))
        a, b = sides[0].alias("a"), sides[1].alias("b")
        open_ = (
            a.join(b, ["file", "node"], "full_outer")
            .where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
            .select("file", "node", F.coalesce("a.start", "b.start").alias("start"), F.coalesce("a.stop", "b.stop").alias("stop"), F.col("a.digest").isNotNull().alias("in_left"), F.col("b.digest").isNotNull().alias("in_right"))
        )
    return open_


def audit(pages: DataFrame, replica: DataFrame, **cols: str) -> DataFrame:
    """One row per record of `pages`, and per slot that only the replica has: page_id, warc_file, slot, warc_offset, record_length, record_sha256, status.

    status is ok, corrupt (the slot's records differ), missing (the replica has none there) or extra (only the replica
    has it; length and digest are null). Null texts count as empty; rows without an id are held by digest; records of
    one id share a slot and its status; two empty tables give no rows. Other columns are ignored.
    """
    mine = cut(manifest(pages, **cols))
    other = cut(manifest(replica, **cols))
    bad = cut(descend(cut(tree(mine)), cut(tree(other))))
    status = F.when(F.col("in_right").isNull(), "ok").when(F.col("in_right"), "corrupt").otherwise("missing")
    found = mine.join(bad.where("in_left").select("file", F.col("node").alias("slot"), "in_right"), ["file", "slot"], "left").select("id", "file", "slot", "offset", "length", "digest", status.alias("status"))
    extra = bad.where("not in_left").select(
        F.when(F.col("file") >= 0, F.col("file") * SLOTS + F.col("node")).alias("id"), "file", F.col("node").alias("slot"), F.col("start").alias("offset"),
        F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("digest"), F.lit("extra").alias("status"),
    )
    names = {"id": "page_id", "file": "warc_file", "slot": "slot", "offset": "warc_offset", "length": "record_length", "digest": "record_sha256", "status": "status"}
    return found.unionByName(extra).select(*[F.col(a).alias(b) for a, b in names.items()])
