"""A vector index that is written and opened again: inverted lists over coarse centroids, ranked again exactly.

Centroids are fitted on a bounded sample of rows; every row is in the list of its nearest one. A query reads the lists of
its nearest centroids only, in blocks of bounded size, and what it finds there is ranked by exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .snapshots import cut
from .vectors import matrix

#: Rows that centroids are fitted on, rounds of fitting, rows of a block of a list, centroids at most.
SAMPLE, ROUNDS, BLOCK, MOST_LISTS = 100_000, 12, 4096, 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(rows: np.ndarray, lists: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means; a centroid that loses its rows takes the row that fits worst."""
    x = _unit(rows)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        sim = x @ centres.T
        of, best = sim.argmax(1), sim.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centres)) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def build(vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", column: str = "embedding", seed: int = 0, sample: int = SAMPLE) -> None:
    """Writes the index of vectors(id, vector): centroids, and rows by list and block. `lists` is the root of the rows if not given, MOST_LISTS at most.

    Rows with a null id, a null vector or one of zeros, or with a number that isn't finite, are not indexed; vectors have
    one length. Ids need not be unique. An empty table makes an empty index.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    n = rows.count()
    k = min(lists or max(1, round(math.sqrt(n))), MOST_LISTS)
    # The sample is bounded by a documented number; the rows of least hash, so that reruns agree.
    held = [r.v for r in rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").collect()] if n else []
    centres = fit(np.array(held, float), k, seed) if held else np.zeros((0, 0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = (_unit(matrix(pa.chunked_array([b.column("v")]))) @ centres.T).argmax(1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(of, pa.int32())], ["id", "v", "list"])

    dealt = cut(rows.mapInArrow(deal, "id long, v array<double>, list int"))
    # A list of any size is in blocks of about BLOCK rows; there are MOST_LISTS sizes at most.
    sizes = dealt.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = dealt.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    placed.repartition("list", "block").sortWithinPartitions("list", "block", "id").write.mode("overwrite").parquet(f"{path}/rows")
    table = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, itself: bool = False) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, id, distance), (query_id, lists, scanned)): the `k` nearest of queries(query_id, vector) by cosine distance, in the `probes` nearest lists, ties to the smaller id; and what was read for each.

    With as many probes as lists the search is exact. A row of the query's own id is left out unless `itself`. Queries
    with a null id or vector, or one of zeros, have no rows; their ids are unique.
    """
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    c = np.array([r.centre for r in centres], float).reshape(len(centres), -1) if centres else np.zeros((0, 0))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(c) or not b.num_rows:
                continue
            sim = _unit(matrix(pa.chunked_array([b.column("q")]))) @ c.T
            m = min(probes, len(c))
            at = np.argsort(-sim, axis=1, kind="stable")[:, :m]
            rows = np.repeat(np.arange(b.num_rows), m)
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(rows)), b.column("q").take(pa.array(rows)), pa.array(at.reshape(-1), pa.int32())], ["query_id", "q", "list"])

    wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q")).where("query_id is not null and q is not null").where(F.exists("q", lambda x: x != 0))
    asked = wanted.mapInArrow(near, "query_id long, q array<double>, list int")
    rows = spark.read.parquet(f"{path}/rows")
    blocks = rows.select("list", "block").distinct()
    sent = asked.join(blocks, "list").select("query_id", "q", F.col("list").alias("l"), F.col("block").alias("b"))

    def score(held: pa.Table, asked_: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        if len(held) and len(asked_):
            ids, who = held.column("id").to_numpy(), asked_.column("query_id").to_numpy()
            d = 1 - _unit(matrix(asked_.column("q"))) @ _unit(matrix(held.column("v"))).T
            if not itself:
                d[who[:, None] == ids[None]] = np.inf
            m = min(k, d.shape[1])
            order = np.lexsort((np.broadcast_to(ids, d.shape), np.round(d, 12)), axis=1)[:, :m]
            i, j = np.nonzero(np.isfinite(np.take_along_axis(d, order, 1)))
            out = [who[i], ids[order[i, j]], d[i, order[i, j]], np.full(len(i), len(ids))]
            # A row without a find still says how much was read.
            out = [np.concatenate([a, x]) for a, x in zip(out, (who, np.full(len(who), -1), np.full(len(who), np.nan), np.full(len(who), len(ids))), strict=True)]
        return pa.table(dict(zip(["query_id", "id", "distance", "scanned"], out, strict=True)))

    found = rows.groupBy("list", "block").cogroup(sent.groupBy("l", "b")).applyInArrow(score, "query_id long, id long, distance double, scanned long")
    best = found.where("not isnan(distance)").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round("distance", 12).alias("r"), "id", "distance"))), 1, k).alias("x"))
    hits = best.select("query_id", F.posexplode("x").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.id", "x.distance")
    read = found.where("isnan(distance)").groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("scanned").alias("scanned"))
    lists = asked.groupBy("query_id").agg(F.count("*").alias("lists"))
    return hits, lists.join(read, "query_id", "left").select("query_id", "lists", F.coalesce("scanned", F.lit(0)).cast("long").alias("scanned"))
