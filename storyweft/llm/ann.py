"""Nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

Vectors get one more component so that all have the same length; then the largest inner product is the nearest in
Euclidean distance. Batches of vectors search the graph built so far greedily; what they visited is pruned with a
relaxed distance rule that keeps diverse edges, and edges back are pruned alike. A beam search answers a block of
queries on every shard; the best over all shards remain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, fanout

#: Vectors in a shard: at most, and at least while the cluster has more partitions than shards. Larger shards are searched with less work in all.
SHARD, LEAST_SHARD = 1 << 18, 1 << 14
#: Edges of a vector, beam in building and in queries, relaxations of the two passes, queries in a block, blocks that a task reads a shard for.
DEGREE, BUILD_BEAM, BEAM, RELAX, BLOCK, SLAB = 32, 48, 96, (1.0, 1.2), 512, 64


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, want_visited: bool = False):
    """Best rows of x by inner product for each row of q, best first (-1: none left); with `want_visited`, also the rows each query opened."""
    n, m = len(x), len(q)
    beam = min(beam, n)
    ids = np.full((m, beam), -1, np.int64)
    sim = np.full((m, beam), -np.inf, np.float32)
    done = np.zeros((m, beam), bool)
    seen = np.zeros((m, n), bool)
    ids[:, 0], sim[:, 0] = start, q @ x[start]
    seen[:, start] = True
    live, opened = np.arange(m), []
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        has = open_.any(axis=1)
        live, open_ = live[has], open_[has]
        if not len(live):
            break
        slot = open_.argmax(axis=1)  # the beam is sorted: the first open one is the best
        node = ids[live, slot]
        done[live, slot] = True
        if want_visited:
            opened.append((live, node))
        near = graph[node]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        s = np.where(fresh, np.einsum("qd,qrd->qr", q[live], x[near]), -np.inf).astype(np.float32)
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
        all_sim = np.concatenate((sim[live], s), axis=1)
        all_done = np.concatenate((done[live], np.zeros_like(fresh)), axis=1)
        top = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        ids[live], sim[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sim, all_done))
    if not want_visited:
        return ids
    visited: list[list[int]] = [[] for _ in range(m)]
    for who, node in opened:
        for w, v in zip(who.tolist(), node.tolist(), strict=True):
            visited[w].append(v)
    return ids, visited


def prune(x: np.ndarray, node: int, near: np.ndarray, relax: float) -> np.ndarray:
    """Edges of a node: the nearest first; a later one is dropped if it is, by the factor `relax`, nearer to one taken than to the node."""
    near = np.unique(near[near != node])
    if len(near) <= 1:
        return near
    v = x[near]
    d = ((v - x[node]) ** 2).sum(axis=1)
    order = np.argsort(d, kind="stable")
    near, v, d = near[order], v[order], d[order]
    sq = (v * v).sum(axis=1)
    between = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
    alive, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if alive[i]:
            out.append(i)
            if len(out) == DEGREE:
                break
            alive &= relax * relax * between[i] > d
    return near[out]


def build(x: np.ndarray, seed: int = 11) -> tuple[np.ndarray, int]:
    """(graph: rows of DEGREE neighbours, padded with -1; the entry, nearest to the mean). x: vectors of equal length, all different. Edges back may fill a row to twice DEGREE before it is pruned."""
    n = len(x)
    rng = np.random.default_rng(seed)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, 2 * DEGREE), -1, np.int64)
    many = np.zeros(n, np.int64)

    def put(node: int, edges: np.ndarray) -> None:
        graph[node, : len(edges)], graph[node, len(edges) :] = edges, -1
        many[node] = len(edges)

    k = min(DEGREE // 2, n - 1)
    if k > 0:
        first = rng.integers(0, n, (n, k))
        graph[:, :k] = np.where(first == np.arange(n)[:, None], (first + 1) % n, first)
        many[:] = k
    for relax in RELAX:
        order = rng.permutation(n)
        for a in range(0, n, 256):
            batch = order[a : a + 256]
            _, visited = beam_search(x, graph, start, x[batch], BUILD_BEAM, want_visited=True)
            to, by = [], []
            for node, seen in zip(batch.tolist(), visited, strict=True):
                edges = prune(x, node, np.concatenate((graph[node, : many[node]], np.array(seen, np.int64))), relax)
                put(node, edges)
                to.append(edges)
                by.append(np.full(len(edges), node))
            to, by = np.concatenate(to), np.concatenate(by)
            new = ~(graph[to] == by[:, None]).any(axis=1)
            order_ = np.argsort(to[new], kind="stable")
            to, by = to[new][order_], by[new][order_]
            ends, at, count = np.unique(to, return_index=True, return_counts=True)
            fits = many[ends] + count <= 2 * DEGREE
            easy = np.repeat(fits, count)
            place = many[to] + np.arange(len(to)) - np.repeat(at, count)
            graph[to[easy], place[easy]] = by[easy]
            many[ends[fits]] += count[fits]
            for e, i, c in zip(ends[~fits].tolist(), at[~fits].tolist(), count[~fits].tolist(), strict=True):
                put(e, prune(x, e, np.concatenate((graph[e, : many[e]], by[i : i + c])), relax))
    for node in np.flatnonzero(many > DEGREE).tolist():
        put(node, prune(x, node, graph[node, : many[node]], RELAX[-1]))
    return graph[:, :DEGREE], start


def _augmented(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    return np.concatenate((x, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]), axis=1).astype(np.float32)


def _index(table: pa.Table) -> pa.Table:
    """One shard: distinct vectors, their ids in order, and the graph over them."""
    table = table.sort_by([("id", "ascending")])
    ids, raw = table.column("id").to_numpy(), np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(table), -1)
    x, of = np.unique(raw, axis=0, return_inverse=True)
    order = np.argsort(of.reshape(-1), kind="stable")
    count = np.bincount(of.reshape(-1), minlength=len(x))
    graph, start = build(_augmented(x))
    blob = [np.ascontiguousarray(b).tobytes() for b in (x, ids[order], count, graph.astype(np.int32))]
    return pa.table({"shard": table.column("shard").slice(0, 1), "start": pa.array([start], pa.int64()), "dim": pa.array([x.shape[1]], pa.int32()), **{k: pa.array([b], pa.binary()) for k, b in zip(("x", "ids", "count", "graph"), blob, strict=True)}})


def _answer(k: int):
    """A slab of query blocks on one shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for row in left.to_pylist():
            x = np.frombuffer(row["x"], np.float64).reshape(-1, row["dim"])
            ids, count = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["count"], np.int64)
            graph = np.frombuffer(row["graph"], np.int32).reshape(len(x), DEGREE).astype(np.int64)
            near, first = _augmented(x), np.concatenate(([0], np.cumsum(count)))
            for asked in right.sort_by("block").to_pylist():
                q, qid = np.frombuffer(asked["qv"], np.float64).reshape(-1, row["dim"]), np.frombuffer(asked["qid"], np.int64)
                aug = np.concatenate((q, np.zeros((len(q), 1))), axis=1).astype(np.float32)
                for a in range(0, len(q), 64):
                    for i, hit in enumerate(beam_search(near, graph, row["start"], aug[a : a + 64], max(BEAM, 2 * k)), a):
                        hit = hit[hit >= 0]
                        score = (x[hit] * q[i]).sum(axis=1)
                        who = [ids[first[h] : first[h] + min(count[h], k + 1)] for h in hit]
                        score, who = np.repeat(score, [len(w) for w in who]), np.concatenate(who)
                        keep = who != qid[i]
                        best = np.lexsort((who[keep], -score[keep]))[:k]
                        for o, v in zip(out, (np.full(len(best), qid[i]), who[keep][best], score[keep][best]), strict=True):
                            o.append(v)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    return run


def _packed(table: pa.Table) -> pa.Table:
    table = table.sort_by([("id", "ascending")])
    return pa.table({"block": table.column("block").slice(0, 1), "qid": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), "qv": pa.array([b"".join(table.column("v").to_pylist())], pa.binary())})


def _doubles(batches):
    for batch in batches:
        v = [np.asarray(x, np.float64).tobytes() for x in batch.column("e").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), pa.array(v, pa.binary())], names=["id", "q", "v"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest other rows of each query row: query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller id.

    Every vector is indexed. Null, empty and zero vectors, such with null or non-finite components, those with a null
    id, and those whose length is not the commonest (the smaller on ties) take no part. Equal vectors share a node
    of the graph. Ids should be unique: rows of a query's own id are never its neighbours. Fewer candidates than k
    give fewer rows; no vectors, none.
    """
    e = F.col(vector_col)
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), e.cast("array<double>").alias("e"))
    rows = rows.where("id is not null and e is not null and size(e) > 0").where(~odd).where(F.exists("e", lambda x: x != 0))
    size = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    rows = rows.join(F.broadcast(size.select("n")), F.size("e") == F.col("n"), "left_semi")
    flat = cut(rows.mapInArrow(_doubles, "id long, q boolean, v binary"))
    total = flat.count()
    shards = max(1, math.ceil(total / SHARD), min(math.ceil(total / LEAST_SHARD), fanout(vectors.sparkSession)))
    blocks = max(1, math.ceil(flat.where("q").count() / BLOCK))
    index = flat.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_index, "shard int, start long, dim int, x binary, ids binary, count binary, graph binary")
    asked = cut(flat.where("q").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_packed, "block int, qid binary, qv binary"))
    # A stated query set against all rows: every shard is read once for each slab of query blocks.
    every = asked.withColumn("slab", F.expr(f"block div {SLAB}").cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = cut(index).withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // SLAB))))
    near = held.groupBy("shard", "slab").cogroup(every.groupBy("at", "slab")).applyInArrow(_answer(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
