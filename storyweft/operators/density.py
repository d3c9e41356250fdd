"""Density clustering of whole windows: HDBSCAN over a distributed minimum spanning tree.

Two passes over blocks of distances. The first has the nearest of each point, and with them core distances and a first
tree of the window, not yet the least. An edge that comes after all those between its ends in that tree is the last of
a cycle, so the second pass keeps only edges that come before one of them, and the least tree is found in these and the
first. With points in the order in which the first tree joins them, its last edge between two points is the last of
those that part neighbours between them, so a product and two comparisons settle nearly all pairs. Edges are ordered by
weight, then by ids, so that the tree is one and the same for any block size. A window has a few blocks however large
it is, and a task goes through two of them by tiles: what is shuffled, and what a window's last task holds, grows with
its points.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .snapshots import cut
from .vectors import BLOCKS, PAIRS, as_numbers, in_tiles, low_squares, matrix, nearest_members, nearest_placed, over, pair_distances, placed, same_block, steps

#: Rows of a tile; a task holds the distances of two tiles' points, some 150 MB with what is derived from them.
TILE = 2048
#: Neighbours of a point that the first tree is made of, at least.
NEAR = 6
#: Points that stand for a part of the first tree where it is linked with others.
PICKS = 4
#: Times that such points, and then what they found, look for the nearest in other parts.
TURNS = 3
_COUNTS = pa.schema([(c, pa.int64()) for c in ("window", "clusters", "usable", "wide")])
_EDGES = pa.schema([("window", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())])


def dense_tree(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, weight) of the spanning tree of a full matrix, a < b being rows, least by weight, then a, then b."""
    n = len(reach)
    best, key, parent, inside = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.zeros(n, int), np.zeros(n, bool)
    rows, a, b, w, at = np.arange(n), [], [], [], 0
    inside[0] = True
    for _ in range(n - 1):
        own = np.minimum(rows, at) * n + np.maximum(rows, at)
        better = ~inside & ((reach[at] < best) | ((reach[at] == best) & (own < key)))
        best[better], key[better], parent[better] = reach[at][better], own[better], at
        open_ = np.where(inside, np.inf, best)
        least = np.flatnonzero((open_ == open_.min()) & ~inside)
        at = int(least[key[least].argmin()])
        inside[at] = True
        a.append(min(at, parent[at]))
        b.append(max(at, parent[at]))
        w.append(best[at])
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w, float)


def least_tree(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spanning forest of edges between points 0 to n - 1, least by weight, then a, then b: each part takes its first open edge, until none is open."""
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    part, kept, live = np.arange(n), np.zeros(len(w), bool), np.arange(len(w))
    while True:
        x, y = part[a[live]], part[b[live]]
        open_ = x != y
        live, x, y = live[open_], x[open_], y[open_]
        if not len(live):
            return a[kept], b[kept], w[kept]
        first = np.full((2, n), len(w))
        first[0][x[::-1]], first[1][y[::-1]] = live[::-1], live[::-1]
        first = first.min(axis=0)
        root = np.flatnonzero(first < len(w))
        edge = first[root]
        kept[edge] = True
        up = np.arange(n)
        up[root] = part[a[edge]] + part[b[edge]] - root
        # Two parts that take the same edge would point at each other: the lesser is their root.
        both = root[(up[up[root]] == root) & (root < up[root])]
        up[both] = both
        while (up[up] != up).any():
            up = up[up]
        part = up[part]


def tree_labels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int = 2, epsilon: float = 0.0) -> np.ndarray:
    """Labels (-1: noise) of points 0 to n - 1 from their spanning tree: condensed tree, excess of mass, and merging of clusters that part below `epsilon`. The root is never a cluster; labels are numbered by their first point."""
    least = max(least, 2)
    if n < least or not len(w):
        return np.full(n, -1)
    root, node, size, height, kids = list(range(n)), list(range(n)), [1] * n, [0.0] * n, [(-1, -1)] * n

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for e in np.lexsort((b, a, w)):
        x, y = find(int(a[e])), find(int(b[e]))
        kids.append((node[x], node[y]))
        size.append(size[node[x]] + size[node[y]])
        height.append(float(w[e]))
        small, large = (x, y) if size[node[x]] < size[node[y]] else (y, x)
        root[small], node[large] = large, len(size) - 1

    def leaves(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            t = todo.pop()
            if t < n:
                out.append(t)
            else:
                todo.extend(kids[t])
        return out

    # A split counts only if both sides have `least` members; else points fall out of the cluster they are in.
    above, birth, mass, home = [-1], [0.0], [0.0], np.zeros(n, int)
    todo = [(len(size) - 1, 0)]
    while todo:
        v, c = todo.pop()
        lam = 1 / max(height[v], 1e-12)
        big = [k for k in kids[v] if size[k] >= least]
        if len(big) == 2:
            mass[c] += (lam - birth[c]) * size[v]
            for k in big:
                above.append(c)
                birth.append(lam)
                mass.append(0.0)
                todo.append((k, len(above) - 1))
            continue
        for k in kids[v]:
            if k not in big:
                mass[c] += (lam - birth[c]) * size[k]
                home[leaves(k)] = c
        todo += [(k, c) for k in big]
    below, chosen, inner = [0.0] * len(above), [False] * len(above), [False] * len(above)
    for c in range(len(above) - 1, 0, -1):
        chosen[c] = not inner[c] or mass[c] >= below[c]
        below[above[c]] += mass[c] if chosen[c] else below[c]
        inner[above[c]] = True
    # Top down: the first chosen one of a branch is a cluster.
    held = [0] * len(above)
    for c in range(1, len(above)):
        held[c] = held[above[c]] or (c if chosen[c] else 0)
    if epsilon > 0:
        raised = {}
        for c in {x for x in held if x}:
            top = c
            while 1 / birth[top] < epsilon if top == c else 1 / birth[top] <= epsilon:
                if not above[top]:
                    break
                top = above[top]
            raised[c] = top
        firm = set(raised.values())
        held = [0] * len(above)
        for c in range(1, len(above)):
            held[c] = held[above[c]] or (c if c in firm else 0)
    of = np.array(held)[home]
    names: dict[int, int] = {}
    return np.array([names.setdefault(c, len(names)) if c else -1 for c in of])


def parts_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first point of each point's part, of points 0 to n - 1 linked by edges."""
    part = np.arange(n)
    while True:
        x, y = part[a], part[b]
        if (x == y).all():
            return part
        np.minimum.at(part, np.maximum(x, y), np.minimum(x, y))
        while (part[part] != part).any():
            part = part[part]


def joined_order(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, edges): points 0 to n - 1 in an order in which every part that the first so many edges join stands together, and the edge that joins what ends with each point and what begins with the next (-1: none)."""
    root, last, then, gap = list(range(n)), list(range(n)), [-1] * n, [-1] * n

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    size = [1] * n
    first = list(range(n))
    for e, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if size[x] < size[y]:
            x, y = y, x
        then[last[x]], gap[last[x]] = first[y], e
        last[x], root[y] = last[y], x
        size[x] += size[y]
    order = []
    for v in range(n):
        if root[v] == v:
            at = first[v]
            while at >= 0:
                order.append(at)
                at = then[at]
    return np.array(order, np.int64), np.array(gap, np.int64)[order]


def _parts(links: pa.Table) -> pa.Table:
    """Each point of a window with the part it is in; `picked` if it stands for its part, where there are several."""
    a, b = (links.column(c).to_numpy() for c in ("a", "b"))
    ids = np.unique(np.concatenate((a, b)))
    part = parts_of(len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b))
    order = np.argsort(part, kind="stable")
    begin = np.flatnonzero(np.diff(part[order], prepend=-1))
    nth = np.arange(len(ids)) - np.repeat(begin, np.diff(np.append(begin, len(ids))))
    many = np.full(len(ids), len(begin) > 1)
    picked = np.zeros(len(ids), bool)
    picked[order] = nth < PICKS
    return pa.table({"g": np.full(len(ids), links.column("g")[0].as_py(), np.int64), "id": ids, "part": ids[part], "open": many, "picked": picked & many})


def _bridges_to(tile: int):
    def run(picked: pa.Table, rows: pa.Table) -> pa.Table:
        """The nearest point of a block to each picked one that is in another part."""
        found, picked = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)], picked.rename_columns(rows.column_names)
        if len(picked) and len(rows):
            ids, part, x = ([f(t) for t in (picked, rows)] for f in (lambda t: t.column("id").to_numpy(), lambda t: t.column("part").to_numpy(), lambda t: matrix(t.column("v"))))
            rough, best, to = low_squares(*x), np.full(len(ids[0]), np.inf), np.zeros(len(ids[0]), np.int64)
            for a, b in steps(len(ids[0]), len(ids[1]), tile, False):
                low = rough[0][a] @ rough[1][b].T
                low[part[0][a][:, None] == part[1][b][None]] = np.inf
                at = low.argmin(axis=1)
                low = low[np.arange(len(low)), at]
                nearer = np.flatnonzero(low < best[a])
                best[a.start + nearer], to[a.start + nearer] = low[nearer], b.start + at[nearer]
            one = np.flatnonzero(np.isfinite(best))
            d = pair_distances(x[0][one], x[1][to[one]])
            one, d = one[np.isfinite(d)], d[np.isfinite(d)]
            found = [ids[0][one], ids[1][to[one]], d]
        return pa.table({"g": np.full(len(found[0]), rows.column("g")[0].as_py() if len(rows) else 0, np.int64), **dict(zip(("a", "b", "d"), found, strict=True))})

    return run


def _links(held: DataFrame, near: DataFrame, tile: int) -> DataFrame:
    """(g, a, b, d, nth): the edges from each point to those near it, its nth (from 0), and others (-1) that link the parts which these leave, until a window is one part; any links do, near ones spare work later."""
    links = near.select("g", F.col("id").alias("a"), F.posexplode("near").alias("nth", "to")).select("g", "a", F.col("to.id").alias("b"), F.col("to.d").alias("d"), "nth")
    ends, out = links, links
    while True:
        parts = cut(ends.select("g", "a", "b").groupBy("g").applyInArrow(_parts, "g long, id long, part long, open boolean, picked boolean"))
        if not parts.where("open").head(1):
            return out
        rows, columns, met = cut(held.join(parts.where("open"), ["g", "id"])), ["g", "id", "v", "part", "block"], []
        picked = rows.where("picked")
        # What is nearest to a picked point looks for its own nearest in turn: that leads to where two parts are close.
        for _ in range(TURNS):
            dealt = picked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*[F.col(c).alias("p_" + c) for c in columns])
            met.append(cut(dealt.groupBy("p_g", "p_block").cogroup(rows.select(*columns).groupBy("g", "block")).applyInArrow(_bridges_to(tile), "g long, a long, b long, d double")))
            picked = rows.join(met[-1].groupBy("g", "a").agg(F.min_by("b", "d").alias("id")).select("g", "id").distinct(), ["g", "id"], "left_semi")
        found = reduce(DataFrame.unionByName, met)
        if not found.head(1):
            return out
        out = out.unionByName(found.withColumn("nth", F.lit(-1)))
        ends = parts.select("g", F.col("id").alias("a"), F.col("part").alias("b")).unionByName(found.select("g", "a", "b"))


_PLACES = "g long, id long, core double, block int, blocks int, pos long, a long, b long, w double, mid_a array<long>, mid_b array<long>, mid_w array<double>"


def _first_tree(samples: int, tile: int):
    def run(links: pa.Table) -> pa.Table:
        """A window's points in the order in which its first tree joins them. (a, b, w) is the edge that parts a point from the next; mid_a, mid_b and mid_w, with the first point of a block only, have the last of those in the blocks between it and each other."""
        one, two, d, nth = (links.column(c).to_numpy() for c in ("a", "b", "d", "nth"))
        ids = np.unique(one)
        n, one, two = len(ids), np.searchsorted(ids, one), np.searchsorted(ids, two)
        core, own = np.zeros(n), (nth >= 0) & (nth < samples)
        np.maximum.at(core, one[own], d[own])
        a, b, w = least_tree(n, np.minimum(one, two), np.maximum(one, two), np.maximum(d, np.maximum(core[one], core[two])))
        order, gap = joined_order(n, a, b)
        # A tree that is not whole has open gaps: all pairs across are looked at.
        a, b, w = np.append(ids[a], -1), np.append(ids[b], -1), np.append(w, np.inf)
        blocks = min(-(-n // tile), BLOCKS)
        block = np.arange(n) * blocks // n
        last = np.maximum.reduceat(np.where(gap < 0, len(w), gap), np.searchsorted(block, np.arange(blocks)))
        mid = np.full((blocks, blocks), -1)
        for i in range(blocks):
            for j in range(i + 2, blocks):
                mid[i, j] = mid[j, i] = max(mid[i, j - 1], last[j - 1])
        mid = np.minimum(mid, len(w) - 1)
        begin = np.concatenate(([0], np.cumsum(np.diff(block, prepend=-1) > 0) * blocks)).astype(np.int32)
        lists = lambda v, none: pa.ListArray.from_arrays(begin, np.where(mid < 0, none, v[mid]).ravel())
        return pa.table({
            "g": np.full(n, links.column("g")[0].as_py(), np.int64), "id": ids[order], "core": core[order], "block": block.astype(np.int32), "blocks": np.full(n, blocks, np.int32), "pos": np.arange(n),
            "a": a[gap], "b": b[gap], "w": w[gap], "mid_a": lists(a, -1), "mid_b": lists(b, -1), "mid_w": lists(w, -1.0),
        })

    return run


def _last_between(rank: np.ndarray):
    """(i, j) -> the largest of rank[i:j], for places i < j."""
    levels = [rank]
    while 2 << (len(levels) - 1) <= len(rank):
        half = 1 << (len(levels) - 1)
        levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))
    flat, begin = np.concatenate(levels), np.cumsum([0, *map(len, levels)])

    def last(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp((j - i).astype(float))[1] - 1
        return np.maximum(flat[begin[level] + i], flat[begin[level] + j - (1 << level)])

    return last


def _edges_before(tile: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The edges between the points of two blocks, or of one, that come before the last of the first tree's between their ends; of one, and the first tree's own. One in a cycle of those is left out."""
        if not len(left) or not len(right):
            return _EDGES.empty_table()
        same = same_block(left, right)
        sides = [t.take(np.argsort(t.column("pos").to_numpy())) for t in ([left] if same else [left, right])]
        own, core, x, a, b, w = ([f(t) for t in sides] for f in (*(lambda t, c=c: t.column(c).to_numpy() for c in ("id", "core")), lambda t: matrix(t.column("v")), *(lambda t, c=c: t.column(c).to_numpy() for c in ("a", "b", "w"))))
        far = right.column("block")[0].as_py()
        first = [np.concatenate((*v, [sides[0].column("mid_" + c)[0].as_py()[far]])) for c, v in (("a", a), ("b", b), ("w", w))]
        # The tree's edges by rank; a last one stands for what has no gap.
        by = np.lexsort((first[1], first[0], first[2]))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        first = [c[by] for c in first]
        bound = over(first[2] ** 2)
        n = len(own[0])
        between = _last_between(rank[:n])
        rough = low_squares(x[0], x[-1])
        bound = bound.astype(rough[0].dtype)
        ids = np.unique(np.concatenate(own))
        open_, held, more = w[0] < np.inf, [], 0
        for p, q in steps(n, len(own[-1]), tile, same):
            low = rough[0][p] @ rough[1][q].T
            if same and p == q:
                m = len(low)
                most = np.where(np.arange(m)[:, None] <= np.arange(m)[None], bound[rank[p]][None], -np.inf).astype(low.dtype)
                np.maximum.accumulate(most, axis=1, out=most)
                met = np.zeros(low.shape, bool)
                met[:, 1:] = low[:, 1:] <= most[:, :-1]
                met &= np.arange(m)[:, None] < np.arange(m)[None]
            elif same:
                before = np.maximum.accumulate(rank[p.start : q.start][::-1])[::-1][: len(low)]
                after = np.maximum.accumulate(np.concatenate(([-1], rank[q.start : q.stop - 1])))
            else:
                before = np.maximum(np.maximum.accumulate(rank[p.start : n][::-1])[::-1][: len(low)], rank[-1])
                after = np.maximum.accumulate(np.concatenate(([-1], rank[n : n + q.stop - 1])))[q]
            if not same or p != q:
                met = low <= bound[before][:, None]
                met |= low <= np.where(after < 0, -np.inf, bound[after]).astype(low.dtype)[None]
            at = np.flatnonzero(met)
            for c in range(0, len(at), PAIRS):
                i, j = np.divmod(at[c : c + PAIRS], low.shape[1])
                last = between(i + p.start, j + q.start) if same else np.maximum(before[i], after[j])
                i, j = i + p.start, j + q.start
                f, t = np.minimum(own[0][i], own[-1][j]), np.maximum(own[0][i], own[-1][j])
                sooner = (f < first[0][last]) | ((f == first[0][last]) & (t < first[1][last]))
                # No weight is less than 0.
                keep = (first[2][last] > 0) | sooner
                i, j, f, t, last, sooner = (v[keep] for v in (i, j, f, t, last, sooner))
                d = np.maximum(pair_distances(x[0][i], x[-1][j]), np.maximum(core[0][i], core[-1][j]))
                keep = (d < first[2][last]) | ((d == first[2][last]) & sooner)
                held.append((np.searchsorted(ids, f[keep]), np.searchsorted(ids, t[keep]), d[keep]))
                more += len(held[-1][2])
                if more > 16 * len(ids):
                    held = [_merged(len(ids), held)]
                    more = len(held[0][2])
        f, t, d = _merged(len(ids), held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        f, t = ids[f], ids[t]
        if same:
            f, t, d = np.concatenate((f, a[0][open_])), np.concatenate((t, b[0][open_])), np.concatenate((d, w[0][open_]))
        return pa.table([np.full(len(d), left.column("g")[0].as_py(), np.int64), f, t, d], schema=_EDGES)

    return run


def _merged(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One least tree of several sets of edges."""
    return least_tree(n, *(np.concatenate(c) for c in zip(*parts, strict=True)))


def _window_tree(edges: pa.Table) -> pa.Table:
    a, b, w = (edges.column(c).to_numpy() for c in ("a", "b", "w"))
    ids = np.unique(np.concatenate((a, b)))
    f, t, w = least_tree(len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b), w)
    return pa.table([np.full(len(w), edges.column("window")[0].as_py(), np.int64), ids[f], ids[t], w], schema=_EDGES)


def near_points(vectors: DataFrame, samples: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The points of vectors(window, id, vector) in blocks, and links between near ones, `samples` of each point at least; from them the trees of up to so many samples are made."""
    rows = vectors.select(F.col("window").cast("long").alias("g"), F.col("id").cast("long").alias("id"), as_numbers(vectors, "vector").alias("v")).where("g is not null and id is not null and v is not null")
    held = cut(placed(rows, tile))
    return held, cut(_links(held, cut(nearest_placed(held, max(samples, NEAR), tile)), tile))


def spanning_tree(vectors: DataFrame, samples: int = 1, tile: int = TILE, points: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """vectors(window, id, vector) -> (window, a, b, w): the minimum spanning tree of each window by mutual reachability (Euclidean; a point's core distance is that of its `samples`-th other point).

    Rows with a null window, id or vector take no part; ids are unique in a window. A window of one point has no edge.
    """
    held, links = points or near_points(vectors, samples, tile)
    first = links.groupBy("g").applyInArrow(_first_tree(samples, tile), _PLACES)
    trees = in_tiles(cut(held.drop("block", "blocks").join(first, ["g", "id"])), _edges_before(tile), "window long, a long, b long, w double", ["core", "pos", "a", "b", "w", "mid_a", "mid_b", "mid_w"])
    return trees.groupBy("window").applyInArrow(_window_tree, "window long, a long, b long, w double")


#: Subsamples whose trees are made together at most: they are told apart by the bits of a number.
TOGETHER = 48
#: Marks of links (`nth`) beside those to near points (0 and up) and between parts (-1): past points that a subsample leaves out, and to the nearest of a subsample.
PAST, MEMBER = -2, -3


def _in_order(ids: np.ndarray, links: pa.Table) -> tuple[np.ndarray, ...]:
    """(one, two, d, nth, k) of links, ends by their place in ids, those of a point from its nearest on."""
    one, two = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("a", "b"))
    d, nth, k = (links.column(c).to_numpy() for c in ("d", "nth", "k"))
    by = np.lexsort((nth, one))
    return one[by], two[by], d[by], nth[by], k[by]


def _members(points: pa.Table, links: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The points that have links, and of each the subsamples it is in, as bits."""
    ids = np.unique(links.column("a").to_numpy())
    of = points.column("id").to_numpy()
    by = np.argsort(of)
    return ids, points.column("own").to_numpy()[by][np.searchsorted(of[by], ids)]


def _up(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The next point towards the first of its part of each point of a forest; that one's is itself."""
    part = parts_of(n, a, b)
    one, two = np.concatenate((a, b)), np.concatenate((b, a))
    two = two[np.argsort(one, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(one, minlength=n))))
    up = np.where(part == np.arange(n), part, -1)
    now = np.flatnonzero(up >= 0)
    while len(now):
        m = begin[now + 1] - begin[now]
        to = two[np.repeat(begin[now] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        of = np.repeat(now, m)
        of, to = of[up[to] < 0], to[up[to] < 0]
        up[to] = of
        now = to
    return up


def _asked(samples: int, near: int, trials: int):
    def run(links: pa.Table, points: pa.Table) -> pa.Table:
        """What the links of a window lack for its subsamples: `past`, points to link a point with where its next one is left out, so that each subsample stays in one part; `short`, subsamples of which too few are near it."""
        none = pa.table({"g": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "past": pa.array([], pa.list_(pa.int64())), "short": pa.array([], pa.list_(pa.int64()))})
        if not len(links):
            return none
        ids, own = _members(points, links)
        one, two, d, nth, _ = _in_order(ids, links)
        n = len(ids)
        a, b, _ = least_tree(n, np.minimum(one, two), np.maximum(one, two), d)
        up, listed = _up(n, a, b), np.bincount(one[nth >= 0], minlength=n)
        out: list[list[np.ndarray]] = [[], []]
        for k in range(trials):
            mine = (own >> k & 1).astype(bool)
            to = up.copy()
            while True:
                gone = np.flatnonzero(~mine[to] & (up[to] != to))
                if not len(gone):
                    break
                to[gone] = up[to[gone]]
            # Those with none of the subsample above them are linked with one of them.
            top = np.flatnonzero(mine & ~mine[to])
            to[top] = top[np.unique(to[top], return_index=True)[1]][np.unique(to[top], return_inverse=True)[1]] if len(top) else top
            new = np.flatnonzero(mine & (to != up) & (to != np.arange(n)))
            out[0].append(new * n + to[new])
            met = np.bincount(one[(nth >= 0) & mine[two]], minlength=n)
            out[1].append(np.flatnonzero(mine & (met < samples) & (listed >= near)) * trials + k)
        past, short = (np.unique(np.concatenate(v)) for v in out)
        at = np.unique(np.concatenate((past // n, short // trials)))
        lists = lambda v, m, names: pa.ListArray.from_arrays(np.searchsorted(v, np.append(at, n) * m).astype(np.int32), names[v % m])
        return pa.table({"g": np.full(len(at), links.column("g")[0].as_py(), np.int64), "id": ids[at], "past": lists(past, n, ids), "short": lists(short, trials, np.arange(trials))})

    return run


def _lengths(batches):
    """(g, a, b, d) of pairs of points with the vectors x and y."""
    for rows in batches:
        rows = pa.Table.from_batches([rows])
        d, size = np.zeros(len(rows)), pc.list_value_length(rows.column("x")).to_numpy()
        # Windows may differ in the width of their vectors.
        for m in np.unique(size):
            at = np.flatnonzero(size == m)
            some = rows.take(at)
            d[at] = pair_distances(matrix(some.column("x")), matrix(some.column("y")))
        yield from pa.table({"g": rows.column("g"), "a": rows.column("a"), "b": rows.column("b"), "d": d}).to_batches()


_SUB = "id long, pos long, block int, blocks int, core array<double>, a array<long>, b array<long>, w array<double>, mid_a array<long>, mid_b array<long>, mid_w array<double>, tree_a array<long>, tree_b array<long>, tree_w array<double>"


def _first_trees(samples: int, tile: int, trials: int):
    def run(links: pa.Table, points: pa.Table) -> pa.Table:
        """A window's points in the order in which a tree of all joins them, and of each subsample a first tree (tree_: an edge a point), core distances, and, where a point is followed by one of the subsample, the edge of its tree that parts it from the one before (b < 0: none; w infinite: its tree is not whole). mid_, with the first point of a block only, has the last of those in the blocks between it and each other, by block, then subsample."""
        if not len(links):
            return pa.table({"g": pa.array([], pa.int64()), **{c: pa.array([], t) for c, t in zip(_NAMES, _TYPES, strict=True)}})
        ids, own = _members(points, links)
        one, two, d, nth, of = _in_order(ids, links)
        n, whole, listed = len(ids), nth > PAST, nth >= 0
        order, _ = joined_order(n, *least_tree(n, np.minimum(one, two)[whole], np.maximum(one, two)[whole], d[whole])[:2])
        blocks = min(-(-n // tile), BLOCKS)
        block = np.arange(n) * blocks // n
        edge = {c: np.full((n, trials), v) for c, v in (("a", -1), ("b", -1), ("w", -1.0), ("core", 0.0), ("tree_a", -1), ("tree_b", -1), ("tree_w", -1.0))}
        mids = {c: np.full((blocks, blocks, trials), v) for c, v in (("a", -1), ("b", -1), ("w", -1.0))}
        for k in range(trials):
            mine = (own >> k & 1).astype(bool)
            # The first `samples` of a point's near ones that are in the subsample.
            met = listed & mine[one] & mine[two]
            so_far = np.cumsum(met)
            before = (so_far - met)[np.searchsorted(one, np.arange(n))]
            met &= so_far - before[one] <= samples
            core = np.zeros(n)
            met |= (nth == MEMBER) & (of == k)
            np.maximum.at(core, one[met], d[met])
            here = np.cumsum(mine) - 1
            at = np.flatnonzero(mine)
            use = mine[one] & mine[two] & ((nth != MEMBER) | (of == k))
            x, y = here[one[use]], here[two[use]]
            a, b, w = least_tree(len(at), np.minimum(x, y), np.maximum(x, y), np.maximum(d[use], np.maximum(core[one[use]], core[two[use]])))
            joined, gap = joined_order(len(at), a, b)
            place = np.empty(len(at), np.int64)
            place[joined] = np.arange(len(at))
            seen = np.flatnonzero(mine[order])
            last = np.full(n, -1)
            if len(at) > 1:
                u, v = place[here[order[seen[:-1]]]], place[here[order[seen[1:]]]]
                last[seen[1:] - 1] = _last_between(np.where(gap < 0, len(w), gap))(np.minimum(u, v), np.maximum(u, v))
            ends = [np.append(ids[at[a]], (-1, -1)), np.append(ids[at[b]], (-1, -1)), np.append(w, (np.inf, -1.0))]
            most = np.maximum.reduceat(last, np.searchsorted(block, np.arange(blocks)))
            mid = np.full((blocks, blocks), -1)
            for i in range(blocks):
                for j in range(i + 2, blocks):
                    mid[i, j] = mid[j, i] = max(mid[i, j - 1], most[j - 1])
            for c, v in zip("abw", ends, strict=True):
                edge[c][:, k] = v[np.where(last < 0, len(w) + 1, last)]
                mids[c][:, :, k] = v[np.where(mid < 0, len(w) + 1, mid)]
                edge["tree_" + c][: len(w), k] = v[: len(w)]
            edge["core"][:, k] = core[order]
        lists = lambda v: pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * trials, v.ravel())
        begin = np.diff(block, prepend=-1) > 0
        long = lambda v: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(begin * blocks * trials))).astype(np.int32), v.ravel())
        return pa.table({
            "g": np.full(n, links.column("g")[0].as_py(), np.int64), "id": ids[order], "pos": np.arange(n), "block": block.astype(np.int32), "blocks": np.full(n, blocks, np.int32), "core": lists(edge["core"]),
            **{c: lists(edge[c]) for c in "abw"}, **{"mid_" + c: long(mids[c]) for c in "abw"}, **{c: lists(edge[c]) for c in ("tree_a", "tree_b", "tree_w")},
        })

    return run


_NAMES = [c.split()[0] for c in _SUB.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}[c.split()[1]] for c in _SUB.split(", ")]


def _edges_of_trials(tile: int, trials: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """`_edges_before` of several subsamples: one product tells which pairs any of them may need, by the last gap of any between their ends; each then keeps its own. window: the subsample's number in that window."""
        if not len(left) or not len(right):
            return _EDGES.empty_table()
        same = same_block(left, right)
        sides = [t.take(np.argsort(t.column("pos").to_numpy())) for t in ([left] if same else [left, right])]
        ids, own, x = ([f(t) for t in sides] for f in (lambda t: t.column("id").to_numpy(), lambda t: t.column("own").to_numpy(), lambda t: matrix(t.column("v"))))
        core, a, b, w = ([np.asarray(t.column(c).combine_chunks().flatten()).reshape(-1, trials) for t in sides] for c in ("core", "a", "b", "w"))
        n, far = len(ids[0]), right.column("block")[0].as_py()
        if not same:
            # The gaps between the blocks stand between theirs; a point of the second comes after those.
            a, b, w = ([v[0], np.asarray(sides[0].column("mid_" + c)[0].as_py(), v[0].dtype).reshape(-1, trials)[far : far + 1], v[1]] for c, v in (("a", a), ("b", b), ("w", w)))
        a, b, w = (np.concatenate(v) for v in (a, b, w))
        core, skip = [c.T.copy() for c in core], 0 if same else n + 1
        every = np.unique(np.concatenate(ids))
        first, between = [], []
        for k in range(trials):
            by = np.lexsort((b[:, k], a[:, k], w[:, k]))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            first.append((a[by, k], b[by, k], w[by, k]))
            between.append(_last_between(rank))
        rough = low_squares(x[0], x[-1])
        kind, most = rough[0].dtype, w.max(axis=1)
        bound = np.where(most < 0, -np.inf, over(most**2)).astype(kind)
        held, more = [[] for _ in range(trials)], np.zeros(trials, np.int64)
        for p, q in steps(n, len(ids[-1]), tile, same):
            low, begin = rough[0][p] @ rough[1][q].T, q.start + skip
            if same and p == q:
                m = len(low)
                reach = np.where(np.arange(m)[:, None] <= np.arange(m)[None], bound[p][None], -np.inf).astype(kind)
                np.maximum.accumulate(reach, axis=1, out=reach)
                met = np.zeros(low.shape, bool)
                met[:, 1:] = low[:, 1:] <= reach[:, :-1]
                met &= np.arange(m)[:, None] < np.arange(m)[None]
            else:
                before = np.maximum.accumulate(bound[p.start : begin][::-1])[::-1][: len(low)]
                after = np.maximum.accumulate(np.concatenate(([-np.inf], bound[begin : begin + low.shape[1] - 1]))).astype(kind)
                met = low <= before[:, None]
                met |= low <= after[None]
            at = np.flatnonzero(met)
            for c in range(0, len(at), PAIRS):
                i, j = np.divmod(at[c : c + PAIRS], low.shape[1])
                short = low.ravel()[at[c : c + PAIRS]]
                i, j = i + p.start, j + q.start
                both = own[0][i] & own[-1][j]
                f, t = np.minimum(ids[0][i], ids[-1][j]), np.maximum(ids[0][i], ids[-1][j])
                wanted = []
                for k in range(trials):
                    r = np.flatnonzero(both >> k & 1)
                    last = between[k](i[r], j[r] + skip)
                    fa, fb, fw = (v[last] for v in first[k])
                    sooner = (f[r] < fa) | ((f[r] == fa) & (t[r] < fb))
                    # No weight is less than 0.
                    keep = ((fw > 0) | sooner) & (short[r] <= over(fw**2).astype(kind))
                    wanted.append((r[keep], fw[keep], sooner[keep]))
                need = np.zeros(len(i), bool)
                for r, _, _ in wanted:
                    need[r] = True
                d = np.zeros(len(i))
                need = np.flatnonzero(need)
                d[need] = pair_distances(x[0][i[need]], x[-1][j[need]])
                for k, (r, fw, sooner) in enumerate(wanted):
                    far_ = np.maximum(d[r], np.maximum(core[0][k][i[r]], core[-1][k][j[r]]))
                    keep = (far_ < fw) | ((far_ == fw) & sooner)
                    r = r[keep]
                    held[k].append((np.searchsorted(every, f[r]), np.searchsorted(every, t[r]), far_[keep]))
                    more[k] += len(r)
                    if more[k] > 16 * len(every):
                        held[k] = [_merged(len(every), held[k])]
                        more[k] = len(held[k][0][2])
        out, window = [], left.column("g")[0].as_py() * trials
        for k in range(trials):
            if more[k]:
                f, t, d = _merged(len(every), held[k])
                out.append(pa.table([np.full(len(d), window + k, np.int64), every[f], every[t], d], schema=_EDGES))
        return pa.concat_tables(out) if out else _EDGES.empty_table()

    return run


def trial_trees(vectors: DataFrame, trials: int, samples: int = 1, tile: int = TILE) -> DataFrame:
    """vectors(window, id, vector, own), bit k of `own` telling whether a row is in subsample k -> (window, a, b, w): the spanning_tree of each subsample of each window, as window * trials + k.

    Distances of a window are gone through twice for all its subsamples, not for each, and a row is sent once for all:
    neighbours are looked for among all rows, then those in a subsample are taken, and looked for anew where too few
    are. Any links will do for a first tree, so where a subsample lacks a point, those next to it in a tree of all are
    linked. The order of that tree serves every subsample: the last edge between two points is not after the last of
    those that part neighbours between them, in any order, so no edge of a least tree is missed.
    """
    rows = vectors.select(F.col("window").cast("long").alias("g"), F.col("id").cast("long").alias("id"), as_numbers(vectors, "vector").alias("v"), "own").where("g is not null and id is not null and v is not null and own <> 0")
    held, near = cut(placed(rows, tile)), max(samples, NEAR)
    # Where parts are linked, `own` is in no one's way.
    links = cut(_links(held, cut(nearest_placed(held, near, tile)), tile).withColumn("k", F.lit(-1).cast("long")).withColumn("nth", F.col("nth").cast("long")))
    points = held.select(F.col("g").alias("of"), "id", "own")
    asked = cut(links.groupBy("g").cogroup(points.groupBy("of")).applyInArrow(_asked(samples, near, trials), "g long, id long, past array<long>, short array<long>"))
    x = held.select("g", F.col("id").alias("a"), F.col("v").alias("x"))
    y = held.select("g", F.col("id").alias("b"), F.col("v").alias("y"))
    past = asked.select("g", F.col("id").alias("a"), F.explode("past").alias("b")).join(x, ["g", "a"]).join(y, ["g", "b"]).select("g", "a", "b", "x", "y").mapInArrow(_lengths, "g long, a long, b long, d double")
    dealt = asked.select("g", "id", F.explode("short").alias("k")).join(held.select("g", "id", "v", "blocks"), ["g", "id"]).select(F.col("g").alias("q_g"), F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("k").alias("q_k"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"))
    found = dealt.groupBy("q_g", "q_block").cogroup(held.select("g", "id", "v", "own", "block").groupBy("g", "block")).applyInArrow(nearest_members(samples, tile), "g long, a long, k long, d array<double>, other array<long>")
    found = found.groupBy("g", "a", "k").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", F.col("other").alias("b"))))), 1, samples).alias("near"))
    found = found.select("g", "a", "k", F.explode("near").alias("n")).select("g", "a", "n.b", "n.d", F.lit(MEMBER).cast("long").alias("nth"), "k")
    links = links.unionByName(past.withColumns({"nth": F.lit(PAST).cast("long"), "k": F.lit(-1).cast("long")})).unionByName(found)
    first = cut(links.groupBy("g").cogroup(points.groupBy("of")).applyInArrow(_first_trees(samples, tile, trials), "g long, " + _SUB))
    more = ["own", "pos", "core", "a", "b", "w", "mid_a", "mid_b", "mid_w"]
    trees = in_tiles(cut(held.drop("block", "blocks").join(first.drop("tree_a", "tree_b", "tree_w"), ["g", "id"])), _edges_of_trials(tile, trials), "window long, a long, b long, w double", more)
    own = first.select("g", F.posexplode(F.arrays_zip("tree_a", "tree_b", "tree_w")).alias("k", "e")).where("e.tree_a >= 0").select((F.col("g") * trials + F.col("k")).alias("window"), F.col("e.tree_a").alias("a"), F.col("e.tree_b").alias("b"), F.col("e.tree_w").alias("w"))
    return trees.unionByName(own).groupBy("window").applyInArrow(_window_tree, "window long, a long, b long, w double")


def settings(leasts: list[int], epsilons: list[float]) -> list[tuple[int, float]]:
    return [(m, e) for m in leasts for e in epsilons]


def labelled(vectors: DataFrame, tree: DataFrame, tried: list[tuple[int, float]]) -> DataFrame:
    """(window, id, least, epsilon, label) of every point of vectors(window, id) under each setting (least members, epsilon), from spanning_tree(...)."""

    def run(points: pa.Table, edges: pa.Table) -> pa.Table:
        ids = np.sort(points.column("id").to_numpy())
        a, b = (np.searchsorted(ids, edges.column(c).to_numpy()) for c in ("a", "b"))
        out = [tree_labels(len(ids), a, b, edges.column("w").to_numpy(), m, e) for m, e in tried]
        window = points.column("window")[0].as_py() if len(ids) else 0
        return pa.table({
            "window": np.full(len(ids) * len(tried), window, np.int64), "id": np.tile(ids, len(tried)), "least": np.repeat([m for m, _ in tried], len(ids)).astype(np.int64),
            "epsilon": np.repeat([float(e) for _, e in tried], len(ids)), "label": np.concatenate(out).astype(np.int64),
        })

    points = vectors.where("window is not null and id is not null and vector is not null").select(F.col("window").cast("long").alias("window"), F.col("id").cast("long").alias("id"))
    return points.groupBy("window").cogroup(tree.withColumnRenamed("window", "of").groupBy("of")).applyInArrow(run, "window long, id long, least long, epsilon double, label long")


def cluster(vectors: DataFrame, least: int = 2, samples: int = 1, epsilon: float = 0.0, tile: int = TILE) -> DataFrame:
    """(window, id, label) of vectors(window, id, vector): HDBSCAN of each window; label -1 is noise, others are numbered by their least id. Empty tables give no rows."""
    return labelled(vectors, spanning_tree(vectors, samples, tile), [(least, epsilon)]).select("window", "id", "label")


def sweep(vectors: DataFrame, leasts: list[int], samples: list[int], epsilons: list[float], most: float = 0.25, tile: int = TILE) -> DataFrame:
    """(window, least, samples, epsilon, n, clusters, noise, largest, ok): how each window clusters under every setting; ok unless nothing clusters or one cluster has more than `most` of the window. One spanning tree serves all settings of `samples`."""
    vectors = cut(vectors.select("window", "id", "vector"))
    out, points = None, near_points(vectors, max(samples), tile)
    for k in samples:
        rows = labelled(vectors, spanning_tree(vectors, k, tile, points), settings(leasts, epsilons)).withColumn("samples", F.lit(k).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return _judged(out, most)


def _judged(rows: DataFrame, most: float) -> DataFrame:
    by = ["window", "least", "samples", "epsilon"]
    sizes = rows.groupBy(*by, "label").agg(F.count("*").alias("m"))
    inner = F.col("label") >= 0
    found = sizes.groupBy(*by).agg(F.sum("m").alias("n"), F.count_if(inner).alias("clusters"), F.coalesce(F.sum(F.when(~inner, F.col("m"))), F.lit(0)).alias("noise"), F.coalesce(F.max(F.when(inner, F.col("m"))), F.lit(0)).alias("largest"))
    return found.withColumn("ok", (F.col("clusters") > 0) & (F.col("largest") <= F.col("n") * most))


def _draws(shares: list[float], trials: int) -> list[tuple[int, float, int]]:
    """(number, share, trial) of each subsample. A share of 1 is tried once."""
    return [(i * trials + t, float(s), t) for i, s in enumerate(shares) for t in range(trials if s < 1 else 1)]


def subsamples(vectors: DataFrame, shares: list[float], trials: int, seed: int = 0) -> DataFrame:
    """vectors with (share, trial), each in a window of its own for every share and trial: a row is in by the hash of its id, so that reruns agree. A share of 1 is tried once."""
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(s).alias("share"), F.lit(t).cast("long").alias("trial")) for k, s, t in _draws(shares, trials)]))
    rows = vectors.withColumn("t", each).where(_draw(F.col("t.k"), seed) < F.col("t.share"))
    return rows.withColumn("own", F.col("window")).withColumn("window", F.col("window") * (len(shares) * trials) + F.col("t.k")).select("*", "t.share", "t.trial").drop("t")


def _draw(k: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(1 << 30)) / (1 << 30)


def subsample_trees(vectors: DataFrame, shares: list[float], trials: int, seed: int = 0, samples: int = 1, tile: int = TILE) -> DataFrame:
    """The trees of subsamples(...), some at once."""
    drawn, n, out = _draws(shares, trials), len(shares) * trials, None
    for at in range(0, len(drawn), TOGETHER):
        some = drawn[at : at + TOGETHER]
        bits = [F.when(_draw(F.lit(k).cast("long"), seed) < s, F.lit(1 << i).cast("long")).otherwise(0) for i, (k, s, _) in enumerate(some)]
        trees = trial_trees(vectors.withColumn("own", reduce(Column.__add__, bits)), len(some), samples, tile)
        name = F.get(F.array(*[F.lit(k).cast("long") for k, _, _ in some]), F.pmod("window", F.lit(len(some))).cast("int"))
        trees = trees.withColumn("window", F.floor(F.col("window") / len(some)).cast("long") * n + name)
        out = trees if out is None else out.unionByName(trees)
    return out


def stability(vectors: DataFrame, trials: int = 5, share: float = 0.9, most: float = 0.25, least: int = 2, samples: int = 1, seed: int = 0) -> DataFrame:
    """(window, trials, held): how many seeded subsamples of each window, clustered anew, keep clear of a cluster with more than `most` of it."""
    vectors = cut(vectors.select("window", "id", "vector"))
    tried = subsamples(vectors, [share], trials, seed)
    names = tried.select("window", "own").distinct()
    found = labelled(tried, subsample_trees(vectors, [share], trials, seed, samples), [(least, 0.0)]).withColumn("samples", F.lit(samples).cast("long"))
    return _judged(found, most).join(names, "window").groupBy(F.col("own").alias("window")).agg(F.count("*").alias("trials"), F.count_if("ok").alias("held"))


def density_curve(vectors: DataFrame, shares: list[float], trials: int = 3, coherence: float = 0.5, wide: int = 3, seed: int = 0) -> DataFrame:
    """vectors(window, id, vector, source) -> (window, share, articles, clusters, usable, wide, exponent): subsamples clustered anew, averaged by share.

    Usable clusters have two sources and the coherence asked for, wide ones `wide` sources of those. exponent is the
    slope of log wide over log articles between the least share and the whole; null where either is 0 or they are as large.
    """

    def counts(points: pa.Table, edges: pa.Table) -> pa.Table:
        """How many clusters of a window there are, are usable and are wide. Its task holds its vectors once, as it holds its tree."""
        order = np.argsort(points.column("id").to_numpy())
        ids, found = points.column("id").to_numpy()[order], [0, 0, 0]
        label = tree_labels(len(ids), *(np.searchsorted(ids, edges.column(c).to_numpy()) for c in ("a", "b")), edges.column("w").to_numpy())
        if (label >= 0).any():
            order, label = (x[label >= 0] for x in (order, label))
            together = np.argsort(label, kind="stable")
            order, label, n = order[together], label[together], np.bincount(label)
            sums = np.add.reduceat(matrix(points.column("v"))[order], np.cumsum(n) - n, axis=0)
            close = ((sums * sums).sum(axis=1) - n) / (n * (n - 1))
            source = points.column("source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()[order].astype(np.int64)
            pairs = np.unique(label[source >= 0] * (source.max() + 1) + source[source >= 0])
            sources = np.bincount(pairs // (source.max() + 1), minlength=len(n)) if len(pairs) else np.zeros(len(n))
            firm = (close >= coherence) & (sources >= 2)
            found = [len(n), int(firm.sum()), int((firm & (sources >= wide)).sum())]
        return pa.table({"window": [points.column("window")[0].as_py()] if len(ids) else [], **{c: [v] if len(ids) else [] for c, v in zip(("clusters", "usable", "wide"), found, strict=True)}}, schema=_COUNTS)

    tried = subsamples(cut(vectors.select("window", "id", "vector", "source")), shares, trials, seed)
    points = tried.where("window is not null and id is not null and vector is not null").select(F.col("window").cast("long").alias("window"), F.col("id").cast("long").alias("id"), as_numbers(tried, "vector").alias("v"), F.col("source").cast("string").alias("source"))
    edges = spanning_tree(tried).withColumnRenamed("window", "of")
    runs = points.groupBy("window").cogroup(edges.groupBy("of")).applyInArrow(counts, "window long, clusters long, usable long, wide long")
    zero = {"clusters": 0, "usable": 0, "wide": 0}
    all_ = tried.groupBy("window", "own", "share").agg(F.count("*").alias("articles")).join(runs, "window", "left").fillna(zero)
    curve = all_.groupBy(F.col("own").alias("window"), "share").agg(*[F.avg(c).alias(c) for c in ("articles", *zero)])
    ends = curve.groupBy("window").agg(*[F.min_by(c, "share").alias(c + "0") for c in ("articles", "wide")], *[F.max_by(c, "share").alias(c + "1") for c in ("articles", "wide")])
    grown = (F.col("wide0") > 0) & (F.col("wide1") > 0) & (F.col("articles1") > F.col("articles0"))
    slope = F.when(grown, F.log(F.col("wide1") / F.col("wide0")) / F.log(F.col("articles1") / F.col("articles0")))
    return curve.join(ends.select("window", slope.alias("exponent")), "window")
