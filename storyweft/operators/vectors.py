"""Vector operators: centroids, coherence, search, similarity joins in blocks, quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .snapshots import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Element-wise mean per key, partial sums before the shuffle."""
    cells = vectors.select(key, F.posexplode(column).alias("pos", "x"))
    return cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def coherence(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Mean pairwise cosine of unit vectors, from the length of their sum: (|sum|^2 - n) / (n (n - 1)); 1 for one member."""
    sums = centroids(vectors, key, column).withColumn("q", dot(F.col("centroid"), F.col("centroid")) * F.col("n") * F.col("n"))
    return sums.select(key, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def nearest(vectors: DataFrame, column: str, query: list[float], k: int, most_distance: float | None = None, tie: str = "vec_id") -> DataFrame:
    """Exact top k by cosine distance; the distance limit applies after the cut to k."""
    q = F.lit([float(x) for x in query])
    norm = lambda a: F.sqrt(dot(a, a))
    rows = vectors.withColumn("distance", 1 - dot(F.col(column), q) / (norm(F.col(column)) * norm(q))).orderBy(F.asc_nulls_last("distance"), tie).limit(k)
    return rows if most_distance is None else rows.where(F.col("distance") <= most_distance)


def medoids(vectors: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """The value whose vector is nearest to its key's centroid."""
    near = vectors.join(centroids(vectors, key, column).select(key, "centroid"), key).withColumn("sim", dot(F.col(column), F.col("centroid")))
    return near.groupBy(key).agg(F.max_by(value, F.struct(F.round("sim", 9), -F.col(value))).alias("medoid"))


def quantise(v: Column) -> Column:
    """int8 codes and their scale; halves go to the even number."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127
    return F.struct(F.when(scale > 0, F.transform(v, lambda x: F.bround(x.cast("double") / scale).cast("int"))).alias("codes"), scale.alias("scale"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of a matrix."""
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; squares are rounded to 12 places, so that equal rows are 0 apart and block sizes don't show."""
    out = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
    out -= 2 * (x @ y.T)
    return np.sqrt(np.round(np.maximum(out, 0, out=out), 12, out=out), out=out)


#: Blocks of a group at most. Larger groups have larger blocks, cut into tiles within a task, so that what is shuffled grows with the rows, not with their square.
BLOCKS = 8


def as_numbers(rows: DataFrame, column: str) -> Column:
    """A vector as it is if its type is exact as double, else as array of double."""
    return F.col(column) if dict(rows.select(column).dtypes)[column] in ("array<float>", "array<double>") else F.col(column).cast("array<double>")


def placed(rows: DataFrame, tile: int) -> DataFrame:
    """rows(g, id, ...) with the block of each and how many its group has: one of about `tile` rows each, BLOCKS at most."""
    cuts = rows.groupBy("g").agg(F.least(F.ceil(F.count("*") / tile), F.lit(BLOCKS)).cast("int").alias("blocks"))
    return rows.join(cuts, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def in_tiles(held: DataFrame, run, schema: str, more: list[str] = []) -> DataFrame:  # noqa: B006
    """run(left, right) over each unordered pair of a group's blocks, a block with itself included, placed(...) rows as tables (g, id, v, block, *more)."""
    columns = ["g", "id", "v", "block", *more]
    left = held.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1))).select(*columns, F.col("block").alias("i"), F.col("other").alias("j"))
    # A block meets itself with the rows that are there as the first of its pairs.
    right = held.where("block > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block") - 1))).select(*[F.col(c).alias("r_" + c) for c in columns], F.col("other").alias("r_i"), F.col("block").alias("r_j"))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        own = len(a) and a.column("i")[0].as_py() == a.column("j")[0].as_py()
        return run(a, a if own else b.rename_columns(a.column_names))

    return left.groupBy("g", "i", "j").cogroup(right.groupBy("r_g", "r_i", "r_j")).applyInArrow(pair, schema)


def same_block(left: pa.Table, right: pa.Table) -> bool:
    return left.column("block")[0].as_py() == right.column("block")[0].as_py()


def steps(n: int, m: int, tile: int, same: bool):
    """(rows, rows) slices of a block of n and one of m rows: each pair of their tiles, each unordered pair if they are one block."""
    for a in range(0, n, tile):
        for b in range(a if same else 0, m, tile):
            yield slice(a, min(n, a + tile)), slice(b, min(m, b + tile))


def _shared(i: np.ndarray, j: np.ndarray, left: slice, right: slice, words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """How many words the rows i of `left` and j of `right` share, pair by pair, i in order. words: distinct in a row, as numbers below n; starts: where a row's begin."""
    out, mark, i, j = np.zeros(len(i), np.int64), np.zeros(n, bool), i + left.start, j + right.start
    edge = np.flatnonzero(np.diff(i, prepend=-1, append=-1)).tolist() if len(i) else []
    for a, b in zip(edge, edge[1:]):
        own, begin, end = words[starts[i[a]] : starts[i[a] + 1]], starts[j[a:b]], starts[j[a:b] + 1]
        mark[own] = True
        met = mark[np.concatenate([words[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)])]
        out[a:b] = np.diff(np.concatenate(([0], np.cumsum(met)))[np.concatenate(([0], np.cumsum(end - begin)))])
        mark[own] = False
    return out


def _similar(floor: float, tile: int, worded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The similar pairs of one pair of blocks, a pair of tiles at a time."""
        rows = pa.Table.from_batches(list(batches))
        # The rows of the first block, then those of the second.
        rows = rows.take(np.argsort(rows.column("block").to_numpy(), kind="stable"))
        ids, x, i, j = rows.column("id").to_numpy(), matrix(rows.column("v")), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        cut_at = int((rows.column("block").to_numpy() == i).sum())
        if worded:
            lists = pc.split_pattern(rows.column("words"), " ")
            codes = pa.chunked_array([c.flatten() for c in lists.chunks], pa.string()).dictionary_encode().combine_chunks()
            words, n = codes.indices.to_numpy(), len(codes.dictionary)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(size)))
        far = 0 if i == j else cut_at
        for a, b in steps(cut_at, len(ids) - far, tile, i == j):
            b = slice(b.start + far, b.stop + far)
            sim = x[a] @ x[b].T
            p, q = np.nonzero(sim >= floor)
            one, two = ids[a][p], ids[b][q]
            # Within a tile each pair is met twice, elsewhere once.
            keep = one < two if a == b else one != two
            p, q, one, two = (c[keep] for c in (p, q, one, two))
            out = {"a": np.minimum(one, two), "b": np.maximum(one, two), "sim": sim[p, q]}
            if worded:
                own, other = size[a][p], size[b][q]
                out |= {"words_a": np.where(one < two, own, other), "words_b": np.where(one < two, other, own), "shared": _shared(p, q, a, b, words, starts, n)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def similar_pairs(vectors: DataFrame, floor: float, id_col: str = "vec_id", column: str = "embedding", group: str | None = None, tile: int = 2048, words: str | None = None) -> DataFrame:
    """Pairs (a < b, sim) of dot product `floor` or more, inside `group` if set, by a blocked matrix product.

    A group is cut into a few blocks, however large it is, and each unordered pair of its blocks is one task, which goes
    through it by tiles of `tile` rows and passes on a tile's pairs at once: what is shuffled grows with the rows. Rows
    with a null id, vector or group take no part; ids are unique. With `words`, a column of each row's distinct words,
    pairs have (words_a, words_b, shared) too: how many each has, and both. No row is joined with each of its pairs.
    """
    more = [F.nullif(F.array_join(words, " "), F.lit("")).alias("words")] if words else []
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(id_col).cast("long").alias("id"), as_numbers(vectors, column).alias("v"), (F.col(group) if group else F.lit(0)).cast("long").alias("g"), *more).where("id is not null and g is not null")
    other = placed(rows, tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select("g", "id", "v", "block", *["words"] * bool(words), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.groupBy("g", "i", "j").applyInArrow(_similar(floor, tile, bool(words)), "a long, b long, sim double" + ", words_a long, words_b long, shared long" * bool(words))


def low_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): left @ right.T has for each row of x and of y a number not above the square of their distance, less by what rounding can add; in short floats, where they hold it."""
    n = [np.einsum("ij,ij->i", v, v) for v in (x, y)]
    kind = np.float32 if max(v.max(initial=0.0) for v in n) < 1e30 else np.float64
    low = [v * (1 - (x.shape[1] + 8) * np.finfo(kind).eps) for v in n]
    return np.column_stack((-2 * x, low[0], np.ones(len(x)))).astype(kind), np.column_stack((y, np.ones(len(y)), low[1])).astype(kind)


def over(squares: np.ndarray) -> np.ndarray:
    """Squares of distances, raised by what their rounding to 12 places and to short floats can take away."""
    return squares * (1 + 1e-6) + 1e-11


def pair_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x and that of y: `distances`, the same whatever other rows there are."""
    x = x - y
    return np.sqrt(np.round(np.einsum("ij,ij->i", x, x), 12))


#: Pairs whose distances are taken at once.
PAIRS = 1 << 16


def _finite(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors, by id, of the rows whose vectors have a finite length."""
    ids, x = t.column("id").to_numpy(), matrix(t.column("v"))
    with np.errstate(over="ignore", invalid="ignore"):
        rows = np.flatnonzero(np.isfinite(np.einsum("ij,ij->i", x, x)))
    rows = rows[np.argsort(ids[rows], kind="stable")]
    return ids[rows], x[rows]


class _Nearest:
    """The k nearest found so far of each row of a block, by distance, then id."""

    def __init__(self, t: pa.Table, k: int):
        self.ids, self.x = _finite(t)
        self.d, self.other = np.full((len(self.ids), k), np.inf), np.full((len(self.ids), k), np.iinfo(np.int64).max)
        self.most = np.full(len(self.ids), np.inf)

    def begin(self, rows: slice, low: np.ndarray, far: np.ndarray) -> None:
        """Bounds of rows that have none: as many others are no farther. far: squares of the lengths of these others."""
        k = self.d.shape[1]
        if k <= low.shape[1] and np.isinf(self.most[rows]).all():
            own = np.einsum("ij,ij->i", self.x[rows], self.x[rows])
            error = 2 * (self.x.shape[1] + 8) * np.finfo(low.dtype).eps * (own + far.max())
            self.most[rows] = over(np.maximum(np.partition(np.ascontiguousarray(low), k - 1, axis=1)[:, k - 1].astype(float) + error, 0))

    def useful(self, i: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Not so those that come after k rows without any distance."""
        return (self.d[i, -1] > 0) | (other < self.other[i, -1])

    def take(self, i: np.ndarray, d: np.ndarray, other: np.ndarray) -> None:
        k, rows = self.d.shape[1], np.unique(i)
        i, d, other = np.concatenate((np.repeat(rows, k), i)), np.concatenate((self.d[rows].ravel(), d)), np.concatenate((self.other[rows].ravel(), other))
        order = np.lexsort((other, d, i))
        first = np.searchsorted(i[order], rows)[:, None] + np.arange(k)
        self.d[rows], self.other[rows] = d[order][first], other[order][first]
        self.most[rows] = np.minimum(self.most[rows], over(self.d[rows, -1] ** 2))


def nearest_placed(held: DataFrame, k: int, tile: int = 2048) -> DataFrame:
    """`nearest_each` of placed(...) rows. A product in short floats tells which pairs may be near enough; only their distances are taken."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        same = len(left) and len(right) and same_block(left, right)
        sides = [_Nearest(t, k) for t in ([left] if same else [left, right])]
        one, two = sides[0], sides[-1]
        rough = low_squares(one.x, two.x)
        for a, b in steps(len(one.ids), len(two.ids), tile, same):
            own = same and a == b
            low = rough[0][a] @ rough[1][b].T
            if own:
                np.fill_diagonal(low, np.inf)
            one.begin(a, low, np.einsum("ij,ij->i", two.x[b], two.x[b]))
            if not own:
                two.begin(b, low.T, np.einsum("ij,ij->i", one.x[a], one.x[a]))
            met = low <= one.most[a][:, None].astype(low.dtype)
            if not own:
                met |= low <= two.most[b][None].astype(low.dtype)
            at = np.flatnonzero(met)
            for c in range(0, len(at), PAIRS):
                i, j = np.divmod(at[c : c + PAIRS], low.shape[1])
                i, j = i + a.start, j + b.start
                keep = one.ids[i] != two.ids[j]
                keep &= one.useful(i, two.ids[j]) | (False if own else two.useful(j, one.ids[i]))
                i, j = i[keep], j[keep]
                d = pair_distances(one.x[i], two.x[j])
                one.take(i, d, two.ids[j])
                if not own:
                    two.take(j, d, one.ids[i])
        out = []
        for side in sides:
            n = np.isfinite(side.d).sum(axis=1)
            out.append(pa.table({"g": np.full(len(n), left.column("g")[0].as_py() if len(n) else 0, np.int64), "id": side.ids, **{c: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), v[np.isfinite(side.d)]) for c, v in (("d", side.d), ("other", side.other))}}))
        return pa.concat_tables(out)

    found = in_tiles(held, run, "g long, id long, d array<double>, other array<long>").where(F.size("d") > 0)
    return found.groupBy("g", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", F.col("other").alias("id"))))), 1, k).alias("near"))


def nearest_members(k: int, tile: int = 2048):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """asked(g, id, v, k, block), rows(g, id, v, own, block) of one block: the nearest other rows of the block to each asked one, as lists, that have bit k of `own`."""
        out = [pa.table({"g": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "k": pa.array([], pa.int64()), "d": pa.array([], pa.list_(pa.float64())), "other": pa.array([], pa.list_(pa.int64()))})]
        asked = asked.rename_columns([c.removeprefix("q_") for c in asked.column_names])
        bits, numbers = rows.column("own").to_numpy(), asked.column("k").to_numpy()
        for bit in np.unique(numbers):
            mine = np.flatnonzero(bits >> bit & 1)
            if not len(mine):
                continue
            one = _Nearest(asked.take(np.flatnonzero(numbers == bit)), k)
            ids, x = _finite(rows.take(mine))
            rough = low_squares(one.x, x)
            for a, b in steps(len(one.ids), len(ids), tile, False):
                low = rough[0][a] @ rough[1][b].T
                low[one.ids[a][:, None] == ids[b][None]] = np.inf
                one.begin(a, low, np.einsum("ij,ij->i", x[b], x[b]))
                i, j = np.nonzero((low <= one.most[a][:, None].astype(low.dtype)) & np.isfinite(low))
                for c in range(0, len(i), PAIRS):
                    p, q = i[c : c + PAIRS] + a.start, j[c : c + PAIRS] + b.start
                    one.take(p, pair_distances(one.x[p], x[q]), ids[q])
            met = np.isfinite(one.d)
            lists = [pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(met.sum(axis=1)))).astype(np.int32), v[met]) for v in (one.d, one.other)]
            out.append(pa.table({"g": np.full(len(one.ids), rows.column("g")[0].as_py(), np.int64), "a": one.ids, "k": np.full(len(one.ids), bit, np.int64), "d": lists[0], "other": lists[1]}))
        return pa.concat_tables(out)

    return run


def nearest_each(rows: DataFrame, k: int, tile: int = 2048) -> DataFrame:
    """rows(g, id, v) -> (g, id, near): the `k` nearest other rows of the group (all, if fewer), as (d, id) by distance, then id. A pair of blocks keeps k a row, which are merged; a row alone in its group is left out."""
    return nearest_placed(cut(placed(rows, tile)), k, tile)


def separation(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, first, second): distances to the nearest and second nearest other row; null where there is none. Every row with an id and a vector comes back; ids are unique."""
    rows = vectors.select(F.lit(0).cast("long").alias("g"), F.col(id_col).cast("long").alias("id"), as_numbers(vectors, column).alias("v")).where("id is not null and v is not null")
    near = nearest_each(rows, 2).select("id", "near")
    return rows.select("id").join(near, "id", "left").select("id", F.get("near", F.lit(0)).getField("d").alias("first"), F.get("near", F.lit(1)).getField("d").alias("second"))


def collapse_hits(hits: DataFrame, floor: float = 0.25, most: int = 120, show: int = 20) -> DataFrame:
    """Hits (article_id, cluster_id, sim) above the floor, the first `most`, one per story, the first `show`."""
    top = hits.where(F.col("sim") >= floor).orderBy(F.desc("sim"), "article_id").limit(most)
    own = Window.partitionBy(F.coalesce(F.concat(F.lit("s"), F.col("cluster_id").cast("string")), F.concat(F.lit("a"), F.col("article_id").cast("string")))).orderBy(F.desc("sim"), "article_id")
    return top.withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn").orderBy(F.desc("sim"), "article_id").limit(show)
