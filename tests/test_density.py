"""Windows clustered over blocks against the same method in memory, and planted neighbours."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyweft.operators import clustering, density, vectors


def _table(spark, x, window=0, first=0):
    return spark.createDataFrame([(window, first + i, v.tolist()) for i, v in enumerate(x)], "window long, id long, vector array<double>")


def _planted(n, seed, groups=40, width=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, width))[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.15, 1.0], size=(n, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("least, samples, tile", [(2, 1, 300), (5, 3, 4096), (3, 2, 150)])
def test_blocks_of_any_size_give_the_labels_of_the_method_in_memory(spark, least, samples, tile):
    x = _planted(2000 if tile > 200 else 500, 7)
    want = clustering.hdbscan(x, least, samples)
    got = sorted(density.cluster(_table(spark, x), least, samples, tile=tile).select("id", "label").collect())
    assert [r.label for r in got] == want.tolist() and len(set(want)) > 10


def test_tree_of_many_windows_with_copies_ties_and_lone_points(spark):
    """Whole numbers make ties everywhere; the tree is still one, and as light as any."""
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 4, size=(n, 3)).astype(float) for n in (90, 1, 2, 40)]
    rows = None
    for w, x in enumerate(parts):
        one = _table(spark, x, w)
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.unionByName(spark.createDataFrame([(0, 999, None), (None, 998, [1.0, 2.0, 3.0])], rows.schema))
    small = sorted(map(tuple, density.spanning_tree(rows, 2, tile=16).collect()))
    assert small == sorted(map(tuple, density.spanning_tree(rows, 2, tile=5000).collect()))
    assert [sum(e[0] == w for e in small) for w in range(4)] == [89, 0, 1, 39]
    labels = density.cluster(rows, 2, 2, tile=16)
    assert labels.where("window = 1").select("label").collect()[0].label == -1 and labels.count() == 133
    assert density.cluster(rows.limit(0)).collect() == []


def test_what_is_shuffled_grows_with_the_rows(spark, monkeypatch):
    """A group has BLOCKS blocks at most: a row is sent to as many tasks however large its group is. Many tiles in a block give the same tree and neighbours."""
    x = _planted(700, 9)
    rows = _table(spark, x).select(F.col("window").alias("g"), "id", F.col("vector").alias("v"))
    assert vectors.placed(rows, 16).agg(F.max("blocks")).first()[0] == vectors.BLOCKS == vectors.placed(rows.where("id < 300"), 16).agg(F.max("blocks")).first()[0]
    small, large = ({r.id: r.near for r in vectors.nearest_each(rows, 3, tile).collect()} for tile in (16, 4096))
    assert all([n.id for n in small[i]] == [n.id for n in large[i]] for i in range(700))
    assert sorted(map(tuple, density.spanning_tree(_table(spark, x), 2, tile=32).collect())) == sorted(map(tuple, density.spanning_tree(_table(spark, x), 2, tile=4096).collect()))


@pytest.mark.parametrize("scale, whole", [(1.0, True), (1.0, False), (1e17, False)])
def test_few_distances_are_taken_for_the_tree(monkeypatch, scale, whole):
    """Blocks by hand, with copies and far groups: the tree is that of the full matrix, even if the first is left in parts; if not, only some of the second pass's pairs are measured."""
    x = np.concatenate([_planted(900, 4), np.repeat(_planted(3, 8) + 9, 40, axis=0)]) * scale
    n, samples = len(x), 2
    d = vectors.distances(x, x) if scale == 1 else np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    away = d + np.diag(np.full(n, np.inf))
    near = np.lexsort((np.broadcast_to(np.arange(n), d.shape), away), axis=1)[:, :6]
    core = away[np.arange(n), near[:, samples - 1]]
    links = pa.table({"g": np.zeros(n * 6, np.int64), "a": np.repeat(np.arange(n), 6), "b": near.ravel(), "d": vectors.pair_distances(np.repeat(x, 6, axis=0), x[near.ravel()]), "nth": np.tile(np.arange(6), n)})
    part = density.parts_of(n, *(links.column(c).to_numpy() for c in "ab"))
    assert len(np.unique(part)) > 3
    if whole:
        held = {k: np.flatnonzero(part == k) for k in np.unique(part)}
        pairs = [(i, j, np.unravel_index(d[np.ix_(held[i], held[j])].argmin(), (len(held[i]), len(held[j])))) for i in held for j in held if i < j]
        one, two = (np.array(c) for c in zip(*((held[i][p], held[j][q]) for i, j, (p, q) in pairs), strict=True))
        links = pa.concat_tables([links, pa.table({"g": np.zeros(len(one), np.int64), "a": one, "b": two, "d": vectors.pair_distances(x[one], x[two]), "nth": np.full(len(one), -1)})])
    placed = density._first_tree(samples, 64)(links)
    placed = placed.append_column("v", pa.array(x[placed.column("id").to_numpy()].tolist()))
    parts, taken = [placed.take(np.flatnonzero(placed.column("block").to_numpy() == k)) for k in range(vectors.BLOCKS)], []
    monkeypatch.setattr(density, "pair_distances", lambda a, b: (taken.append(len(a)), vectors.pair_distances(a, b))[1])
    edges = pa.concat_tables([density._edges_before(64)(parts[i], parts[j]) for i in range(vectors.BLOCKS) for j in range(i, vectors.BLOCKS)])
    tree = density._window_tree(edges)
    a, b, w = density.dense_tree(np.maximum(d, np.maximum(core[:, None], core[None])))
    assert np.sort(tree.column("w").to_numpy()) == pytest.approx(np.sort(w), rel=1e-9, abs=1e-6)
    if scale == 1:
        assert sorted(zip(*(tree.column(c).to_pylist() for c in "ab"), strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True))
        assert sum(taken) > 0 and (not whole or sum(taken) < 0.1 * n * n / 2)


def test_tree_of_many_groups_of_copies(spark):
    """Every point has more copies than neighbours are looked for, so that no group is linked with another at first."""
    x = np.repeat(_planted(40, 2), density.NEAR + 3, axis=0)
    d = vectors.distances(x, x)
    assert sorted((r.a, r.b, round(r.w, 9)) for r in density.spanning_tree(_table(spark, x), 1, tile=64).collect()) == sorted((a, b, round(w, 9)) for a, b, w in zip(*(v.tolist() for v in density.dense_tree(d)), strict=True))


def test_curve_counts_clusters_by_sources_and_coherence(spark):
    x = _planted(400, 6, groups=30)
    rows = _table(spark, x).withColumn("source", F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 4)))
    labels = clustering.hdbscan(x, 2, 1)
    usable = wide = 0
    for c in set(labels) - {-1}:
        at = np.flatnonzero(labels == c)
        sim = (x[at] @ x[at].T)[np.triu_indices(len(at), 1)].mean()
        n = len({i % 4 for i in at if i % 5})
        usable += sim >= 0.4 and n >= 2
        wide += sim >= 0.4 and n >= 3
    got = density.density_curve(rows, [1.0], coherence=0.4).collect()
    assert [(r.articles, r.clusters, r.usable, r.wide) for r in got] == [(400, len(set(labels) - {-1}), usable, wide)] and usable > wide > 0


def test_epsilon_merges_what_parts_below_it():
    centres = np.array([[0.0, 0], [1, 0], [10, 0], [11, 0], [40, 40]])
    x = np.concatenate([c + np.random.default_rng(i).normal(size=(12, 2)) * 0.05 for i, c in enumerate(centres)])
    n = lambda e: len(set(clustering.hdbscan(x, 3, 1, e)) - {-1})
    assert n(0.0) == 5 and n(2.0) == 3 and n(15.0) == 2


def test_sweep_stability_and_curve(spark):
    x = _planted(240, 5, groups=30)
    rows = _table(spark, x).withColumn("source", F.concat(F.lit("s"), F.col("id") % 4))
    out = {(r.least, r.samples, r.epsilon): r for r in density.sweep(rows, [2, 5], [1, 2], [0.0, 0.7]).collect()}
    assert len(out) == 8
    for (m, k, e), r in out.items():
        labels = clustering.hdbscan(x, m, k, e)
        assert (r.n, r.clusters, r.noise) == (240, len(set(labels) - {-1}), int((labels < 0).sum()))
        assert r.ok == bool(r.clusters and r.largest <= 60)
    held = density.stability(rows, trials=3, seed=1).collect()
    assert [(r.window, r.trials) for r in held] == [(0, 3)] and 0 <= held[0].held <= 3
    curve = {r.share: r for r in density.density_curve(rows, [0.5, 1.0], trials=2, coherence=0.2).collect()}
    labels = clustering.hdbscan(x, 2, 1)
    assert curve[1.0].articles == 240 and curve[1.0].clusters == len(set(labels) - {-1}) and curve[0.5].articles < 240
    if curve[0.5].wide > 0:
        assert curve[1.0].exponent == pytest.approx(np.log(curve[1.0].wide / curve[0.5].wide) / np.log(240 / curve[0.5].articles))


def test_separation_of_lone_points_and_pairs(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (4, None)]
    get = lambda r: {x.id: (x.first, x.second) for x in vectors.separation(spark.createDataFrame(r, "vec_id long, embedding array<double>")).collect()}
    found = get(rows)
    assert found[2] == (pytest.approx(2**0.5), pytest.approx(2.0)) and found[3] == (pytest.approx(2.0), pytest.approx(10**0.5)) and 4 not in found
    assert get(rows[:1]) == {1: (None, None)} and get(rows[:2])[1] == (pytest.approx(2**0.5), None)


@pytest.mark.parametrize("samples, tile", [(1, 32), (3, 4096), (5, 16)])
def test_trees_of_subsamples_made_together_are_those_made_alone(spark, samples, tile):
    """Several windows, copies and ties; small shares leave points with too few near ones, and a part without its first point."""
    rng = np.random.default_rng(5)
    parts = [_planted(260, 4), np.repeat(_planted(12, 8), 9, axis=0), rng.integers(0, 4, size=(90, 3)).astype(float), np.ones((1, 3)), np.concatenate((_planted(40, 1), _planted(40, 2) + 50))]
    rows = None
    for w, x in enumerate(parts):
        one = _table(spark, x, w - 1)
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.unionByName(spark.createDataFrame([(0, 999, None), (None, 998, [1.0, 2.0, 3.0])], rows.schema))
    shares = [0.15, 0.9, 1.0]
    alone = sorted(map(tuple, density.spanning_tree(density.subsamples(rows, shares, 2, 3), samples, tile).collect()))
    assert sorted(map(tuple, density.subsample_trees(rows, shares, 2, 3, samples, tile).collect())) == alone and len(alone) > 1000
    assert density.subsample_trees(rows.limit(0), shares, 2).collect() == []


def test_a_row_is_sent_once_for_all_its_subsamples(spark, monkeypatch):
    """What is dealt to pairs of blocks has a row per point, however often it is drawn."""
    rows, dealt = _table(spark, _planted(300, 3)), []
    for place in (density, vectors):
        monkeypatch.setattr(place, "in_tiles", lambda held, *a, f=vectors.in_tiles: (dealt.append(held.count()), f(held, *a))[1])
    assert density.stability(rows, trials=5).collect()[0].trials == 5
    assert dealt and max(dealt) <= 300


def test_a_block_is_sent_once_for_its_own_pairs(spark):
    """A row meets every block of its group, its own among them, in BLOCKS tasks, and is sent to each once. What only a block needs goes with one of its points."""
    x = _planted(500, 2)
    held = vectors.placed(_table(spark, x).select(F.col("window").alias("g"), "id", F.col("vector").alias("v")), 16)
    sent = vectors.in_tiles(held, lambda a, b: pa.table({"n": [len(a) + (0 if a is b else len(b))], "own": [vectors.same_block(a, b)]}), "n long, own boolean").collect()
    assert sum(r.n for r in sent) == 500 * vectors.BLOCKS and len(sent) == vectors.BLOCKS * (vectors.BLOCKS + 1) / 2 and sum(r.own for r in sent) == vectors.BLOCKS
    one, two = np.arange(499), np.arange(1, 500)
    links = pa.table({"g": np.zeros(998, np.int64), "a": np.concatenate((one, two)), "b": np.concatenate((two, one)), "d": np.ones(998), "nth": np.zeros(998, np.int64)})
    first = density._first_tree(1, 16)(links)
    assert sum(len(v) for v in first.column("mid_w").to_pylist()) == vectors.BLOCKS**2
