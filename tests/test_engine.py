"""The comparison engine: rules on the reference shapes, and every query with SQL against DuckDB."""

import json
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft import catalog
from storyweft.functions import text as T
import byrows
from storyweft.operators import clustering, comparison, evalstats, extract, grouping, models, stories, vectors
from storyweft.streaming import ingest

DATA = "/root/testdata/sf0.001"


def values(spark, expr, rows, kind="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], kind).select(expr(F.col("x"))).collect()]


def test_text_functions(spark):
    assert values(spark, T.clean_text, [" a  b\n", None]) == ["a b", ""]
    assert values(spark, T.is_web_url, ["https://a", "HTTP://a", "javascript:x", "data:x", "//h", "", " https://a", None]) == [True, True, False, False, False, False, False, False]
    assert values(spark, T.singular, ["counties", "boxes", "cats", "glass"]) == ["county", "box", "cat", "glass"]
    assert values(spark, T.stem, ["running", "used", "cars"]) == ["runn", "used", "cars"]
    assert values(spark, T.is_title_case, ["Nairobi Leaders And Others Meet", "Leaders meet in town"]) == [True, False]
    assert values(spark, T.disputed, ["Minister denies claim", "Row over land", "Rain falls"]) == [True, True, False]
    assert values(spark, T.entity_key, ["The President Ruto's", "Dr. Amina"]) == ["ruto", "amina"]
    assert values(spark, lambda x: T.tone_label(x), [0.15, 0.151, -0.15, None], "x double") == ["neutral", "positive", "neutral", None]
    assert values(spark, T.seven_point, ["-1", "0", "3", "x", "", "9"]) == ["negative", "neutral", "positive", "unusable", None, "invalid"]


def test_figures_and_states():
    one = extract.figures("At least 12 people were killed and 3 missing")
    assert [(f["value"], f["unit"]) for f in one] == [(12.0, "people"), (3.0, "people")]
    assert extract.figures("Sh3.5 billion was lost in 2021")[0]["value"] == 3.5e9
    assert [f["value"] for f in extract.figures("forty per cent, or 41%")] == [40.0, 41.0]
    assert extract.figures("In 2021 the 25-year-old ran") == []


def test_quotes_and_roles():
    q = extract.quotes('"We will not accept this at all," said Jane Doe. "They have to pay us now," she added.')
    assert [(x["speaker"], x["how"]) for x in q] == [("Jane Doe", "named"), ("Jane Doe", "pronoun")]
    assert extract.quotes('The "so called" plan') == []
    assert extract.role("Ruto said the plan works", "Ruto")["role"] == "speaks"
    assert extract.role("Ruto was arrested on Monday", "Ruto")["role"] == "acted on"
    assert extract.role("A day with Ruto", "Ruto")["role"] == "mentioned"
    got = extract.names("Governor Sakaja met raila odinga", {"Raila Odinga": ("PERSON", "raila")})
    assert [(e["text"], e["id"]) for e in got] == [("Sakaja", None), ("raila odinga", "raila")]


CONTINUITY = [
    ({1: {1, 2, 3}}, {0: {1, 2, 3}}, {0: 1}),
    ({1: {1, 2}}, {0: set(range(1, 7))}, {0: 1}),
    ({1: {1, 2, 3, 4}}, {0: {3, 4, 9, 10}}, {0: 1}),
    ({1: {1, 2, 3, 4, 5}}, {0: {4, 5, 6, 7, 8}}, {}),
    ({1: {1, 2, 3, 4, 5}}, {0: {1, 2, 3}, 1: {4, 5}}, {0: 1}),
    ({1: {1, 2, 3}, 2: {4, 5}}, {0: {1, 2, 3, 4, 5}}, {0: 1}),
    ({1: {1, 2}}, {0: {8, 9}}, {}),
    ({}, {0: {1, 2}}, {}),
]


@pytest.mark.parametrize(("old", "new", "want"), CONTINUITY)
def test_continuity(spark, old, new, want):
    from storyweft.operators.snapshots import checkpoint_ready

    checkpoint_ready(spark)
    assert clustering.match_clusters(old, new) == want
    a = spark.createDataFrame([(k, x) for k, v in old.items() for x in v], "cluster_id long, article_id long")
    b = spark.createDataFrame([(k, x) for k, v in new.items() for x in v], "label long, article_id long")
    assert {r.label: r.cluster_id for r in clustering.continuity(a, b).collect()} == want


def test_continuity_of_a_chain(spark):
    """Each old cluster shares as much with two new ones, so that about one pair is settled a round."""
    from storyweft.operators.snapshots import checkpoint_ready

    checkpoint_ready(spark)
    old = [(i, 2 * i + k) for i in range(24) for k in (0, 1)]
    new = [(i + k, 2 * i + k) for i in range(24) for k in (0, 1)]
    sets = lambda rows: {c: {a for x, a in rows if x == c} for c, _ in rows}
    got = clustering.continuity(spark.createDataFrame(old, "cluster_id long, article_id long").coalesce(1), spark.createDataFrame(new, "label long, article_id long").coalesce(1))
    assert {r.label: r.cluster_id for r in got.collect()} == clustering.match_clusters(sets(old), sets(new))


def test_hdbscan_finds_planted_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.normal(0, 0.05, (20, 8)) for c in np.eye(8)[:3] * 5] + [rng.normal(0, 1, (3, 8)) + 40])
    labels = clustering.hdbscan(x, 5, 3)
    assert all(len(set(labels[k : k + 20]) - {-1}) == 1 for k in (0, 20, 40)) and len(set(labels[:60]) - {-1}) == 3
    assert clustering.hdbscan(x[:1]).tolist() == [-1]


def test_grouping():
    sim = np.array([[1, 0.7, 0.1, 0], [0.7, 1, 0.65, 0], [0.1, 0.65, 1, 0], [0, 0, 0, 1]])
    assert grouping.leaders(sim, 0.6) == [0, 0, -1, -1]
    assert grouping.complete_linkage(3, lambda i, j: sim[i, j] >= 0.6) == [[0, 1], [2]]
    assert grouping.unite(4, [(0, 1), (1, 2)]) == [0, 0, 0, 3]
    assert grouping.pick_apart(sim, 2, 0.6) == [0, 2]


def test_coverage_and_differences(spark):
    claims = spark.createDataFrame([(1, 1, "a", True), (1, 1, "b", False)], "story long, grp long, source string, same boolean")
    outlets = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", True), (1, "d", False)], "story long, source string, readable boolean")
    r = comparison.coverage(claims, outlets).first()
    assert (r.reported_by, r.related, r.omitted_by) == (["a"], ["b"], ["c"])
    d = spark.createDataFrame([(1, 1, ["first", "same", "says less"], 0.5), (0, 0, [], 0.49)], "r int, f int, q array<string>, g double")
    assert [x[0] for x in d.select(comparison.differences(F.col("r"), F.col("f"), F.col("q"), F.col("g"))).collect()] == [4, 0]


def test_statistics():
    gold, guess = ["neg", "neu", "pos", "pos"], ["neg", "pos", "pos", "neu"]
    assert byrows.f1(gold, guess) == pytest.approx(0.5) and byrows.f1(gold, guess, ("neg", "pos")) == pytest.approx(0.75)
    assert byrows.paired_bootstrap(gold, guess, guess, 200) == (0, 0)
    assert byrows.mcnemar(0, 0) == 1 and byrows.mcnemar(5, 0) == pytest.approx(0.0625)
    share, kept = evalstats.pool_estimate(9, 10, 4, 20, 12, 52)
    assert round(share, 2) == 0.33 and round(kept, 2) == 0.51


def test_models_are_deterministic():
    assert models.embed("a b") == models.embed("b a") and math.isclose(sum(x * x for x in models.embed("a b c")), 1)
    assert models.relation("ten people", "ten people died in the flood today") == "second_more"
    assert models.target_tone("good", 3, 9) is None


def test_rate_limiter():
    ok, log = ingest.admit([0, 1, 2, 60, 60.5], most=2, window=60)
    assert ok == [True, True, False, True, False] and log == [1, 60]


def test_polled_ingest_is_idempotent(spark, tmp_path):
    feed, table = tmp_path / "feed", str(tmp_path / "articles")
    feed.mkdir()
    rows = [{"url": "https://a/1?x=1", "title": "One"}, {"url": "https://a/1#top", "title": "one!"}, {"url": "ftp://a", "title": "No"}, {"url": "https://a/2", "title": " "}]
    for k in range(2):
        (feed / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        ingest.ingest(spark, str(feed), table, str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(table).count() == 1


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, t string, u string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, t string")
    assert sorted(map(tuple, stories.upsert(old, new, "id").collect())) == [(1, "a", "x"), (2, "c", None), (3, "d", None)]
    with pytest.raises(ValueError):
        stories.page(old, limit=0)


@pytest.mark.parametrize("tile", [1, 7, 100])
def test_similar_pairs_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    rows = [(i, x[i].tolist(), i % 2) for i in range(40)] + [(40, None, 0), (None, [1.0] * 4, 0), (41, [1.0] * 4, None)]
    got = vectors.similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>, g long"), 0.5, group="g", tile=tile).collect()
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2 and x[i] @ x[j] >= 0.5}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("tile", [2, 5, 100])
def test_similar_pairs_count_words_where_the_vectors_meet(spark, tile):
    """As by two whole texts a pair, but a row goes to as many tasks as there are blocks, and no pair is joined with texts."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    texts = [" ".join(rng.choice(["Ten", "people", "died", "in", "the", "flood", "été"], size=rng.integers(0, 6))) if i % 9 else None for i in range(40)]
    rows = spark.createDataFrame([(i, x[i].tolist(), i % 2, texts[i]) for i in range(40)], "vec_id long, embedding array<double>, g long, text string").withColumn("words", models.words_of(F.col("text")))
    pairs = vectors.similar_pairs(rows, 0.2, group="g", tile=tile, words="words")
    got = {(r.a, r.b): r.relation for r in pairs.select("a", "b", models.relation_by(F.col("shared"), F.col("words_a"), F.col("words_b")).alias("relation")).collect()}
    want = {(i, j): models.relation(texts[i] or "", texts[j] or "") for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2 and x[i] @ x[j] >= 0.2}
    assert got == want and len(set(want.values())) == 4


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not Path(DATA).exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = Counter(tuple(plain(v) for _, v in sorted(zip(cols, r))) for r in cur.fetchall())
        assert Counter(tuple(plain(v) for _, v in sorted(r.items())) for r in rows) == want
