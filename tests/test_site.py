"""Sites written at once, the persisted vector index, and benchmark runs."""

import json
import sys

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from storyweft.operators import benchmark, vector_index
from storyweft.sources import site


def _pages(spark):
    stories = spark.createDataFrame([(1, "Rain & <sun>", 3), (2, "Vote", 5), (3, "Empty", 0)], "story long, title string, outlets long")
    articles = spark.createDataFrame([(1, "A", "one", "https://x/a?b=1", 2), (1, "B", "two", "javascript:x", 1), (2, "C", None, "http://y/", 1)], "story long, title string, source string, url string, published long")
    return stories, site.story_pages(stories, articles)


def test_pages_are_in_place_at_once_and_links_hold(spark, tmp_path):
    spark.dataSource.register(site.Site)
    at = str(tmp_path / "site")
    stories, pages = _pages(spark)
    expected = pages.select("path")
    assert site.built(spark, at).collect() == [] and site.checked(spark, at, expected).count() == 5
    pages.write.format("site").mode("append").save(at)
    have = {r.path: r.at for r in site.built(spark, at).collect()}
    assert set(have) == {"story-1.html", "story-2.html", "story-3.html", "index.html", "bundle.json"} and site.checked(spark, at, expected).collect() == []
    text = open(have["story-1.html"]).read()
    assert "<h1>Rain &amp; &lt;sun&gt;</h1>" in text and 'href="https://x/a?b=1"' in text and "javascript" not in text and text.index(">B<") < text.index(">A<")
    assert [s["story"] for s in json.load(open(have["bundle.json"]))] == [1, 2, 3]
    index = open(have["index.html"]).read()
    assert index.index("story-2") < index.index("story-1") < index.index("story-3")
    # Fewer pages: what isn't written any more is gone, and a link to it is noticed.
    pages.where("path <> 'story-2.html'").write.format("site").mode("append").save(at)
    assert sorted(map(tuple, site.checked(spark, at, expected).collect())) == [("index.html", "no page story-2.html"), ("story-2.html", "missing")]


@pytest.mark.parametrize("bad", ["story-1.html", "../out.html", None, "/etc/x"])
def test_a_failed_write_leaves_no_page(spark, tmp_path, bad):
    spark.dataSource.register(site.Site)
    at = str(tmp_path / "site")
    _, pages = _pages(spark)
    pages.write.format("site").mode("append").save(at)
    before = sorted(map(tuple, site.built(spark, at).collect()))
    more = pages.unionByName(spark.createDataFrame([(bad, "x")], "path string, html string"))
    with pytest.raises(Exception):  # noqa: B017
        more.write.format("site").mode("append").save(at)
    assert sorted(map(tuple, site.built(spark, at).collect())) == before and not (tmp_path / "out.html").exists()

    def lost(i):
        raise OSError("lost")

    fails = F.udf(lost, "string")
    with pytest.raises(Exception):  # noqa: B017
        pages.withColumn("html", fails("path")).write.format("site").mode("append").save(at)
    assert sorted(map(tuple, site.built(spark, at).collect())) == before
    assert PythonException


def _nearest(x, ids, q, k):
    u = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    d = 1 - u(x) @ u(x[q])
    d[q] = np.inf
    return [int(ids[i]) for i in np.lexsort((ids, np.round(d, 12)))[:k]]


def test_index_recall_and_exact_search(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)) * 0.4
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame([*rows, (9000, None), (None, x[0].tolist()), (9001, [0.0] * 24), (9002, [float("nan")] * 24)], "vec_id long, embedding array<double>")
    at = str(tmp_path / "index")
    vector_index.build(vectors, at, sample=1000)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    ids = np.arange(3000)
    for probes, least in ((8, 0.9), (10_000, 1.0)):
        hits, read = vector_index.search(spark, at, asked, k=10, probes=probes)
        got = {}
        for r in hits.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        shares = [len(set(got[q]) & set(_nearest(x, ids, q, 10))) / 10 for q in range(0, 3000, 100)]
        assert np.mean(shares) >= least
        scanned = [r.scanned for r in read.collect()]
        assert len(scanned) == 30 and (max(scanned) < 1500 if probes == 8 else min(scanned) == 3000)
        if probes > 8:
            assert all(got[q] == _nearest(x, ids, q, 10) for q in got)
    again, _ = vector_index.search(spark, at, spark.createDataFrame([(7, x[7].tolist())], "query_id long, vector array<double>"), k=1, itself=True)
    assert again.first().id == 7


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    vector_index.build(none, str(tmp_path / "index"))
    hits, read = vector_index.search(spark, str(tmp_path / "index"), spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"))
    assert hits.collect() == [] and read.collect() == []


SCORER = "import json, sys\nfor line in sys.stdin:\n    q = json.loads(line)\n    w = q['text'].split()\n    print(json.dumps({'id': q['id'], 'score': (w.count('good') - w.count('bad')) * float(sys.argv[1])}), flush=True)\n"


def test_second_run_scores_nothing_and_evidence_decides(spark, tmp_path):
    program = tmp_path / "scorer.py"
    program.write_text(SCORER)
    command = lambda weight: [sys.executable, str(program), weight]
    texts = [("good", "pos"), ("bad", "neg"), ("plain", "neu")]
    items = spark.createDataFrame([(i, f"{texts[i % 3][0]} text {i}", texts[i % 3][1], "mt" if i % 2 else "rw") for i in range(240)], "id long, text string, gold string, set string")
    methods = {"weak": (command("0.1"), "w1"), "strong": (command("1"), "w1")}
    cache = str(tmp_path / "cache")
    scored, asked = benchmark.predictions(items, methods, cache, timeout=20)
    assert asked == {"weak": 240, "strong": 0} or asked == {"weak": 240, "strong": 240}
    methods = {"weak": (command("0.1"), "weak-1"), "strong": (command("1"), "strong-1")}
    scored, asked = benchmark.predictions(items, methods, cache, timeout=20)
    assert asked == {"weak": 240, "strong": 240}
    again, asked = benchmark.predictions(items, {k: (["/nonexistent"], v) for k, (_, v) in methods.items()}, cache)
    assert asked == {"weak": 0, "strong": 0} and again.where("weak is null or strong is null").count() == 0
    limits = {"weak": 0.15, "strong": 0.15}
    out = benchmark.decision(scored, "weak", "strong", limits, times=200).collect()
    assert {r.set for r in out} == {"mt", "rw"} and all(r.adopt and r.ahead and r.value > 0.5 for r in out)
    assert not any(r.adopt for r in benchmark.decision(scored, "strong", "weak", limits, times=200).collect())
    apart = benchmark.disagreements(scored, "weak", "strong", limits).groupBy("right").count().collect()
    assert {r.right: r["count"] for r in apart} == {"proposed": 160}
