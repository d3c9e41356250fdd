"""Runs over a sliding window, commits of several tables, and statistics by resampling."""

import datetime

import numpy as np
import byrows
import pytest
from pyspark.sql import functions as F

from storyweft.operators import evalstats, runs

T0 = datetime.datetime(2024, 1, 1)


def _articles(spark, rows):
    return spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))], T0 + datetime.timedelta(days=day)) for i, a, day in rows], "article_id long, vector array<double>, published timestamp")


FIRST = [(1, 0.0, 0), (2, 0.001, 0), (3, 1.0, 1), (4, 1.001, 1), (5, 2.0, 2), (6, 2.002, 2), (7, 4.0, 2)]


def _stories(spark, root):
    out = {}
    for r in runs.state(spark, root)["members"].collect():
        out.setdefault(r.cluster_id, set()).add(r.article_id)
    return out


def test_ids_continue_and_analyses_of_changed_stories_go(spark, tmp_path):
    root = str(tmp_path / "stories")
    assert runs.state(spark, root) == {}
    assert runs.recluster(spark, root, _articles(spark, FIRST), most=0.5) == {"unchanged": 0, "changed": 0, "new": 3, "ended": 0}
    old = _stories(spark, root)
    assert sorted(map(sorted, old.values())) == [[1, 2], [3, 4], [5, 6]]
    of = {frozenset(v): k for k, v in old.items()}
    done = runs.state(spark, root)["clusters"].withColumn("status", F.lit("deep"))
    runs.commit_all(spark, root, {"clusters": done, "analyses": spark.createDataFrame([(k, "text") for k in old], runs.ANALYSES)})
    # Story 1-2 falls out of the window, 3-4 grows, 5-6 stays, 8-9 is new.
    second = [*FIRST[2:], (8, 3.0, 8), (9, 3.001, 8), (10, 1.0005, 8)]
    assert runs.recluster(spark, root, _articles(spark, FIRST[:2] + second), most=0.5) == {"unchanged": 1, "changed": 1, "new": 1, "ended": 1}
    now, tables = _stories(spark, root), runs.state(spark, root)
    assert now[of[frozenset({3, 4})]] == {3, 4, 10} and now[of[frozenset({5, 6})]] == {5, 6} and of[frozenset({1, 2})] not in now
    assert set(now) - set(old) == {k for k, v in now.items() if v == {8, 9}}
    status = {r.cluster_id: r.status for r in tables["clusters"].collect()}
    assert status[of[frozenset({5, 6})]] == "deep" and status[of[frozenset({3, 4})]] == "pending"
    assert [r.cluster_id for r in tables["analyses"].collect()] == [of[frozenset({5, 6})]]


def test_a_crash_leaves_the_old_state_and_the_next_run_the_new(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "stories")
    runs.recluster(spark, root, _articles(spark, FIRST), most=0.5)
    old = _stories(spark, root)
    more = _articles(spark, [*FIRST, (8, 3.0, 3), (9, 3.001, 3)])

    def crash(*_):
        raise OSError("lost")

    plan = runs.commit_all

    def half(spark, root, tables, after=None):
        tables = dict(tables)
        last = tables.popitem()
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}/v-half")
        crash(last)

    monkeypatch.setattr(runs, "commit_all", half)
    with pytest.raises(OSError):
        runs.recluster(spark, root, more, most=0.5)
    assert _stories(spark, root) == old
    monkeypatch.setattr(runs, "commit_all", plan)
    assert runs.recluster(spark, root, more, most=0.5) == {"unchanged": 3, "changed": 0, "new": 1, "ended": 0}
    assert {k: v for k, v in _stories(spark, root).items() if k in old} == old


def test_degenerate_and_overtaken_runs_change_nothing(spark, tmp_path):
    root = str(tmp_path / "stories")
    runs.recluster(spark, root, _articles(spark, FIRST), most=0.5)
    old = _stories(spark, root)
    with pytest.raises(runs.Degenerate):
        runs.recluster(spark, root, _articles(spark, FIRST), most=0.2)
    with pytest.raises(runs.Overtaken):
        runs.commit_all(spark, root, {}, after=0)
    assert _stories(spark, root) == old


def test_stream_of_articles(spark, tmp_path):
    root, source = str(tmp_path / "stories"), str(tmp_path / "landed")
    kind = "article_id long, vector array<double>, published timestamp"
    for rows in (FIRST[:4], FIRST[4:]):
        _articles(spark, rows).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(kind).json(source).writeStream.foreachBatch(runs.each_batch(root, str(tmp_path / "history"), most=0.9))
        stream.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(sorted, _stories(spark, root).values())) == [[1, 2], [3, 4], [5, 6]]


def _labels(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id is not null").select(
        F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").otherwise("neu").alias("gold"), F.col("doc_id").alias("i"))
    guess = F.when(F.col("i") % 7 < 5, F.col("gold")).otherwise("neu")
    return rows.select("gold", guess.alias("a"), F.when(F.col("i") % 3 == 0, F.col("gold")).otherwise("pos").alias("b"))


def test_bootstrap_by_cells_equals_resampled_rows(spark):
    rows = _labels(spark)
    got = [tuple(r[c] for r in rows.collect()) for c in ("gold", "a", "b")]
    low, high = byrows.paired_bootstrap(*map(list, got), times=5000)
    r = evalstats.bootstrap(rows, "gold", "a", "b").first()
    assert (r.n, r.value) == (len(got[0]), pytest.approx(byrows.f1(got[0], got[1]) - byrows.f1(got[0], got[2])))
    assert abs(r.low - low) < 0.005 and abs(r.high - high) < 0.005
    assert tuple(evalstats.bootstrap(rows, "gold", "a", "b").first()) == tuple(r)
    one = evalstats.bootstrap(rows, "gold", "b", times=300).first()
    assert one.value == pytest.approx(byrows.f1(got[0], got[2])) and one.low < one.value < one.high


def test_bootstrap_of_nothing_and_of_certainty(spark):
    kind = "gold string, a string"
    assert tuple(evalstats.bootstrap(spark.createDataFrame([], kind), "gold", "a", times=20).first()) == (0, None, None, None)
    assert tuple(evalstats.bootstrap(spark.createDataFrame([("pos", None), ("odd", "pos")], kind), "gold", "a", times=20).first())[0] == 0
    r = evalstats.bootstrap(spark.createDataFrame([(c, c) for c in evalstats.CLASSES] * 50, kind), "gold", "a", times=50).first()
    assert (r.value, r.low, r.high) == (1.0, 1.0, 1.0)


def test_tuned_and_fixed_thresholds(spark):
    dev = spark.createDataFrame([("pos", 0.5), ("neu", 0.3), ("neg", -0.5), ("neu", -0.2)] * 5, "gold string, score double")
    out = {r.threshold_of: r for r in evalstats.tuned_and_fixed(dev, dev, times=50).collect()}
    assert out["dev"].value == 1.0 and 0.3 <= out["dev"].threshold < 0.5 and out["fixed"].threshold == 0.15 and out["fixed"].value < 1
    assert evalstats.tuned_and_fixed(dev, dev.limit(9), times=20).collect() == []


def test_kappas_and_mcnemar_equal_plain_python(spark):
    rows = _labels(spark)
    got = [[r[c] for r in rows.collect()] for c in ("gold", "b")]
    r = evalstats.kappas(rows, "gold", "b").first()
    assert r.kappa == pytest.approx(byrows.kappa(*got)) and r.quadratic == pytest.approx(byrows.kappa(*got, quadratic=True))
    same = evalstats.kappas(spark.createDataFrame([("pos", "pos")] * 3, "a string, b string"), "a", "b").first()
    assert tuple(same) == (3, 1.0, 1.0)
    pairs = [(0, 0), (5, 0), (3, 9), (40, 25), (900, 1000), (7, 7)]
    df = spark.createDataFrame(pairs, "b long, c long")
    assert {(x.b, x.c): x.p for x in df.select("b", "c", evalstats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()} == {k: pytest.approx(byrows.mcnemar(*k)) for k in pairs}
