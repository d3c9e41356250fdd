"""File sources and sinks, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from storyweft.sources import files

ITEM = "<item><title>{t}</title><link>{u}</link><description>&lt;p&gt;A &amp;amp; b&lt;/p&gt;</description><pubDate>Tue, 03 Nov 2026 06:00:00 {z}</pubDate></item>"


def feed(*items):
    return "<?xml version='1.0'?><rss version='2.0'><channel><title>Feed</title>" + "".join(items) + "</channel></rss>"


def test_feeds(spark, tmp_path):
    many = [ITEM.format(t=f"Story  {i}", u=f"https://a/{i}?x=1", z="GMT") for i in range(30)]
    (tmp_path / "a.xml").write_text(feed(*many))
    (tmp_path / "b.xml").write_text(feed(ITEM.format(t="One", u="ftp://b/1", z="+0300"), ITEM.format(t="Two", u="https://b/2", z="+0300")))
    (tmp_path / "c.xml").write_text("no feed at all")
    (tmp_path / "d.xml").write_text(feed())
    rows = files.feed_items(spark, str(tmp_path)).collect()
    by = lambda x: [r for r in rows if r["feed"].endswith(x)]
    assert sorted(r["pos"] for r in by("a.xml")) == list(range(25)) and by("a.xml")[0]["title"].startswith("Story ")
    assert [(r["title"], r["pos"], r["snippet"], r["published"].hour) for r in by("b.xml")] == [("Two", 1, "A & b", 3)]
    assert {r["feed"][-5:]: (r["items"], r["failed"]) for r in files.feed_report(spark, str(tmp_path)).collect()} == {"a.xml": (30, False), "b.xml": (2, False), "c.xml": (0, True), "d.xml": (0, True)}


def test_atom_feeds(spark, tmp_path):
    entry = "<entry><title type='html'>{t}</title><link rel='self' href='https://a/self'/><link {r} href='{u}'/>{s}<updated>2026-11-03T09:00:00+03:00</updated></entry>"
    items = [entry.format(t="One", r="rel='alternate'", u="https://a/1", s="<summary type='html'>&lt;p&gt;A &amp;amp; b&lt;/p&gt;</summary><content>C</content>"), entry.format(t="Two", r="", u="https://a/2", s="<published>2026-11-02T06:30:00Z</published><content>C</content>"), entry.format(t="None", r="rel='edit'", u="https://a/3", s="")]
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><title>Feed</title><link href='https://a/'/>" + "".join(items) + "</feed>")
    got = [(r["pos"], r["title"], r["url"], r["snippet"], r["published"].isoformat()[:16]) for r in files.feed_items(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, "One", "https://a/1", "A & b", "2026-11-03T06:00"), (1, "Two", "https://a/2", "C", "2026-11-02T06:30")]
    assert [(r["items"], r["failed"]) for r in files.feed_report(spark, str(tmp_path)).collect()] == [(3, False)]


def test_gazetteer(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"towns": ["Nakuru", {"name": "Thika"}], "people": [{"name": "Jane Doe", "id": "jane", "aliases": ["JD"], "case_sensitive": True}], "other": 3}))
    got = sorted(map(tuple, files.gazetteer(spark, str(tmp_path / "g.json"), {"towns": "GPE", "people": "PERSON"}).collect()), key=str)
    assert got == [("GPE", "Nakuru", None, "Nakuru", False), ("GPE", "Thika", None, "Thika", False), ("PERSON", "Jane Doe", "jane", "JD", True), ("PERSON", "Jane Doe", "jane", "Jane Doe", True)]


def test_sheets(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'said "no", twice', None), (1, "two\nlines", "yes")], "id int, text string, mark string")
    files.write_sheet(rows, str(tmp_path / "s"), ["id"])
    assert [tuple(r) for r in files.read_sheet(spark, str(tmp_path / "s")).orderBy("item").collect()] == [("1", "1", "two\nlines", "yes"), ("2", "2", 'said "no", twice', "")]
    with pytest.raises(Exception, match="exists"):
        files.write_sheet(rows, str(tmp_path / "s"), ["id"])
    (tmp_path / "bom.csv").write_text("﻿item,mark\n1,x\n", encoding="utf-8")
    assert files.read_sheet(spark, str(tmp_path / "bom.csv")).columns == ["item", "mark"]


def test_benchmark_items(spark, tmp_path):
    line = {"sentence_normalized": "A met B", "targets": [{"Input.gid": "g1", "from": 0, "to": 1, "mention": "A", "polarity": "2.0"}, {"Input.gid": "g2", "from": 6, "to": 7, "mention": "B", "polarity": 6}]}
    (tmp_path / "b.jsonl").write_text(json.dumps(line) + "\n\n")
    got = files.benchmark_items(spark, str(tmp_path / "b.jsonl")).orderBy("id").collect()
    assert [(r["id"], r["start"], r["mention"], r["gold"], r["targets_in_sentence"]) for r in got] == [("g1", 0, "A", "neg", 2), ("g2", 6, "B", "pos", 2)]
    assert len(files.file_digest(spark, str(tmp_path / "b.jsonl")).first()["sha256"]) == 64


def test_run_log(spark, tmp_path):
    text = """noise
=== tier | 2026-10-01 06:00 ===
X: FEED FAILED (HTTP 403)
=== done in 12.5s (10.0s of it working)
model load 1.5s ingest 2s
corpus: ingest 99s
FAILURES:
  - people: broke
=== tier | 2026-10-01 08:00 ===
cut off
=== tier | 2026-10-01 10:00 ===
=== done in 3s
"""
    (tmp_path / "l.log").write_text(text)
    got = files.run_log(spark, str(tmp_path / "l.log"), r"=== tier \| (\S+ \S+) ===", ["model load", "ingest", "cluster"]).orderBy("started").collect()
    assert [(r["started"].hour, r["wall"], r["work"], r["stages"], r["feeds_failed"], r["failures"]) for r in got] == [(6, 12.5, 10.0, {"model load": 1.5, "ingest": 2.0}, ["X"], ["people: broke"]), (10, 3.0, None, {}, [], [])]


def test_score_cache(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"key": "a", "version": "1", "score": 0.5}\n{"key": "a", "version": "1", "score": 0.25}\n{"key": "b", "vers')
    assert [tuple(r) for r in files.read_scores(spark, str(tmp_path / "c.jsonl")).collect()] == [("a", "1", 0.25)]
    one = spark.range(1).select(files.score_key(F.lit("a"), F.lit(1)).alias("x"), files.score_key(F.lit("a1"), F.lit(None)).alias("y")).first()
    assert one["x"] != one["y"]


def test_search_index(spark, tmp_path):
    rows = [(1, "https://a", "t", "tag", "s", 5, [1.0, -2.0]), (2, "https://a", "t2", "tag", "s", 7, [0.0, 4.0]), (3, "https://b", "u", "tag", "s", None, [0.0, 0.0]), (4, None, "v", "own", "s", 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "article_id long, url string, title string, snippet string, source string, us long, embedding array<double>")
    got = files.search_index(df, str(tmp_path / "i")).orderBy("article_id").collect()
    assert [(r["article_id"], r["snippet"], r["codes"]) for r in got] == [(2, "", [0, 127]), (3, "", None)]
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2


def test_scores_written_and_read(spark, tmp_path):
    at = str(tmp_path / "scores")
    rows = spark.createDataFrame([("a", "v1", 0.5), ("b", "v1", None), (None, "v1", 1.0), ("c", None, -1.0)], "key string, version string, score double")
    files.write_scores(rows, at)
    files.write_scores(rows.where("key = 'a'").selectExpr("key", "'v2' version", "0.25 score"), at)
    with open(tmp_path / "scores" / "part-cut.txt", "w") as f:
        f.write('{"key": "d", "vers')
    assert sorted(map(str, map(tuple, files.read_scores(spark, at).collect()))) == ["('a', 'v1', 0.5)", "('a', 'v2', 0.25)", "('c', None, -1.0)"]


def test_sheet_too_large(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        files.write_sheet(spark.range(5), str(tmp_path / "sheet"), ["id"], most=4)


def test_batch_keeps_the_earliest_of_an_identifier(spark, tmp_path):
    import datetime

    from storyweft.streaming import ingest

    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("https://x/a", "One", day(3)), ("https://x/a", "One", day(2)), ("https://x/a", "One", None), ("https://x/b", "Two", None), ("nowhere", "Three", day(1))]
    batch = spark.createDataFrame(rows, "url string, title string, published timestamp")
    at = str(tmp_path / "articles")
    for _ in range(2):
        ingest.append_batch(at)(batch, 0)
    assert sorted((r.title, r.published) for r in spark.read.parquet(at).collect()) == [("One", day(2)), ("Two", None)]
