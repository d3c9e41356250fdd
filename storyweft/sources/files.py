"""File sources and sinks: feeds, gazetteers, label sheets, benchmark items, run logs, score caches, the search index. All are read by Spark, so any store that it reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import clean_text, identifier, is_web_url, strip_markup
from ..operators.vectors import quantise

#: Items that are taken of a feed, from its top.
PER_FEED = 25
_RSS = "title string, link string, description string, pubDate string"
_ATOM = "title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string"
_SHEET_ORDER = "item"


def feed_items(spark: SparkSession, path: str, most: int = PER_FEED) -> DataFrame:
    """RSS and Atom documents under `path` -> (feed, pos, title, url, snippet, published, identifier), the first `most` items of each.

    `feed` is the file's path. An item without a title or a web link is no row but counts towards `most`. A broken
    document gives no rows; see `feed_report`. A date that can't be read is null.
    Of an Atom entry, the first alternate link counts, the summary before the content, and the time of publishing before that of the last change.
    """
    rows = _channels(spark, path).select("feed", F.posexplode("items").alias("pos", "item")).where(F.col("pos") < most)
    title, url = clean_text(F.col("item.title")), clean_text(F.col("item.link"))
    zone = F.regexp_replace(F.regexp_replace(F.trim(F.col("item.pubDate")), r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|Z)$", " +0000")
    out = rows.select("feed", "pos", title.alias("title"), url.alias("url"), strip_markup(F.col("item.description")).alias("snippet"), F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(F.col("item.pubDate")))).alias("published"))
    return out.where((F.col("title") != "") & is_web_url(F.col("url"))).withColumn("identifier", identifier(F.col("url"), F.col("title")))


def feed_report(spark: SparkSession, path: str) -> DataFrame:
    """(feed, items, failed): a feed without a single item has failed, and is reported rather than raised."""
    n = F.size(F.coalesce("items", F.array()))
    return _channels(spark, path).select("feed", n.alias("items"), (n == 0).alias("failed"))


def _channels(spark: SparkSession, path: str) -> DataFrame:
    schema = f"channel struct<item: array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _RSS.split(', '))}>>>, entry array<struct<{_ATOM}>>"
    # A document is one value: feeds are small, and a broken one must not take others with it.
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("feed"), "value")
    read = whole.select("feed", F.from_xml("value", schema, {"mode": "PERMISSIVE"}).alias("x"))
    return read.select("feed", F.coalesce("x.channel.item", F.transform("x.entry", _entry)).alias("items"))


def _entry(e: Column) -> Column:
    """An Atom entry in the shape of an RSS item."""
    page = F.try_element_at(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"]
    return F.struct(e["title"].alias("title"), page.alias("link"), F.coalesce(e["summary"], e["content"]).alias("description"), F.coalesce(e["published"], e["updated"]).alias("pubDate"))


def gazetteer(spark: SparkSession, path: str, sections: dict[str, str]) -> DataFrame:
    """A JSON object of lists, `sections` naming the label of each -> (label, name, id, surface), one row per surface.

    An entry is a bare name or a record with name and, where it has them, id, aliases and case_sensitive.
    """
    entry = "name string, id string, aliases array<string>, case_sensitive boolean"
    text = spark.read.text(path, wholetext=True)
    out = None
    for section, label in sections.items():
        # Entries are read as variants, since a list may hold both forms.
        one = text.select(F.explode(F.from_json("value", f"`{section}` array<variant>")[section]).alias("v"))
        bare = F.try_variant_get("v", "$", "string")
        record = F.from_json(F.to_json("v"), entry)
        is_record = F.schema_of_variant("v").startswith("OBJECT")
        name = F.when(is_record, record["name"]).otherwise(bare)
        names = F.array_distinct(F.concat(F.array(name), F.coalesce(F.when(is_record, record["aliases"]), F.array().cast("array<string>"))))
        rows = one.select(F.lit(label).alias("label"), name.alias("name"), F.when(is_record, record["id"]).alias("id"), F.explode(names).alias("surface"), F.coalesce(F.when(is_record, record["case_sensitive"]), F.lit(False)).alias("case_sensitive"))
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.trim("surface") != "")


def write_sheet(rows: DataFrame, path: str, order: list[str], most: int = 10_000) -> None:
    """A label sheet as CSV with a header and a running `item`. It never overwrites: a sheet may hold labels. People fill sheets, so one task numbers their rows, `most` at most; more are refused."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a sheet has {most} rows at most")
    numbered = rows.withColumn(_SHEET_ORDER, F.row_number().over(Window.orderBy(*order)))
    numbered.select(_SHEET_ORDER, *rows.columns).coalesce(1).write.mode("errorifexists").csv(path, header=True, escape='"')


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Strings as they stand, blank cells empty; a byte-order mark is no part of the first name."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).fillna("")


def benchmark_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of sentences with targets -> one row per target: id, text, start, end, mention, gold, targets_in_sentence."""
    target = "array<struct<`Input.gid`: string, `from`: long, `to`: long, mention: string, polarity: string>>"
    rows = spark.read.schema(f"sentence_normalized string, targets {target}").json(path)
    item = rows.select(F.col("sentence_normalized").alias("text"), F.size("targets").alias("targets_in_sentence"), F.explode("targets").alias("t"))
    polarity = F.col("t.polarity").try_cast("double")
    # Polarity 2 is negative, 4 neutral, 6 positive.
    gold = F.when(polarity == 2, "neg").when(polarity == 4, "neu").when(polarity == 6, "pos")
    return item.select(F.col("t").getField("Input.gid").alias("id"), "text", F.col("t.from").alias("start"), F.col("t.to").alias("end"), F.col("t.mention").alias("mention"), gold.alias("gold"), "targets_in_sentence")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


# The words of a run log.
_DONE, _CORPUS, _FAILURES, _FEED, _ITEM = r"^=== done in ([\d.]+)s(?: \(([\d.]+)s of it working\))?", "corpus:", "FAILURES:", r"^(.+?): FEED FAILED \(.+?\)", r"^  - (.+)$"


def run_log(spark: SparkSession, path: str, header: str, stages: list[str]) -> DataFrame:
    """Runs of a log -> started, wall, work, stages (map of seconds), feeds_failed, failures.

    `header` is a regular expression that opens a run and captures when it began. Every line belongs to the run opened
    last before it, and is of one kind; what a run has is gathered from its lines. A run that never was done is no row.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    order = Window.partitionBy("file").orderBy("at")
    lines = lines.withColumn("run", F.sum(F.col("line").rlike(header).cast("int")).over(order)).where("run > 0")
    so_far = Window.partitionBy("file", "run").orderBy("at")
    ever = lambda c: F.max(c.cast("int")).over(so_far) == 1
    done = F.col("line").rlike(_DONE)
    lines = lines.withColumns({"after": ever(done), "listed": ever(F.col("line").startswith(_FAILURES)), "corpus": ever(F.col("line").contains(_CORPUS))})
    timed = F.when(F.col("after") & ~F.col("corpus"), F.regexp_extract_all("line", F.lit("(?:" + "|".join(stages) + r") [\d.]+s"), F.lit(0)))
    pick = lambda when, pattern: F.array_compact(F.array_agg(F.struct("at", F.when(when & F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)).alias("x")))).alias("_")
    texts = lambda when, pattern: F.transform(F.filter(F.array_sort(pick(when, pattern)), lambda e: e["x"].isNotNull()), lambda e: e["x"])
    runs = lines.groupBy("file", "run").agg(
        F.min(F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1))).alias("began"),
        F.min_by(F.when(done, F.regexp_extract("line", _DONE, 1)), F.when(done, F.col("at"))).alias("wall"),
        F.min_by(F.when(done, F.regexp_extract("line", _DONE, 2)), F.when(done, F.col("at"))).alias("work"),
        F.flatten(F.collect_list(timed)).alias("timed"),
        texts(F.lit(True), _FEED).alias("feeds_failed"),
        texts(F.col("listed"), _ITEM).alias("failures"),
    )
    seconds = F.map_from_entries(F.transform("timed", lambda x: F.struct(F.regexp_extract(x, r"^(.*) [\d.]+s$", 1).alias("key"), F.regexp_extract(x, r"([\d.]+)s$", 1).try_cast("double").alias("value"))))
    return runs.where("wall is not null").select(F.try_to_timestamp("began", F.lit("yyyy-MM-dd HH:mm")).alias("started"), F.col("wall").try_cast("double").alias("wall"), F.col("work").try_cast("double").alias("work"), seconds.alias("stages"), "feeds_failed", "failures")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score cache of JSON lines (key, version, score); a line that was cut off is left out, the last of a key and version holds."""
    rows = spark.read.text(path).select(F.from_json("value", "key string, version string, score double").alias("r"), F.monotonically_increasing_id().alias("at"))
    return rows.where("r.key is not null and r.score is not null").groupBy("r.key", "r.version").agg(F.max_by("r.score", "at").alias("score"))


def write_scores(rows: DataFrame, path: str) -> None:
    """Adds rows (key, version, score) to a score cache, as read_scores reads it; rows without a key or score are left out."""
    rows.where("key is not null and score is not null").select(F.to_json(F.struct("key", "version", F.col("score").cast("double").alias("score"))).alias("value")).write.mode("append").text(path)


def score_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\u001f", *[F.coalesce(p.cast(T.StringType()), F.lit("")) for p in parts]))


def search_index(articles: DataFrame, path: str | None = None, repeats: int = 3) -> DataFrame:
    """articles (article_id, url, title, snippet, source, us, embedding) -> one row per url, the newest, with int8 codes; a snippet that stands `repeats` times or more is a tagline, and blank. Written to `path` if given."""
    newest = articles.where(F.col("url").isNotNull() & F.col("embedding").isNotNull()).groupBy("url").agg(F.max_by(F.struct(*[c for c in articles.columns if c != "url"]), F.struct("us", -F.col("article_id"))).alias("r")).select("url", "r.*")
    tagline = articles.groupBy("snippet").count().where(F.col("count") >= repeats).select(F.col("snippet").alias("_tag"))
    codes = quantise(F.col("embedding"))
    out = newest.join(tagline, F.col("snippet") == F.col("_tag"), "left").select("article_id", "url", "title", "source", "us", F.when(F.col("_tag").isNull(), F.col("snippet")).otherwise("").alias("snippet"), codes["codes"].alias("codes"), codes["scale"].alias("scale"))
    if path:
        out.write.mode("overwrite").parquet(path)
    return out
