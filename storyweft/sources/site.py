"""A set of pages as a Spark sink: `df.write.format("site").mode("append").save(path)` puts all of them there at once, or none.

Tasks write to a folder of their own attempt; the commit lists what the successful ones wrote in a manifest and then puts
the pointer file in place. A lost task leaves files that no manifest names.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

POINTER, MANIFEST = "current.json", "manifest.json"


@dataclass
class _Written(WriterCommitMessage):
    pages: list


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _put(files: fs.FileSystem, at: str, data: bytes) -> None:
    """Whole or not at all: written beside, then moved."""
    files.create_dir(posixpath.dirname(at), recursive=True)
    beside = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as out:
        out.write(data)
    files.move(beside, at)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _open(self.path)
        attempt, pages = uuid.uuid4().hex, []
        for row in iterator:
            name = posixpath.normpath(row["path"] or "")
            if name.startswith(("..", "/")) or name == ".":
                raise ValueError(f"no page can be at {row['path']!r}")
            at = f"versions/{self.run}/{attempt}/{name}"
            data = (row["html"] or "").encode()
            _put(files, f"{root}/{at}", data)
            pages.append((name, at, len(data)))
        return _Written(pages)

    def commit(self, messages: list) -> None:
        files, root = _open(self.path)
        pages = [p for m in messages if m is not None for p in m.pages]
        named: dict[str, tuple[str, int]] = {}
        for name, at, size in pages:
            if name in named:
                self.abort(messages)
                raise ValueError(f"two pages are named {name}")
            named[name] = (at, size)
        _put(files, f"{root}/versions/{self.run}/{MANIFEST}", json.dumps(named, sort_keys=True).encode())
        _put(files, f"{root}/{POINTER}", json.dumps({"run": self.run}).encode())

    def abort(self, messages: list) -> None:
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/versions/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/versions/{self.run}")


class Site(DataSource):
    """Rows (path string, html string); a path twice, or outside the site, fails the write and leaves the site as it is."""

    @classmethod
    def name(cls) -> str:
        return "site"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"path", "html"} <= set(schema.fieldNames()):
            raise ValueError("a site is written from path and html")
        return _Writer(self.options["path"], uuid.uuid4().hex)


def built(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, size) of the pages that are in place; none before the first commit. The manifest is read by Spark."""
    files, root = _open(path)
    kind = "path string, at string, size long"
    if files.get_file_info(f"{root}/{POINTER}").type == fs.FileType.NotFound:
        return spark.createDataFrame([], kind)
    with files.open_input_stream(f"{root}/{POINTER}") as f:
        run = json.loads(f.read())["run"]
    text = spark.read.text(f"{path}/versions/{run}/{MANIFEST}", wholetext=True)
    entries = F.from_json("value", "map<string, array<string>>")
    return text.select(F.explode(entries).alias("path", "x")).select("path", F.concat(F.lit(path.rstrip("/") + "/"), F.element_at("x", 1)).alias("at"), F.element_at("x", 2).cast("long").alias("size"))


def checked(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(path, problem) of what is wrong with the pages in place, against expected(path): missing, unexpected, or a link to a page that isn't there."""
    have = built(spark, path)
    missing = expected.select("path").distinct().join(have, "path", "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.select("path").join(expected, "path", "left_anti").withColumn("problem", F.lit("unexpected"))
    if not have.head(1):
        return missing
    text = spark.read.text([r.at for r in have.select("at").collect()], wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    links = text.select("file", F.explode(F.regexp_extract_all("value", F.lit('href="([^"#:?]+)[^":]*"'), F.lit(1))).alias("to"))
    ends = F.regexp_extract("file", "versions/[^/]+/[^/]+/(.*)$", 1)
    loose = links.select(ends.alias("path"), "to").join(have.select(F.col("path").alias("to")), "to", "left_anti").select("path", F.concat(F.lit("no page "), "to").alias("problem"))
    return missing.unionByName(extra).unionByName(loose.distinct())


def story_pages(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """(path, html): a page of each story(story, title, outlets) with its articles(story, title, source, url, published), an index of all in order of outlets, and the bundle of both as JSON."""
    from ..functions.text import escape_html, web_link

    own = stories.withColumn("path", F.concat(F.lit("story-"), F.col("story").cast("string"), F.lit(".html")))
    item = F.concat(F.lit('<li><a href="'), web_link(F.col("url")), F.lit('">'), escape_html(F.col("title")), F.lit("</a> "), escape_html(F.col("source")), F.lit("</li>"))
    listed = articles.groupBy("story").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("published", "url", item.alias("item")))), lambda x: x["item"]), "\n").alias("items"))
    page = F.concat(F.lit("<!DOCTYPE html><title>"), escape_html(F.col("title")), F.lit('</title><a href="index.html">All stories</a><h1>'), escape_html(F.col("title")), F.lit("</h1><ul>"), F.coalesce("items", F.lit("")), F.lit("</ul>"))
    pages = own.join(listed, "story", "left").select("path", page.alias("html"))
    line = F.concat(F.lit('<li><a href="'), "path", F.lit('">'), escape_html(F.col("title")), F.lit("</a> "), F.col("outlets").cast("string"), F.lit("</li>"))
    # An index is a page: as long as there are stories to show on it.
    index = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("outlets")).alias("k"), "story", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    front = index.select(F.lit("index.html").alias("path"), F.concat(F.lit("<!DOCTYPE html><title>Stories</title><ul>"), "lines", F.lit("</ul>")).alias("html"))
    bundle = own.agg(F.to_json(F.array_sort(F.collect_list(F.struct("story", "title", "outlets", "path")))).alias("html")).select(F.lit("bundle.json").alias("path"), "html")
    return pages.unionByName(front).unionByName(bundle)
