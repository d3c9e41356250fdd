"""The driver's tables, and the article model over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Articles are documents with the event of their id as time, the vector of their id, and the page of their id as link.
ARTICLES = """
articles AS (
  SELECT d.doc_id AS article_id, d.source AS source, trim(split_part(d.text, chr(10), 1)) AS title, substr(d.text, 1, 150) AS snippet, d.text AS text,
    d.lang AS category, {us} AS us, e.label AS cluster_id, e.embedding AS embedding, p.url AS url
  FROM documents d LEFT JOIN events v ON v.event_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id),
members AS (SELECT cluster_id, article_id, source, title, category, us FROM articles WHERE cluster_id IS NOT NULL),
stories AS (
  SELECT cluster_id, count(DISTINCT source) AS outlets, count(*) AS article_count, max(us) AS latest, max_by(title, struct_key) AS latest_title, bool_or(source = 'src0') AS has_src0, max(category) AS topic
  FROM (SELECT *, lpad(CAST(us AS STRING), 20, '0') || lpad(CAST(article_id AS STRING), 12, '0') AS struct_key FROM members) m GROUP BY cluster_id)
"""
DUCK_PREFIX = "WITH " + ARTICLES.format(us="epoch_us(v.ts)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(text: str, *words: str) -> bool:
    return re.search(r"\b(?:" + "|".join(words) + r")\b", text) is not None


def model(body: str) -> str:
    """The model's tables that a query names, with the columns it names, and no more joins than those need."""
    timed, linked = _named(body, "us", "stories"), _named(body, "url")
    grouped = _named(body, "cluster_id", "embedding", "members", "stories")
    columns = ["d.doc_id AS article_id", "d.source AS source", "trim(split_part(d.text, chr(10), 1)) AS title", "substr(d.text, 1, 150) AS snippet", "d.text AS text", "d.lang AS category"]
    joins = ""
    if timed:
        columns.append("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', v.ts) AS us")
        joins += " LEFT JOIN events v ON v.event_id = d.doc_id"
    if grouped:
        columns += ["e.label AS cluster_id", "e.embedding AS embedding"]
        joins += " LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
    if linked:
        columns.append("p.url AS url")
        joins += " LEFT JOIN pages p ON p.page_id = d.doc_id"
    parts = []
    if _named(body, "articles", "members", "stories"):
        parts.append(f"articles AS (SELECT {', '.join(columns)} FROM documents d{joins})")
    if _named(body, "members", "stories"):
        parts.append(f"members AS (SELECT cluster_id, article_id, source, title, category{', us' if timed else ''} FROM articles WHERE cluster_id IS NOT NULL)")
    if _named(body, "stories"):
        parts.append(ARTICLES[ARTICLES.index("stories AS (") :].strip())
    return ", ".join(parts)


def run_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A query over the model; the tables it names are read where they are, and the session keeps no views."""
    held = model(body)
    used = f"{held} {body}"
    files = ", ".join(f"{name} AS (SELECT * FROM parquet.`{sf_dir}/{name}.parquet`)" for name in TABLES if _named(used, name))
    parts = [x for x in (files, held, body.removeprefix("WITH ") if body.startswith("WITH ") else "") if x]
    text = "WITH " + ", ".join(parts) if parts else ""
    return spark.sql(text if body.startswith("WITH ") else f"{text} {body}")


def duck_sql(body: str) -> str:
    return f"{DUCK_PREFIX}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else DUCK_PREFIX + body
