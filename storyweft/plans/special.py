"""Queries over operators that need more than expressions: vectors, groups, clusters, extraction, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..operators import clustering, comparison, density, extract, grouping, models, pages, people, stories, vectors
from ..operators.quotes import extract_quotes
from ..operators.snapshots import checkpoint_ready
from ..sources.tables import DUCK_PREFIX, run_sql, table
from ..streaming.ingest import rate_limit

QUERY = [1.0] + [0.0] * 63


def _emb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def story_list(s: SparkSession, d: str) -> DataFrame:
    m = run_sql(s, d, "SELECT cluster_id, article_id, source, title, category, us AS published FROM members")
    return stories.page(stories.stories(m)).select("cluster_id", "outlets", "article_count", F.array_join("sources", ",").alias("sources"), "latest", "latest_title")


def medoid_title(s: SparkSession, d: str) -> DataFrame:
    m = vectors.medoids(_emb(s, d), "label", "embedding", "vec_id")
    t = table(s, d, "documents").select(F.col("doc_id").alias("medoid"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    return m.join(t, "medoid", "left").select("label", "medoid", "title")


def nearest_stories(s: SparkSession, d: str) -> DataFrame:
    hits = vectors.nearest(_emb(s, d), "embedding", QUERY, 120)
    return hits.groupBy("label").agg(F.count("*").alias("matches"), F.round(F.min("distance"), 6).alias("best")).orderBy("best", "label").limit(10)


def collapsed(s: SparkSession, d: str) -> DataFrame:
    hits = _emb(s, d).select(F.col("vec_id").alias("article_id"), F.when(F.col("vec_id") % 3 > 0, F.col("label")).alias("cluster_id"), vectors.dot(F.col("embedding"), F.lit(QUERY)).alias("sim"))
    return vectors.collapse_hits(hits, floor=0.1).select("article_id", "cluster_id", F.round("sim", 6).alias("sim"))


def _stories(s: SparkSession, d: str) -> DataFrame:
    return _emb(s, d).select(F.col("label").cast("long").alias("story"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))


def weeks(s: SparkSession, d: str) -> DataFrame:
    """(window, id, vector, source): vectors in windows of seven days of event time, counted back from the newest (0); those without an event have no window."""
    e = _emb(s, d).join(table(s, d, "events").select(F.col("event_id").alias("vec_id"), "ts"), "vec_id").join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id", "left")
    newest = e.agg(F.max("ts").alias("newest"))
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("newest"))
    return e.crossJoin(F.broadcast(newest)).select(F.floor(age / (7 * 86_400_000_000)).cast("long").alias("window"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "source")


def windows(s: SparkSession, d: str) -> DataFrame:
    return density.cluster(weeks(s, d))


def kept_ids(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d)
    old = e.where("vec_id % 10 > 0").select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("article_id"))
    new = e.where("vec_id % 10 < 9").select((F.col("label") + 100).cast("long").alias("label"), F.col("vec_id").alias("article_id"))
    checkpoint_ready(s)
    return clustering.continuity(old, new)


def figure_rows(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", "text")
    return extract.table_function(rows, "text", extract.figures, "value double, unit string, state string, currency string, start long, end long", ["doc_id"])


def transcripts(s: SparkSession, d: str) -> DataFrame:
    """Conversations as articles, one paragraph a turn, in four forms by turn: attributed after the quote, before it, by pronoun, and not at all."""
    said = F.concat(F.lit("“"), F.translate("text", '"“”‘’', ""), F.lit("”"))
    name = F.when(F.col("role") == "user", F.lit("Jane Wanjiku")).otherwise("Peter Otieno")
    form = F.col("turn") % 4
    line = F.when(form == 0, F.concat(said, F.lit(", said "), name, F.lit("."))).when(form == 1, F.concat(name, F.lit(" said: "), said)).when(form == 2, F.concat(F.lit("He added: "), said)).otherwise(said)
    turns = table(s, d, "conversations").where("text is not null and conv_id is not null").select("conv_id", F.struct("turn", line.alias("line")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "\n").alias("text"))


def quote_rows(s: SparkSession, d: str) -> DataFrame:
    return extract.table_function(transcripts(s, d), "text", extract_quotes, "quote string, speaker string, how string, language string, start long", ["conv_id"]).select("conv_id", "quote", "speaker", "how")


def story_quotes(s: SparkSession, d: str) -> DataFrame:
    """Remarks of stories of seven conversations, each by one of five outlets, from the quotes in their transcripts."""
    found = extract.table_function(transcripts(s, d), "text", extract_quotes, "quote string, speaker string, how string, language string, start long", ["conv_id"])
    vector = models.column(models.embed, ArrayType(DoubleType()))(F.col("quote"))
    rows = found.select(F.floor(F.col("conv_id") / 7).cast("long").alias("story"), (F.col("conv_id") * 1_000_000 + F.col("start")).alias("pos"), F.concat(F.lit("o"), (F.col("conv_id") % 5).cast("string")).alias("source"), "speaker", F.col("quote").alias("wording"), F.col("language").alias("lang"), vector.alias("vector"))
    return people.remarks(rows).select("story", "remark", "pos", "version", "outlets", "relation")


def limited(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"))
    return rate_limit(e, ["user_id"], "us", "event_id", most=2, window=86_400.0).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


def covered(s: SparkSession, d: str) -> DataFrame:
    m = run_sql(s, d, "SELECT cluster_id AS story, source, article_id, category FROM members")
    claims = m.select("story", F.col("category").alias("grp"), "source", (F.col("article_id") % 3 > 0).alias("same"))
    outlets = m.groupBy("story", "source").agg(F.bool_or(F.col("article_id") % 2 == 0).alias("readable"))
    out = comparison.coverage(claims, outlets)
    return out.select("story", "grp", *[F.array_join(c, ",").alias(c) for c in ("reported_by", "related", "omitted_by")])


QUERIES = {
    "story_list": story_list,
    "cluster_centroid": lambda s, d: vectors.centroids(_emb(s, d), "label", "embedding").select("label", "n", F.posexplode("centroid").alias("pos", "m")).select("label", "n", "pos", F.round("m", 6).alias("m")),
    "cluster_coherence": lambda s, d: vectors.coherence(_emb(s, d), "label", "embedding").select("label", "n", F.round("coherence", 6).alias("coherence")),
    "nearest_articles": lambda s, d: vectors.nearest(_emb(s, d), "embedding", QUERY, 20).select("vec_id", F.round("distance", 6).alias("distance")),
    "search_post_limit_cut": lambda s, d: vectors.nearest(_emb(s, d), "embedding", QUERY, 20, 0.75).select("vec_id", F.round("distance", 6).alias("distance")),
    "nearest_stories": nearest_stories,
    "medoid_title": medoid_title,
    "quantize_int8": lambda s, d: _emb(s, d).select("vec_id", vectors.quantise(F.col("embedding")).alias("q")).select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.codes", F.lit(0), lambda a, x: a + F.abs(x)).alias("mass")),
    "pairwise_similar_claims": lambda s, d: vectors.similar_pairs(_emb(s, d), 0.35, group="label").select("a", "b", F.round("sim", 6).alias("sim")),
    "nn_separation": lambda s, d: vectors.separation(_emb(s, d)).select("id", F.round("first", 6).alias("first"), F.round("second", 6).alias("second")),
    "collapse_hits_per_story": collapsed,
    "coverage_groups": covered,
    "leader_groups": lambda s, d: grouping.leader_groups(_stories(s, d), 0.3),
    "complete_linkage_partitions": lambda s, d: grouping.linkage_partitions(_stories(s, d), 0.2),
    "speaker_components": lambda s, d: grouping.speaker_components(_stories(s, d).withColumn("speaker", F.concat(F.lit("s"), (F.col("pos") % 40).cast("string"))).withColumn("source", F.concat(F.lit("o"), (F.col("pos") % 5).cast("string"))), 0.4),
    "hdbscan_window": windows,
    "continuity_greedy": kept_ids,
    "html_to_text": lambda s, d: table(s, d, "pages").select("page_id", T.html_body(F.col("html")).alias("body")),
    "page_main_text": lambda s, d: table(s, d, "pages").select("page_id", pages.main_texts(F.col("html")).alias("body")),
    "figure_parse": figure_rows,
    "quote_extract": quote_rows,
    "story_quotes": story_quotes,
    "claim_extract": lambda s, d: extract.table_function(table(s, d, "documents").select("doc_id", "text"), "text", extract.claims, "pos long, claim string, context string", ["doc_id"]),
    "tone_model": lambda s, d: table(s, d, "documents").select("doc_id", models.tone_of(F.col("text")).alias("tone")),
    "rate_limit_sliding": limited,
}

_DIST = f"(SELECT vec_id, label, 1 - list_inner_product(CAST(embedding AS DOUBLE[]), {QUERY}) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS distance FROM embeddings)"
_CENT = "cells AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings), cent AS (SELECT label, pos, count(*) AS n, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY label, pos)"
_SIM = "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
_APART = "far AS (SELECT a.vec_id AS id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a LEFT JOIN embeddings b ON a.vec_id <> b.vec_id), sep AS (SELECT id, list_sort(list(d))[1] AS first, list_sort(list(d))[2] AS second FROM far GROUP BY id)"
ORACLES = {
    "story_list": DUCK_PREFIX + "SELECT s.cluster_id, s.outlets, s.article_count, x.sources, s.latest, s.latest_title FROM stories s JOIN (SELECT cluster_id, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT cluster_id, source FROM members) y GROUP BY cluster_id) x ON x.cluster_id = s.cluster_id WHERE outlets >= 2 ORDER BY outlets DESC, article_count DESC, s.cluster_id LIMIT 20",
    "cluster_centroid": f"WITH {_CENT} SELECT label, n, CAST(pos AS INTEGER) AS pos, round(m, 6) AS m FROM cent",
    "cluster_coherence": f"WITH {_SIM} SELECT label, n, round(c, 6) AS coherence FROM (SELECT la AS label, avg(sim) AS c FROM pairs WHERE la = lb GROUP BY la) p JOIN (SELECT label AS l2, count(*) AS n FROM embeddings GROUP BY label) k ON l2 = label",
    "nearest_articles": f"SELECT vec_id, round(distance, 6) AS distance FROM {_DIST} ORDER BY distance, vec_id LIMIT 20",
    "search_post_limit_cut": f"SELECT vec_id, round(distance, 6) AS distance FROM (SELECT * FROM {_DIST} ORDER BY distance, vec_id LIMIT 20) WHERE distance <= 0.75",
    "nearest_stories": f"SELECT label, count(*) AS matches, round(min(distance), 6) AS best FROM (SELECT * FROM {_DIST} ORDER BY distance, vec_id LIMIT 120) GROUP BY label ORDER BY best, label LIMIT 10",
    "medoid_title": f"WITH {_CENT}, s AS (SELECT c.label, e.vec_id, sum(CAST(e.embedding[c.pos + 1] AS DOUBLE) * c.m) AS sim FROM embeddings e JOIN cent c ON c.label = e.label GROUP BY c.label, e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS rn FROM s) SELECT label, vec_id AS medoid, trim(split_part(text, chr(10), 1)) AS title FROM r LEFT JOIN documents ON doc_id = vec_id WHERE rn = 1",
    "quantize_int8": "WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127 AS scale FROM embeddings) SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(list_transform(embedding, lambda x: abs(CAST(round_even(CAST(x AS DOUBLE) / scale, 0) AS INTEGER)))) AS INTEGER) AS mass FROM s",
    "pairwise_similar_claims": f"WITH {_SIM} SELECT a, b, round(sim, 6) AS sim FROM pairs WHERE la = lb AND sim >= 0.35",
    "quote_extract": r"""WITH q AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Jane Wanjiku' ELSE 'Peter Otieno' END AS name, turn % 4 AS form, trim(translate(text, '"“”‘’', ''), ' ' || chr(10) || chr(9) || chr(13)) AS q FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL),
w AS (SELECT *, regexp_extract_all(q, '[A-Za-z][A-Za-z''-]*') AS x FROM q),
s AS (SELECT *, lag(name, 1) OVER o AS n1, lag(name, 2) OVER o AS n2 FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, left(q, 400) AS quote, CASE form WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN n1 ELSE n2 END AS speaker, ['named', 'named', 'pronoun', 'continued'][form + 1] AS how
FROM s WHERE len(regexp_split_to_array(q, '\s+')) >= 4 AND NOT (len(x) <= 8 AND len(list_filter(x, lambda y: length(y) > 3)) >= 2 AND len(list_filter(x, lambda y: length(y) > 3 AND NOT regexp_matches(y, '^[A-Z]'))) = 0)""",
    "page_main_text": r"""WITH a AS (SELECT page_id, replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(p|h1|br)>', chr(1), 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS t FROM pages),
l AS (SELECT page_id, unnest(string_split(t, chr(1))) AS x, unnest(range(0, len(string_split(t, chr(1))))) AS i FROM a)
SELECT page_id, coalesce(string_agg(trim(regexp_replace(x, '\s+', ' ', 'g')), chr(10) ORDER BY i) FILTER (WHERE trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''), '') AS body FROM l GROUP BY page_id""",
    "nn_separation": f"WITH {_APART} SELECT id, round(first, 6) AS first, round(second, 6) AS second FROM sep",
    "coverage_groups": DUCK_PREFIX + ", o AS (SELECT cluster_id AS story, source, bool_or(article_id % 2 = 0) AS readable FROM members GROUP BY 1, 2), g AS (SELECT cluster_id AS story, category AS grp, source, bool_or(article_id % 3 > 0) AS same FROM members GROUP BY 1, 2, 3), k AS (SELECT DISTINCT story, grp FROM g), t AS (SELECT k.story, k.grp, s.source, CASE WHEN g.same THEN 'r' WHEN g.source IS NOT NULL THEN 'm' WHEN s.readable THEN 'o' END AS kind FROM k JOIN o s ON s.story = k.story LEFT JOIN g ON g.story = k.story AND g.grp = k.grp AND g.source = s.source) SELECT story, grp, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE kind = 'r'), '') AS reported_by, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE kind = 'm'), '') AS related, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE kind = 'o'), '') AS omitted_by FROM t GROUP BY story, grp",
}
