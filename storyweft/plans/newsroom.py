"""Queries over subjects, the persisted index, the site and benchmark runs. The SQL is written apart from the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import people, subjects, vector_index, vectors
from ..operators.snapshots import shared_dir
from ..sources import site
from ..sources.tables import DUCK_PREFIX, run_sql, table
from .special import _CENT, _SIM, covered, transcripts


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _claims(s: SparkSession, d: str) -> DataFrame:
    """Lines with a digit, or a number word, of whole texts of stories as claims."""
    lines = run_sql(s, d, "SELECT cluster_id AS story, article_id, source, text FROM articles WHERE cluster_id IS NOT NULL").select("story", "article_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(F.col("text").rlike(r"\d|(?i)\b(two|three|four|five|six|seven|eight|nine|ten|dozen)\b")).select(F.col("story").cast("long").alias("story"), (F.col("article_id") * 1_000_000 + F.col("line")).cast("long").alias("pos"), "source", "text")


def figure_links(s: SparkSession, d: str) -> DataFrame:
    return subjects.linked(subjects.figure_subjects(_claims(s, d)))


def story_subject(s: SparkSession, d: str) -> DataFrame:
    return subjects.story_subjects(run_sql(s, d, "SELECT cluster_id AS story, article_id AS pos, title FROM members"))


def _indexed(s: SparkSession, d: str, probes: int) -> tuple[DataFrame, DataFrame]:
    e, at = table(s, d, "embeddings"), _place(s, "index")
    vector_index.build(e, at)
    return vector_index.search(s, at, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k=10, probes=probes)


def index_search(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest of every row whose id 100 divides, from the nearest lists, with how much of the table was read for it."""
    hits, read = _indexed(s, d, 10)
    return hits.join(read, "query_id").select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "lists", "scanned")


def index_exact(s: SparkSession, d: str) -> DataFrame:
    """The same from all lists: exact."""
    return _indexed(s, d, vector_index.MOST_LISTS)[0].select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def _stories(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = run_sql(s, d, "SELECT cluster_id AS story, latest_title AS title, outlets FROM stories")
    articles = run_sql(s, d, "SELECT cluster_id AS story, title, source, url, us AS published FROM articles WHERE cluster_id IS NOT NULL")
    return found, articles


def site_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of all stories, built into a site and read from there: how large they are, and what is wrong with them."""
    s.dataSource.register(site.Site)
    at = _place(s, "site")
    pages = site.story_pages(*_stories(s, d))
    pages.write.format("site").mode("append").save(at)
    wrong = site.checked(s, at, pages.select("path")).groupBy("path").agg(F.count("*").alias("problems"))
    return site.built(s, at).join(wrong, "path", "left").select("path", "size", F.coalesce("problems", F.lit(0)).cast("long").alias("problems"))


def centroid_order(s: SparkSession, d: str) -> DataFrame:
    """Articles of each story by similarity to its centroid, rounded to three places, then by id."""
    e = table(s, d, "embeddings").select("label", "vec_id", "embedding")
    centre = vectors.centroids(e, "label", "embedding").select("label", "centroid")
    norm = lambda c: F.sqrt(vectors.dot(F.col(c), F.col(c)))
    near = e.join(centre, "label").withColumn("score", F.round(vectors.dot(F.col("embedding"), F.col("centroid")) / norm("centroid"), 3))
    # A story's articles, without their vectors, are what a page shows in order.
    listed = near.groupBy("label").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "vec_id"))).alias("x"))
    return listed.select("label", F.posexplode("x").alias("place", "x")).select("label", "place", "x.vec_id", (-F.col("x.k")).alias("score"))


def coherence_bins(s: SparkSession, d: str) -> DataFrame:
    """Stories by coherence in thirty bins of -1 to 1, and how many of each bin are below the floor."""
    c = vectors.coherence(table(s, d, "embeddings"), "label", "embedding").withColumn("c", F.round("coherence", 6))
    bin_ = F.least(F.lit(29), F.floor((F.col("c") + 1) * 15)).cast("int")
    return c.groupBy(bin_.alias("bin")).agg(F.count("*").alias("stories"), F.count_if(F.col("c") < 0.5).alias("below"))


def portrayal_from_text(s: SparkSession, d: str) -> DataFrame:
    """How outlets present the people named in transcripts: five outlets by conversation, two listed people."""
    articles = transcripts(s, d).select(F.col("conv_id").alias("article"), F.concat(F.lit("o"), (F.col("conv_id") % 5).cast("string")).alias("outlet"), "text")
    listed = s.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("surface"), F.lit(i).alias("id")) for n, i in (("Jane Wanjiku", "wanjiku"), ("Peter Otieno", "otieno"))])).alias("x")).select("x.*", F.lit("PERSON").alias("label"), F.lit(False).alias("case_sensitive"))
    out = people.portrayal_of(people.person_mentions(articles, listed, listed_only=True))
    return out.select("person", "outlet", "articles", "mentions", "speaks", "acted_on", "described", "mentioned", F.size("examples").alias("examples"))


def gaps(s: SparkSession, d: str) -> DataFrame:
    """By story: groups of claims that some outlet it has read omits or only relates, of all its groups."""
    some = (F.col("related") != "") | (F.col("omitted_by") != "")
    return covered(s, d).groupBy(F.col("story").alias("cluster_id")).agg(F.count_if(some).alias("gaps"), F.count("*").alias("groups"))


def _titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"), "text", "source")


def _words(s: SparkSession, d: str) -> DataFrame:
    return _titles(s, d).select(F.explode(T.word_tokens(F.col("text"))).alias("word")).distinct()


QUERIES = {
    "outlet_initials": lambda s, d: _titles(s, d).where("source is not null").select("source").distinct().select("source", T.initials(F.concat(F.lit("The "), "source", F.lit(" daily news"))).alias("initials")),
    "page_site": lambda s, d: table(s, d, "pages").select("page_id", T.site(F.col("url")).alias("site")),
    "trimmed_text": lambda s, d: _titles(s, d).where("text is not null").select("doc_id", T.trim_to(F.col("text"), 150).alias("short")),
    "word_singulars": lambda s, d: _words(s, d).select("word", T.singular(F.col("word")).alias("singular")),
    "verb_present": lambda s, d: _words(s, d).where(F.length("word") > 2).select("word", T.headline_tense(F.col("word")).alias("present")),
    "seven_point_marks": lambda s, d: table(s, d, "labels").where("doc_id is not null").select("doc_id", T.seven_point(F.when(F.col("doc_id") % 9 == 0, " X ").when(F.col("doc_id") % 9 == 1, "").when(F.col("doc_id") % 9 == 2, "maybe").otherwise((F.col("doc_id") % 9 - 5).cast("string"))).alias("marked")),
    "vector_text": lambda s, d: table(s, d, "embeddings").select("vec_id", T.parse_vector(T.format_vector(F.col("embedding"))).alias("v")).select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total")),
    "spelled_names": lambda s, d: _titles(s, d).where("source is not null").select("source").distinct().select("source", F.array_join(T.spellings(F.concat("source", F.lit("'s"))), "|").alias("spellings")),
    "quoted_things": lambda s, d: _titles(s, d).select("doc_id", T.names_a_thing(F.col("title")).alias("thing")),
    "gap_count": gaps,
    "portrayal_from_text": portrayal_from_text,
    "centroid_order_rounded": centroid_order,
    "coherence_histogram": coherence_bins,
    "figure_links": figure_links,
    "story_subject": story_subject,
    "vector_index_search": index_search,
    "vector_index_exact": index_exact,
    "site_pages": site_pages,
    "separation_by_story": lambda s, d: vectors.nearest_each(table(s, d, "embeddings").select(F.col("label").cast("long").alias("g"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 3).select(F.col("g").alias("label"), F.col("id").alias("vec_id"), F.round(F.col("near")[0]["d"], 6).alias("d1"), F.round(F.get("near", F.lit(2))["d"], 6).alias("d3")),
}

_HEAD = "CASE WHEN regexp_matches(w, 'ies$') AND length(w) > 4 THEN w[:-4] || 'y' WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN w[:-3] WHEN regexp_matches(w, '[^s]s$') AND length(w) > 3 THEN w[:-2] ELSE w END"
_TOKENS = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*|%')) AS w FROM documents)"
ORACLES = {
    "outlet_initials": "SELECT DISTINCT source, upper(left(regexp_extract(source, '[\\p{L}\\p{N}]+'), 1)) || 'DN' AS initials FROM documents WHERE source IS NOT NULL",
    "page_site": "SELECT page_id, nullif(regexp_extract(url, '^(https?://[^/:?#]+)', 1), '') AS site FROM pages",
    "trimmed_text": r"WITH h AS (SELECT doc_id, text, left(text, 150) AS h FROM documents WHERE text IS NOT NULL), x AS (SELECT *, regexp_extract(h, '(?s)^(.*[.!?])(\s|$)', 1) AS e FROM h) SELECT doc_id, CASE WHEN length(text) <= 150 THEN text WHEN length(e) > 90 THEN e ELSE regexp_replace(regexp_extract(h, '(?s)^(.*)\s', 1), '[\s,;:-]+$', '') || '…' END AS short FROM x",
    "word_singulars": f"SELECT w AS word, {_HEAD} AS singular FROM {_TOKENS}",
    "verb_present": f"SELECT w AS word, CASE WHEN w = 'have' THEN 'has' WHEN regexp_matches(w, '(s|x|z|ch|sh|o)$') THEN w || 'es' WHEN regexp_matches(w, '[^aeiou]y$') THEN left(w, length(w) - 1) || 'ies' ELSE w || 's' END AS present FROM {_TOKENS} WHERE length(w) > 2",
    "seven_point_marks": "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'unusable' WHEN 1 THEN NULL WHEN 2 THEN 'invalid' WHEN 3 THEN 'negative' WHEN 4 THEN 'negative' WHEN 5 THEN 'neutral' ELSE 'positive' END AS marked FROM labels WHERE doc_id IS NOT NULL",
    "vector_text": "SELECT vec_id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
    "spelled_names": "SELECT DISTINCT source, source || '''s|' || source || '’s|' || source || 's' AS spellings FROM documents WHERE source IS NOT NULL",
    "quoted_things": r"WITH t AS (SELECT doc_id, regexp_extract_all(split_part(coalesce(text, ''), chr(10), 1), '[\p{L}''-]+') AS w FROM documents), l AS (SELECT *, list_filter(w, lambda y: length(y) >= 4) AS l FROM t) SELECT doc_id, len(w) <= 8 AND len(l) >= 2 AND len(list_filter(l, lambda y: regexp_matches(y, '^\p{Lu}'))) = len(l) AS thing FROM l",
    "gap_count": DUCK_PREFIX + ", o AS (SELECT cluster_id, source, bool_or(article_id % 2 = 0) AS readable FROM members GROUP BY ALL), g AS (SELECT cluster_id, category, source, bool_or(article_id % 3 > 0) AS same FROM members GROUP BY ALL), k AS (SELECT DISTINCT cluster_id, category FROM g), t AS (SELECT k.cluster_id, k.category, bool_or(NOT g.same OR (g.source IS NULL AND o.readable)) AS gap FROM k JOIN o ON o.cluster_id = k.cluster_id LEFT JOIN g ON g.cluster_id = k.cluster_id AND g.category IS NOT DISTINCT FROM k.category AND g.source = o.source GROUP BY ALL) SELECT cluster_id, count(*) FILTER (WHERE gap) AS gaps, count(*) AS groups FROM t GROUP BY cluster_id",
    "portrayal_from_text": """WITH m AS (SELECT conv_id, 'o' || (conv_id % 5) AS outlet, CASE WHEN role = 'user' THEN 'wanjiku' ELSE 'otieno' END AS person FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn % 4 IN (0, 1)),
k AS (SELECT person FROM m GROUP BY person HAVING count(DISTINCT conv_id) >= 6)
SELECT person, outlet, count(DISTINCT conv_id) AS articles, count(*) AS mentions, count(*) AS speaks, CAST(0 AS BIGINT) AS acted_on, CAST(0 AS BIGINT) AS described, CAST(0 AS BIGINT) AS mentioned, CAST(least(3, count(*)) AS INTEGER) AS examples FROM m JOIN k USING (person) GROUP BY person, outlet""",
    "coherence_histogram": f"WITH {_SIM}, c AS (SELECT la, round(avg(sim), 6) AS c FROM pairs WHERE la = lb GROUP BY la) SELECT CAST(least(29, floor((c + 1) * 15)) AS INTEGER) AS bin, count(*) AS stories, count(*) FILTER (WHERE c < 0.5) AS below FROM c GROUP BY 1",
    "centroid_order_rounded": f"WITH {_CENT}, n AS (SELECT label, sqrt(sum(m * m)) AS n FROM cent GROUP BY label), x AS (SELECT c.label, e.vec_id, round(sum(CAST(e.embedding[c.pos + 1] AS DOUBLE) * c.m) / any_value(n.n), 3) AS score FROM embeddings e JOIN cent c ON c.label = e.label JOIN n ON n.label = c.label GROUP BY c.label, e.vec_id) SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS place, vec_id, score FROM x",
    "story_subject": DUCK_PREFIX + f""", t AS (SELECT cluster_id AS story, article_id AS pos, string_split(regexp_replace(coalesce(title, ''), '[^\\p{{L}}\\p{{N}}''’ -]+', '|', 'g'), '|') AS p FROM members),
a AS (SELECT story, pos, unnest(range(0, len(p))) AS i, unnest(p) AS x FROM t),
b AS (SELECT story, pos, i, unnest(range(0, len(w))) AS j, unnest(w) AS w FROM (SELECT *, list_filter(string_split(x, ' '), lambda y: y <> '') AS w FROM a)),
c AS (SELECT *, list_contains(string_split('a an the and or but nor of in on at to for with into onto over after from as by about amid against before between during under up out off is are was were be will his her their its this that who what why how not no than via per say says said', ' '), lower(w)) AS stop FROM b),
e AS (SELECT *, sum(CAST(stop AS INTEGER)) OVER (PARTITION BY story, pos, i ORDER BY j) AS run FROM c),
f AS (SELECT story, pos, i, run, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS phrase, lower(arg_max(w, j)) AS w FROM e WHERE NOT stop GROUP BY ALL),
g AS (SELECT *, {_HEAD} AS head FROM f),
h AS (SELECT * FROM g WHERE length(head) >= 3 AND head NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'says', 'said', 'kenya', 'kenyan', 'kenyans', 'kenya''s', 'kenyas')),
k AS (SELECT story, head, count(DISTINCT pos) AS titles, coalesce(max(n) FILTER (WHERE n <= 6), 1) AS widest FROM h GROUP BY ALL),
l AS (SELECT story, head, phrase FROM h WHERE n <= 6 QUALIFY row_number() OVER (PARTITION BY story, head ORDER BY n DESC, pos, i, run) = 1)
SELECT story, head, titles, widest, coalesce(phrase, head) AS subject FROM k LEFT JOIN l USING (story, head)
QUALIFY row_number() OVER (PARTITION BY story ORDER BY titles >= 2 DESC, titles * widest DESC, head) = 1""",
    "vector_index_exact": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_cosine_similarity(a.e, b.e) AS x FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12), vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(x, 6) AS distance FROM r WHERE rank <= 10""",
    "site_pages": DUCK_PREFIX + """, e AS (SELECT cluster_id AS story, outlets, replace(replace(replace(replace(replace(coalesce(latest_title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t, latest_title FROM stories WHERE cluster_id IS NOT NULL),
i AS (SELECT cluster_id AS story, sum(strlen('<li><a href="">' || '</a> ' || '</li>') + strlen(CASE WHEN regexp_matches(url, '(?i)^https?://') THEN replace(replace(url, '&', '&amp;'), '''', '&#x27;') ELSE '' END)
  + strlen(replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) + strlen(coalesce(source, ''))) + count(*) - 1 AS size FROM articles WHERE cluster_id IS NOT NULL GROUP BY 1),
p AS (SELECT 'story-' || story || '.html' AS path, strlen('<!DOCTYPE html><title></title><a href="index.html">All stories</a><h1></h1><ul></ul>') + 2 * strlen(t) + coalesce(size, 0) AS size FROM e LEFT JOIN i USING (story)),
x AS (SELECT 'index.html' AS path, strlen('<!DOCTYPE html><title>Stories</title><ul></ul>') + sum(strlen('<li><a href="story-.html"></a> </li>') + strlen(story || '') + strlen(t) + strlen(outlets || '')) + count(*) - 1 AS size FROM e),
j AS (SELECT 'bundle.json' AS path, 2 + sum(strlen(to_json({'story': story, 'title': latest_title, 'outlets': outlets, 'path': 'story-' || story || '.html'}))) + count(*) - 1 AS size FROM e)
SELECT path, CAST(size AS BIGINT) AS size, CAST(0 AS BIGINT) AS problems FROM (SELECT * FROM p UNION ALL SELECT * FROM x UNION ALL SELECT * FROM j)""",
    "separation_by_story": "WITH f AS (SELECT a.label, a.vec_id, list_sort(list(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL) SELECT CAST(label AS BIGINT) AS label, vec_id, round(d[1], 6) AS d1, round(d[3], 6) AS d3 FROM f",
}
