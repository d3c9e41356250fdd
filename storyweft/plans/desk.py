"""The desk's operators: wording, names, remarks, portrayal and framing. The SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import evalstats, people, stories
from ..sources.tables import DUCK_PREFIX, run_sql, table
from .expressions import casing_lexicon

#: A run of capitalised words, as a name may be written.
_NAMES = "[A-Z][a-z]+(?: [A-Z][a-z]+)*"
_EXCERPT = 60


def _quotes(s: SparkSession, d: str) -> DataFrame:
    """Headlines of stories as quotes: every third has no speaker, the others' languages are theirs."""
    rows = run_sql(s, d, "SELECT cluster_id, article_id, source, category, title, embedding FROM articles WHERE cluster_id IS NOT NULL")
    speaker = F.when(F.col("article_id") % 3 > 0, F.concat(F.col("category"), (F.col("article_id") % 5).cast("string")))
    return rows.select(F.col("cluster_id").cast("long").alias("story"), F.col("article_id").alias("pos"), F.coalesce("source", F.lit("")).alias("source"), speaker.alias("speaker"), F.col("title").alias("wording"), F.col("category").alias("lang"), F.col("embedding").cast("array<double>").alias("vector"))


def quote_remarks(s: SparkSession, d: str) -> DataFrame:
    return people.remarks(_quotes(s, d), 0.05, 0.3)


def remark_split(s: SparkSession, d: str) -> DataFrame:
    q = _quotes(s, d)
    return people.remark_split(people.remarks(q, 0.05, 0.3).join(q.select("story", "pos", "speaker", "wording"), ["story", "pos"]))


def _folded(s: SparkSession, d: str) -> DataFrame:
    """Names in whole texts of stories, each with the name that it is short for."""
    rows = run_sql(s, d, "SELECT cluster_id AS story, text FROM articles WHERE cluster_id IS NOT NULL")
    return people.folded_names(rows.select(F.col("story").cast("long").alias("story"), F.explode(F.transform(F.regexp_extract_all("text", F.lit(_NAMES), F.lit(0)), F.lower)).alias("key")))


def _framed(s: SparkSession, d: str) -> DataFrame:
    """Names in whole texts: several words are a person, long ones an organisation, others a day or a place; ones in -ing are verbs."""
    docs = table(s, d, "documents").where("text is not null")
    found = docs.select(F.col("doc_id").alias("text_id"), F.posexplode(F.regexp_extract_all("text", F.lit(_NAMES), F.lit(0))).alias("start", "name")).withColumn("key", F.lower("name"))
    kind = F.when(F.contains("name", F.lit(" ")), "PERSON").when(F.length("name") >= 9, "ORG").when(F.length("name") >= 6, "DATE").otherwise("GPE")
    shares = found.groupBy("key").agg(F.countDistinct("text_id").alias("k")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("all_")))).select("key", (F.col("k") / F.col("all_")).alias("share"))
    return people.framed_mentions(found.withColumn("kind", kind).withColumn("has_verb", F.col("name").endswith("ing")).join(shares, "key")).select("text_id", "start", "key")


def _cased(s: SparkSession, d: str) -> DataFrame:
    """First lines, Title Case ones as the corpus mostly writes their words."""
    titles = _first_lines(s, d).select(F.col("doc_id").alias("id"), "title")
    return people.true_cased(titles, casing_lexicon(s, d))


def _portrayed(s: SparkSession, d: str) -> DataFrame:
    """Events as mentions: the user is the person, the type the verb."""
    e = table(s, d, "events")
    role = F.element_at(F.array(*[F.lit(r) for r in ("speaks", "acts", "acted_on", "named")]), (F.col("event_id") % 4 + 1).cast("int"))
    verb = F.when(F.col("event_id") % 4 == 2, F.col("event_type"))
    return e.select((F.col("user_id") % 100).cast("string").alias("person"), F.concat(F.lit("o"), (F.col("event_id") % 7).cast("string")).alias("outlet"), role.alias("role"), verb.alias("verb"), F.when(F.col("event_id") % 3 == 0, "them").alias("by"), ((F.col("event_id") % 41 - 20) / 20).alias("tone"))


_PORTRAYED = """m AS (SELECT CAST(user_id % 100 AS VARCHAR) AS person, 'o' || (event_id % 7) AS outlet, ['speaks', 'acts', 'acted_on', 'named'][event_id % 4 + 1] AS role,
CASE WHEN event_id % 4 = 2 THEN event_type END AS verb, CASE WHEN event_id % 3 = 0 THEN 'them' END AS who, (event_id % 41 - 20) / 20 AS tone FROM events)"""


def _scores(s: SparkSession, d: str) -> DataFrame:
    return run_sql(s, d, "SELECT cluster_id AS story, category AS entity, source AS outlet, CAST(article_id % 21 - 10 AS DOUBLE) / 10 AS score, article_id % 5 > 0 AS targeted FROM members")


def _graded(s: SparkSession, d: str) -> DataFrame:
    gold = F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").otherwise("neu")
    return table(s, d, "labels").select(gold.alias("gold"), ((F.col("doc_id") * 7919 % 201 - 100) / 100).alias("score"))


def _first_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"))


def _pruned(s: SparkSession, d: str) -> DataFrame:
    """Maps of outlets without their records, opened again."""
    per = run_sql(s, d, "SELECT cluster_id, source, count(*) AS n, max(title) AS records FROM members WHERE source IS NOT NULL GROUP BY cluster_id, source")
    nested = per.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("n", "records")))).alias("outlets"))
    bare = nested.select("cluster_id", F.transform_values("outlets", lambda k, v: v.dropFields("records")).alias("outlets"))
    return bare.select("cluster_id", F.explode("outlets").alias("source", "o")).select("cluster_id", "source", "o.*")


def _comparable(s: SparkSession, d: str) -> DataFrame:
    readable = run_sql(s, d, "SELECT m.cluster_id, array_agg(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN m.source END) AS readable, CASE WHEN m.cluster_id % 5 > 0 THEN array_agg(CASE WHEN l.quality = 1 THEN m.article_id END) END AS facts FROM members m LEFT JOIN labels l ON l.doc_id = m.article_id GROUP BY m.cluster_id")
    return readable.select("cluster_id", stories.comparable(F.col("readable"), F.col("facts")).alias("comparable"))


QUERIES = {
    "quote_remarks": quote_remarks,
    "quote_remark_split": remark_split,
    "entity_alias_folding": _folded,
    "mentions_worth_framing": _framed,
    "portrayal_by_outlet": lambda s, d: people.portrayal(_portrayed(s, d)),
    "framing_view_top3": lambda s, d: people.framing_view(_scores(s, d)),
    "threshold_f1_grid": lambda s, d: evalstats.threshold_scores(_graded(s, d)).select("step", F.round("f1", 9).alias("f1")),
    "threshold_tuned": lambda s, d: evalstats.tuned_threshold(_graded(s, d)).select("step", F.round("f1", 9).alias("f1")),
    "title_true_case": _cased,
    "nested_column_pruning": _pruned,
    "comparable_story": _comparable,
    "outlet_listing": lambda s, d: run_sql(s, d, "SELECT cluster_id, array_sort(collect_set(source)) AS x, count(DISTINCT article_id) AS n FROM members GROUP BY cluster_id").select("cluster_id", T.listing(F.col("x")).alias("names"), T.plural(F.col("n"), "article").alias("articles"), T.some_of(F.size("x"), F.col("n")).alias("facts")),
    "figure_excerpt": lambda s, d: _first_lines(s, d).where("text is not null").select("doc_id", T.excerpt(F.col("text"), F.greatest(F.lit(0), F.instr("text", " 1") - 1), _EXCERPT).alias("excerpt")),
    "cited_authority": lambda s, d: table(s, d, "documents").select("doc_id", T.cited_authority(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " police said who").when(F.col("doc_id") % 3 == 1, " WHO data from a poll").otherwise(" said who"))).alias("authority")),
    "possessive_straight": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.straight_possessive(F.concat(F.coalesce("text", F.lit("")), F.lit(" Ruto’s ‘plan’ isn’t Kenya’sx")))).alias("digest")),
    "title_expansion": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.array_join(T.title_words(F.concat(F.when(F.col("turn") % 2 == 0, "DP ").otherwise("the CS "), "role")), " ").alias("words")),
    "html_escaped": lambda s, d: table(s, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("digest"), T.web_link(F.when(F.col("page_id") % 4 == 0, "javascript:x").otherwise(F.concat("url", F.lit("?a=1&b='2'")))).alias("link")),
    "review_marks": lambda s, d: table(s, d, "labels").select("doc_id", T.mark(F.when(F.col("quality") == 1, " Yes").when(F.col("toxic") == 1, "n").otherwise("?")).alias("marked")),
    "review_verdict": lambda s, d: table(s, d, "labels").groupBy((F.col("doc_id") % 9).alias("g")).agg(F.sum("quality").alias("k"), F.count("quality").alias("n")).select("g", T.verdict(F.col("k"), F.col("n"), evalstats.wilson(F.col("k"), F.col("n")).getField("low"), 0.5).alias("verdict")),
    "phrase_cleanup": lambda s, d: _first_lines(s, d).select("doc_id", T.clean_phrase(F.concat(F.lit(" The "), "title", F.lit(" -; "))).alias("phrase")),
    "json_navigation": lambda s, d: table(s, d, "events").select("event_id", F.to_json(F.struct("event_id", F.struct("user_id", "event_type").alias("who"))).alias("j")).select("event_id", F.get_json_object("j", "$.who.event_type").alias("kind"), F.get_json_object("j", "$.who.user_id").cast("long").alias("person"), F.get_json_object("j", "$.none").alias("none")),
    "positional_zip": lambda s, d: table(s, d, "embeddings").select("vec_id", F.explode(F.arrays_zip(F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 6)).alias("x"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("name"))).alias("z")).select("vec_id", "z.name", "z.x"),
    "status_update": lambda s, d: table(s, d, "labels").select("doc_id", stories.next_status(F.when(F.col("quality") == 1, "deep").when(F.col("toxic") == 1, "failed"), F.when(F.col("doc_id") % 2 == 0, "preview").otherwise("deep"), F.when(F.col("doc_id") % 5 == 0, "timeout")).alias("status")),
}

_STEP = """g AS (SELECT CASE WHEN toxic = 1 THEN 'neg' WHEN quality = 1 THEN 'pos' ELSE 'neu' END AS gold, doc_id * 7919 % 201 - 100 AS s FROM labels WHERE doc_id IS NOT NULL),
t AS (SELECT unnest(range(0, 81)) AS step), p AS (SELECT step, gold, CASE WHEN s > step THEN 'pos' WHEN s < -step THEN 'neg' ELSE 'neu' END AS guess FROM t, g),
c AS (SELECT unnest(['neg', 'neu', 'pos']) AS c), e AS (SELECT step, c, count(*) FILTER (WHERE gold = c AND guess = c) AS tp, count(*) FILTER (WHERE (gold = c) <> (guess = c)) AS wrong FROM p, c GROUP BY step, c),
f AS (SELECT step, sum(CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + wrong AS DOUBLE) ELSE 0 END) / 3 AS f1 FROM e GROUP BY step)"""
_ATTR, _AUTH = "(?i)\\b(?:" + "|".join(T.ATTRIBUTES) + ")\\b", "(?i)\\b(" + "|".join(T.AUTHORITIES) + ")\\b"
ORACLES = {
    "entity_alias_folding": DUCK_PREFIX + """, k AS (SELECT CAST(cluster_id AS BIGINT) AS story, key, count(*) AS n, string_split(key, ' ') AS w FROM (SELECT cluster_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) AS key FROM articles WHERE cluster_id IS NOT NULL) GROUP BY ALL),
p AS (SELECT a.story, a.key, b.key AS canonical, row_number() OVER (PARTITION BY a.story, a.key ORDER BY len(b.w) DESC, b.n DESC, b.key) AS rn FROM k a JOIN k b ON a.story = b.story AND (a.key = b.key OR (len(b.w) > 1 AND list_has_all(b.w, a.w))))
SELECT story, key, canonical FROM p WHERE rn = 1""",
    "mentions_worth_framing": """WITH f AS (SELECT doc_id AS text_id, unnest(x) AS name, CAST(unnest(range(0, len(x))) AS INTEGER) AS start FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*') AS x FROM documents WHERE text IS NOT NULL)),
k AS (SELECT lower(name) AS key, count(DISTINCT text_id) / (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS share FROM f GROUP BY 1)
SELECT text_id, min(start) AS start, key FROM f JOIN k ON key = lower(name) WHERE share <= 0.25 AND length(key) >= 3 AND NOT suffix(name, 'ing') AND len(string_split(name, ' ')) <= 4 AND (contains(name, ' ') OR length(name) >= 9 OR length(name) < 6) GROUP BY text_id, key""",
    "portrayal_by_outlet": f"WITH {_PORTRAYED}, a AS (SELECT person, outlet, string_agg(verb || ':' || w || ':' || n, ',' ORDER BY n DESC, verb, w) AS actions FROM (SELECT person, outlet, verb, coalesce(who, '') AS w, count(*) AS n FROM m WHERE verb IS NOT NULL GROUP BY ALL) GROUP BY person, outlet) SELECT person, outlet, count(*) AS mentions, count(*) FILTER (WHERE role = 'speaks') AS speaks, count(*) FILTER (WHERE role = 'acts') AS acts, count(*) FILTER (WHERE role = 'acted_on') AS acted_on, count(*) FILTER (WHERE role = 'named') AS named, count(*) FILTER (WHERE tone > 0.15) AS warm, count(*) FILTER (WHERE tone < -0.15) AS cold, round(avg(tone), 6) AS mean_tone, any_value(actions) AS actions FROM m LEFT JOIN a USING (person, outlet) GROUP BY person, outlet",
    "framing_view_top3": DUCK_PREFIX + ", x AS (SELECT cluster_id AS story, category AS entity, source AS outlet, avg((article_id % 21 - 10) / 10) AS s, bool_and(article_id % 5 > 0) AS t FROM members GROUP BY ALL), p AS (SELECT story, entity, round(max(s) - min(s), 6) AS spread, string_agg(outlet, ',' ORDER BY round(s, 6) DESC, outlet) AS outlets, bool_and(t) AS targeted FROM x GROUP BY story, entity HAVING count(*) > 1) SELECT *, row_number() OVER (PARTITION BY story ORDER BY spread DESC, entity) AS place FROM p QUALIFY place <= 3",
    "threshold_f1_grid": f"WITH {_STEP} SELECT step, round(f1, 9) AS f1 FROM f",
    "threshold_tuned": f"WITH {_STEP} SELECT step, round(f1, 9) AS f1 FROM f ORDER BY round(f.f1, 6) DESC, abs(step - 15), step LIMIT 1",
    "title_true_case": """WITH t AS (SELECT doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents),
w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS form FROM documents WHERE lang = 'en'), c AS (SELECT lower(form) AS word, form, count(*) AS n FROM w WHERE form <> upper(form) GROUP BY 1, 2),
x AS (SELECT word, max_by(form, lpad(CAST(n AS VARCHAR), 12, '0') || form) AS form FROM c GROUP BY word HAVING sum(n) >= 2),
p AS (SELECT id, title, regexp_extract_all(title, '[\\p{L}'']+|[^\\p{L}'']+') AS s, regexp_extract_all(title, '[\\p{L}'']+')[2:] AS ws FROM t),
g AS (SELECT *, len(list_filter(ws, lambda y: regexp_matches(y, '^\\p{Lu}') AND list_contains(string_split('a an the and or but nor of in on at to for with into onto over after from as by about amid against before between during under up out off is are was were be will his her their its this that who what why how not no than via per', ' '), lower(y)))) > 0
  OR (len(list_filter(ws, lambda y: length(y) >= 4)) >= 2 AND len(list_filter(ws, lambda y: length(y) >= 4 AND NOT regexp_matches(y, '^\\p{Lu}'))) = 0) AS titled FROM p),
u AS (SELECT id, unnest(s) AS q, unnest(range(0, len(s))) AS i, CASE WHEN regexp_matches(s[1], '^[\\p{L}'']') THEN 0 ELSE 1 END AS first FROM g WHERE titled),
j AS (SELECT id, string_agg(CASE WHEN i = first OR (length(q) > 1 AND q = upper(q)) THEN q ELSE coalesce(form, q) END, '' ORDER BY i) AS cased FROM u LEFT JOIN x ON word = lower(q) GROUP BY id)
SELECT id, coalesce(cased, title) AS cased FROM g LEFT JOIN j USING (id)""",
    "nested_column_pruning": DUCK_PREFIX + "SELECT cluster_id, source, count(*) AS n FROM members WHERE source IS NOT NULL GROUP BY cluster_id, source",
    "comparable_story": DUCK_PREFIX + "SELECT m.cluster_id, CASE WHEN m.cluster_id % 5 > 0 THEN count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN m.source END) >= 2 AND count(CASE WHEN l.quality = 1 THEN 1 END) > 0 END AS comparable FROM members m LEFT JOIN labels l ON l.doc_id = m.article_id GROUP BY m.cluster_id",
    "outlet_listing": DUCK_PREFIX + ", x AS (SELECT cluster_id, list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)) AS x, count(DISTINCT article_id) AS n FROM members GROUP BY cluster_id) SELECT cluster_id, CASE WHEN len(x) = 1 THEN x[1] ELSE array_to_string(x[:-2], ', ') || ' and ' || x[-1] END AS names, n || CASE WHEN n = 1 THEN ' article' ELSE ' articles' END AS articles, CASE WHEN n = 1 THEN 'The one fact found was' ELSE len(x) || ' of the ' || n || ' facts ' || CASE WHEN len(x) = 1 THEN 'was' ELSE 'were' END END AS facts FROM x",
    # Letters with accents are letters to a word's edge here too.
    "cited_authority": f"WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[À-ɏ]', 'x', 'g') || CASE doc_id % 3 WHEN 0 THEN ' police said who' WHEN 1 THEN ' WHO data from a poll' ELSE ' said who' END AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, '{_ATTR}') THEN nullif(regexp_extract(t, '{_AUTH}', 1), '') END AS authority FROM t",
    "title_expansion": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'deputy president ' ELSE 'the cabinet secretary ' END || lower(role) AS words FROM conversations",
    "html_escaped": "SELECT page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest, CASE WHEN page_id % 4 = 0 THEN '' ELSE replace(url, '&', '&amp;') || '?a=1&amp;b=&#x27;2&#x27;' END AS link FROM pages",
    "review_marks": "SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN false END AS marked FROM labels",
    "review_verdict": "WITH x AS (SELECT doc_id % 9 AS g, sum(quality) AS k, count(quality) AS n FROM labels GROUP BY 1) SELECT g, CASE WHEN k / n < 0.5 THEN 'FAIL' WHEN (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n) >= 0.5 THEN 'PASS' ELSE 'PASS (interval reaches below the threshold)' END AS verdict FROM x",
    "json_navigation": "SELECT event_id, event_type AS kind, CAST(user_id AS BIGINT) AS person, CAST(NULL AS VARCHAR) AS none FROM events",
    "positional_zip": "SELECT vec_id, ['a', 'b', 'c'][i] AS name, round(CAST(embedding[i] AS DOUBLE), 6) AS x FROM embeddings, (SELECT unnest([1, 2, 3]) AS i)",
    "status_update": "SELECT doc_id, CASE WHEN quality = 1 THEN 'deep' WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 2 = 0 THEN 'preview' ELSE 'deep' END AS status FROM labels",
    "possessive_straight": "SELECT doc_id, md5(replace(coalesce(text, ''), '’s ', '''s ') || ' Ruto''s ‘plan’ isn’t Kenya’sx') AS digest FROM documents",
    "phrase_cleanup": "SELECT doc_id, regexp_replace(regexp_replace(split_part(coalesce(text, ''), chr(10), 1) || ' -; ', '^[ .,:;|—-]+', ''), '[ .,:;|—-]+$', '') AS phrase FROM documents",
}
