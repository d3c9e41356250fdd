"""Queries made of the text functions, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..sources.tables import table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _titles(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


_W = r"'[^\p{L}\p{N}_\s]'"
_CLEAN = r"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"
_KEY = r"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))), " + _W + r", '', 'g'), '\s+', ' ', 'g'))"
_TITLES = "(SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title FROM documents)"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


QUERIES = {
    "clean_text": lambda s, d: _docs(s, d).select("doc_id", T.clean_text(F.col("text")).alias("clean")),
    "title_key": lambda s, d: _titles(s, d).select("doc_id", T.title_key(F.col("title")).alias("title_key")),
    "url_validity": lambda s, d: table(s, d, "pages").select("page_id", T.is_web_url(F.col("url")).alias("valid")),
    "url_canonical": lambda s, d: table(s, d, "pages").select("page_id", T.canonical_url(F.concat("url", F.lit("?a=1#top"))).alias("url"), T.site(F.col("url")).alias("site")),
    "dedupe_identifiers": lambda s, d: table(s, d, "pages").join(_titles(s, d), F.col("page_id") == F.col("doc_id")).groupBy(T.identifier(F.col("url"), F.col("title")).alias("identifier")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")),
    "outlet_slug": lambda s, d: _docs(s, d).select(F.col("source")).distinct().select("source", T.outlet_slug(F.concat(F.lit("The "), "source", F.lit(" & Co."))).alias("slug"), T.initials(F.concat(F.lit("The "), "source", F.lit(" Daily"))).alias("initials")),
    "snippet_plain": lambda s, d: table(s, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("plain")),
    "embed_text": lambda s, d: _titles(s, d).join(_docs(s, d), "doc_id").select("doc_id", T.embed_text(F.col("title"), F.col("text"), F.lit("")).alias("embed")),
    "contested_headlines": lambda s, d: _docs(s, d).select("doc_id", T.disputed(F.concat(F.lit("minister denies "), "lang")).alias("verb"), T.disputed(F.col("text")).alias("disputed")),
    "title_case_flag": lambda s, d: _titles(s, d).select("doc_id", T.is_title_case(F.col("title")).alias("title_case")),
    "english_share": lambda s, d: _docs(s, d).select("doc_id", F.round(T.english_share(F.col("text")), 6).alias("share")),
    "verb_family": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.verb_family(F.concat(F.when(F.col("turn") % 2 == 0, "deny").otherwise("Tell"), F.lit(" that"))).alias("family")),
    "entity_key": lambda s, d: _docs(s, d).select("doc_id", T.entity_key(F.concat(F.lit("The Minister "), "source", F.lit("'s"))).alias("key")),
    "word_stems": lambda s, d: _docs(s, d).where("lang = 'en'").select(F.explode(F.array_distinct(T.word_tokens(F.col("text")))).alias("w")).distinct().select("w", T.stem(F.col("w")).alias("stem"), T.singular(F.col("w")).alias("singular")),
    "name_mentions_prefilter": lambda s, d: _docs(s, d).where(F.col("text").rlike(r"(?i)(?<!\w)(idiot|moron)(?!\w)")).select("doc_id"),
    "paywall_predicate": lambda s, d: _docs(s, d).select("doc_id", F.length(T.readable_body(F.col("text"))).alias("n")),
    "tone_band": lambda s, d: table(s, d, "events").select("event_id", T.tone_label(F.col("value") / 100 - 0.5).alias("tone")),
    "cumulative_flag": lambda s, d: _docs(s, d).select("doc_id", T.is_cumulative(F.concat(F.lit("So far "), "lang")).alias("a"), T.is_cumulative(F.col("text")).alias("b")),
    "word_overlap_search": lambda s, d: _docs(s, d).select("doc_id", (F.size(F.filter(F.array(F.lit("the"), F.lit("ing"), F.lit("ouer"), F.lit("zzz")), lambda w: F.contains(F.lower("text"), w))) / 4).alias("overlap")).where("overlap >= 0.5"),
    "runtime_percentiles": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95")),
    "sentence_context": lambda s, d: sentence_context(s, d),
    "claim_cap_per_article": lambda s, d: claim_cap(s, d),
    "number_mentions": lambda s, d: _docs(s, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+([.,][0-9]+)*"), F.lit(0))).cast("long").alias("n")),
    "casing_lexicon": lambda s, d: casing_lexicon(s, d),
    "threshold_grid": lambda s, d: threshold_grid(s, d),
}


def sentence_context(s: SparkSession, d: str) -> DataFrame:
    """Each sentence with the one before and after, 600 characters at most."""
    around = lambda x, i: F.substring(F.concat_ws(" ", F.when(i > 0, F.get("x", F.greatest(i - 1, F.lit(0)))), x, F.get("x", i + 1)), 1, 600)
    rows = _docs(s, d).select("doc_id", T.sentences(F.col("text")).alias("x"))
    return rows.select("doc_id", F.posexplode(F.transform("x", around)).alias("pos", "context"))


def claim_cap(s: SparkSession, d: str) -> DataFrame:
    """The first 8 sentences of an article that are 40 characters or longer and are no table rows."""
    placed = F.transform(T.sentences(F.col("text")), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    held = F.filter(placed, lambda e: (F.length(e["x"]) >= 40) & ~e["x"].rlike(r"^\|.*\|$"))
    rows = _docs(s, d).select("doc_id", F.posexplode(F.slice(held, 1, 8)).alias("k", "e"))
    return rows.select("doc_id", F.col("e.pos").alias("pos"), (F.col("k") + 1).alias("rn"))


def casing_lexicon(s: SparkSession, d: str) -> DataFrame:
    """The commonest written form of each word (twice at least), words at a line's start and in capitals left out."""
    words = _docs(s, d).where("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("form"))
    counts = words.groupBy("form").count().where(F.col("form") != F.upper("form")).select(F.lower("form").alias("word"), "form", "count")
    return counts.groupBy("word").agg(F.max_by("form", F.struct("count", "form")).alias("form"), F.sum("count").alias("n")).where("n >= 2")


def threshold_grid(s: SparkSession, d: str) -> DataFrame:
    """Accuracy at thresholds 0 to 0.8: the grid multiplies a fixed 81 rows, after rows of equal score are added up."""
    rows = table(s, d, "events").groupBy(F.floor("value").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 2 == 0).alias("even"))
    grid = s.range(81).select((F.col("id")).alias("t"))
    return rows.join(F.broadcast(grid)).groupBy("t").agg(F.sum(F.when(F.col("v") > F.col("t"), F.col("even")).otherwise(F.col("n") - F.col("even"))).alias("hits"))


_DISPUTE = T.DISPUTED
_END = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 4 THEN left(w, length(w) - {len(e)})" for e in ("ing", "ed", "es", "s", "e")) + " ELSE w END"

_SENTENCES = r"""(SELECT doc_id, unnest(s) AS x, unnest(range(0, len(s))) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?]["”'']?)[ \t\n\r\f]+([A-Z"“''])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') AS s FROM documents)) q"""
ORACLES = {
    "clean_text": f"SELECT doc_id, {_CLEAN.replace('{x}', 'text')} AS clean FROM documents",
    "title_key": f"SELECT doc_id, {_KEY.replace('{x}', 'title')} AS title_key FROM {_TITLES}",
    "url_validity": r"SELECT page_id, coalesce(regexp_matches(url, '(?i)^https?://[^\s/]'), false) AS valid FROM pages",
    "url_canonical": r"SELECT page_id, split_part(split_part(trim(url), '#', 1), '?', 1) AS url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site FROM pages",
    "dedupe_identifiers": f"SELECT sha256(split_part(split_part(trim(url), '#', 1), '?', 1) || '||' || {_KEY.replace('{x}', 'title')}) AS identifier, min(page_id) AS page_id, count(*) AS n FROM pages JOIN {_TITLES} t ON page_id = doc_id GROUP BY 1",
    "outlet_slug": "SELECT DISTINCT source, 'the-' || source || '-co' AS slug, upper(left(source, 1)) || 'D' AS initials FROM documents",
    "snippet_plain": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>|<[^>]*$', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\p{Z}\x{85}]+', ' ', 'g')) AS plain FROM pages""",
    "embed_text": f"SELECT t.doc_id, substr(trim(title || CASE WHEN text <> '' THEN ' ' || text ELSE ' ' END), 1, 1000) AS embed FROM {_TITLES} t JOIN documents d ON d.doc_id = t.doc_id",
    "contested_headlines": f"SELECT doc_id, true AS verb, regexp_matches(lower(text), '{_DISPUTE}') AS disputed FROM documents",
    "title_case_flag": rf"WITH w AS (SELECT doc_id, regexp_extract_all(title, '[\p{{L}}'']+')[2:] AS ws FROM {_TITLES}) SELECT doc_id, len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Lu}}') AND list_contains({_list(T.FUNCTION_WORDS)}, lower(x)))) > 0 OR (len(list_filter(ws, lambda x: length(x) >= 4)) >= 2 AND len(list_filter(ws, lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^\p{{Lu}}'))) = 0) AS title_case FROM w",
    "english_share": f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda x: list_contains({_list(T.ENGLISH)}, x))) / len(ws), 6) END AS share FROM w",
    "verb_family": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'denied or defended' ELSE 'said' END AS family FROM conversations",
    "entity_key": "SELECT doc_id, source AS key FROM documents",
    "word_stems": rf"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*|%')) AS w FROM documents WHERE lang = 'en') SELECT w, {_END} AS stem, CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS singular FROM w",
    "name_mentions_prefilter": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(idiot|moron)($|[^A-Za-z0-9_])')",
    "paywall_predicate": "SELECT doc_id, CAST(CASE WHEN length(text) < 250 OR regexp_matches(substr(text, 1, 400), '(?i)subscribe to (read|continue)|subscribers only|log in to continue|premium content') THEN 0 ELSE length(text) END AS INTEGER) AS n FROM documents",
    "tone_band": "SELECT event_id, CASE WHEN value / 100 - 0.5 > 0.15 THEN 'positive' WHEN value / 100 - 0.5 < -0.15 THEN 'negative' WHEN value IS NOT NULL THEN 'neutral' END AS tone FROM events",
    "cumulative_flag": f"SELECT doc_id, true AS a, regexp_matches(lower(text), '{'|'.join(T.CUMULATIVE)}') AS b FROM documents",
    "word_overlap_search": "SELECT doc_id, overlap FROM (SELECT doc_id, len(list_filter(['the', 'ing', 'ouer', 'zzz'], lambda x: contains(lower(text), x))) / 4 AS overlap FROM documents) WHERE overlap >= 0.5",
    "runtime_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "sentence_context": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(concat_ws(' ', lag(x) OVER w, x, lead(x) OVER w), 1, 600) AS context FROM {_SENTENCES} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
    "claim_cap_per_article": rf"SELECT * FROM (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS rn FROM {_SENTENCES} WHERE length(x) >= 40 AND NOT regexp_matches(x, '^\|.*\|$')) WHERE rn <= 8",
    "number_mentions": r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+([.,][0-9]+)*')) AS n FROM documents",
    "casing_lexicon": "WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS form FROM documents WHERE lang = 'en'), c AS (SELECT lower(form) AS word, form, count(*) AS n FROM w WHERE form <> upper(form) GROUP BY 1, 2) SELECT word, max_by(form, lpad(CAST(n AS VARCHAR), 12, '0') || form) AS form, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY word HAVING sum(n) >= 2",
    "threshold_grid": "SELECT t, CAST(sum(CASE WHEN (floor(value) > t) = (user_id % 2 = 0) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM events CROSS JOIN (SELECT unnest(range(81)) AS t) GROUP BY t",
}
