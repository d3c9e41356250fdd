"""Reports that take operators: nested results, rankings by computed scores, digests, vectors of stories, models and their evaluation."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import comparison, density, evalstats, grouping, models, names, runs, snapshots, stories, vectors, wording
from ..sources.tables import DUCK_PREFIX, run_sql, table
from .expressions import ORACLES as ORACLES_TEXT
from .special import QUERY, _APART, _CENT, _DIST, _SIM, _emb, weeks

def _members(s: SparkSession, d: str) -> DataFrame:
    return run_sql(s, d, "SELECT cluster_id, article_id, source, title, category, us FROM members")


def lateral(s: SparkSession, d: str) -> DataFrame:
    sets = _members(s, d).groupBy("cluster_id").agg(F.collect_set("source").alias("outlets"))
    return sets.select(F.explode("outlets").alias("source")).groupBy("source").agg(F.count("*").alias("stories"))


def outlet_topics(s: SparkSession, d: str) -> DataFrame:
    """Topics of each outlet, most frequent first, as one list."""
    n = run_sql(s, d, "SELECT source, category, count(*) AS n FROM articles GROUP BY source, category")
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category")))
    return n.groupBy("source").agg(F.array_join(F.transform(order, lambda x: F.concat(x["category"], F.lit(":"), (-x["k"]).cast("string"))), ",").alias("topics"))


def coverage_pivot(s: SparkSession, d: str) -> DataFrame:
    """Articles of every outlet by story, in one row a story; outlets are whatever the table has."""
    n = _members(s, d).where("source is not null").groupBy("cluster_id", "source").agg(F.count("*").alias("n"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat_ws(":", x["source"], x["n"]))
    return n.groupBy("cluster_id").agg(F.array_join(cells, ",").alias("coverage"), F.count("*").alias("outlets"))


def titles_in_order(s: SparkSession, d: str) -> DataFrame:
    """First and last titles of a story by time; per story a bounded state, no list of all."""
    m = _members(s, d).where("title <> ''")
    at = F.struct("us", "article_id")
    return m.where("us is not null").groupBy("cluster_id").agg(F.min_by("title", at).alias("first_title"), F.max_by("title", at).alias("last_title"), F.count("*").alias("n"))


def contested(s: SparkSession, d: str) -> DataFrame:
    """Stories by contention: the share of disputed headlines, a quarter more for a hot topic, a quarter for each contested quote."""
    m = _members(s, d)
    per = m.groupBy("cluster_id").agg(F.avg((T.disputed(F.col("title")) | (F.col("article_id") % 3 == 0)).cast("double")).alias("share"), F.countDistinct("source").alias("outlets"), F.max("us").alias("latest"), F.count_if(F.col("article_id") % 11 == 0).alias("quotes"))
    score = F.round(comparison.contention(F.col("share"), F.col("cluster_id") % 2 == 0, F.col("quotes")), 6)
    return per.withColumn("score", score).where("score >= 0.5").orderBy(F.desc("score"), F.desc("outlets"), F.desc_nulls_last("latest"), "cluster_id").limit(20).select("cluster_id", "score", "outlets", "latest")


def by_differences(s: SparkSession, d: str) -> DataFrame:
    """Stories by how much their outlets differ; those not analysed come last."""
    m = _members(s, d).withColumn("gap", F.when(F.col("article_id") % 2 == 0, F.lit(0.25)).otherwise(F.lit(0.75)))
    per = m.groupBy("cluster_id").agg(F.count_if(F.col("article_id") % 5 == 0).alias("related"), F.count_if(F.col("article_id") % 7 == 0).alias("groups"), (F.max("gap") - F.min("gap")).alias("gap"), F.countDistinct("source").alias("outlets"))
    per = per.withColumn("relations", F.array(F.lit("first"), F.when(F.col("outlets") > 2, "different").otherwise("same")))
    return per.select("cluster_id", "outlets", comparison.differences(F.col("related"), F.col("groups"), F.col("relations"), F.col("gap")).cast("long").alias("gaps"))


def _figures(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("story"), (F.col("l_partkey") * 10_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_suppkey") % 3).alias("source"), F.col("l_linestatus").alias("sentence"), F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("value"))


def digest(s: SparkSession, d: str) -> DataFrame:
    return comparison.digest(_figures(s, d)).select("story", "pos", "source", "unit", "value", F.size("breakdown").cast("long").alias("rest"), "peers", "tier")


def sections(s: SparkSession, d: str) -> DataFrame:
    """How many figures of each section; grouped are those whose value another outlet has too."""
    own = comparison.digest(_figures(s, d))
    shared = own.groupBy("story", "unit", "value").agg(F.countDistinct("source").alias("k")).where("k >= 2").drop("k")
    groups = own.join(shared, ["story", "unit", "value"], "left_semi").select("story", "pos")
    return comparison.number_sections(own, groups).groupBy("section").agg(F.count("*").alias("n"))


def hits_with_story(s: SparkSession, d: str) -> DataFrame:
    """Nearest articles; a story under the floor is null, its article stays."""
    near = vectors.nearest(_emb(s, d), "embedding", QUERY, 20).select("vec_id", "label", "distance")
    firm = vectors.coherence(_emb(s, d), "label", "embedding").where("coherence >= 0.3").select(F.col("label").alias("story_id"))
    return near.join(firm, F.col("label") == F.col("story_id"), "left").select("vec_id", "story_id", F.round("distance", 6).alias("distance"))


def related_centroids(s: SparkSession, d: str) -> DataFrame:
    """Pairs of stories with near centroids, by the blocked self-join."""
    c = vectors.centroids(_emb(s, d), "label", "embedding").select(F.col("label").cast("long").alias("vec_id"), F.col("centroid").alias("v"))
    norm = F.sqrt(vectors.dot(F.col("v"), F.col("v")))
    unit = c.withColumn("_n", norm).select("vec_id", F.transform("v", lambda x: x / F.col("_n")).alias("embedding"))
    return vectors.similar_pairs(unit, 0.1).select("a", "b", F.round("sim", 6).alias("sim"))


def search_groups(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest stories, related ones in one group; at most ten rows meet in one task."""
    hits = vectors.nearest(_emb(s, d), "embedding", QUERY, 120).groupBy("label").agg(F.min("distance").alias("best")).orderBy("best", "label").limit(10)
    rows = hits.join(vectors.centroids(_emb(s, d), "label", "embedding"), "label").select(F.lit(0).alias("one"), "label", "best", "centroid")

    def group(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["best", "label"]).reset_index(drop=True)
        x = np.array(p["centroid"].tolist(), float)
        parts = grouping.average_linkage(x / np.linalg.norm(x, axis=1, keepdims=True))
        return pd.DataFrame([(int(p["label"][i]), g) for g, ids in enumerate(parts) for i in ids], columns=["label", "grp"])

    return rows.groupBy("one").applyInPandas(group, "label long, grp long")


def showcase(s: SparkSession, d: str) -> DataFrame:
    """Five stories in order of size, none too near to one picked before; the best forty are looked at in one task."""
    best = _emb(s, d).groupBy("label").count().orderBy(F.desc("count"), "label").limit(40)
    rows = best.join(vectors.centroids(_emb(s, d), "label", "embedding").select("label", "centroid"), "label").select(F.lit(0).alias("one"), "label", "count", "centroid")

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["count", "label"], ascending=[False, True]).reset_index(drop=True)
        x = np.array(p["centroid"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return pd.DataFrame({"label": [int(p["label"][i]) for i in grouping.pick_apart(x @ x.T, 5)]})

    return rows.groupBy("one").applyInPandas(pick, "label long")


def separation_stats(s: SparkSession, d: str) -> DataFrame:
    """Distances to the nearest and second nearest vector; the spread is that of the second."""
    q = lambda c, p: F.percentile(c, p)
    return vectors.separation(_emb(s, d)).agg(
        F.count("*").alias("n"), F.round(F.avg("first"), 6).alias("mean"), F.round(q("first", 0.5), 6).alias("median"), F.round(F.min("first"), 6).alias("least"),
        F.round(F.avg("second"), 6).alias("mean_second"), F.round(q("second", 0.5), 6).alias("median_second"), F.round(q("second", 0.9) - q("second", 0.1), 6).alias("spread"),
    )


def sweep(s: SparkSession, d: str) -> DataFrame:
    """Clusters and noise of each week under all settings."""
    return density.sweep(weeks(s, d), [2, 3, 4, 5, 6], [1, 2, 3], [0.0, 0.7, 0.75, 0.8])


def claim_pool(s: SparkSession, d: str) -> DataFrame:
    """Similar claims of one story, and whether one entails the other. A text's words are taken once and meet others' where the vectors do."""
    texts = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = _emb(s, d).join(texts, "vec_id").select("vec_id", "embedding", "label", models.words_of(F.col("text")).alias("words"))
    pairs = vectors.similar_pairs(rows, 0.35, group="label", words="words")
    return pairs.select("a", "b", models.relation_by(F.col("shared"), F.col("words_a"), F.col("words_b")).alias("relation"))


def target_tones(s: SparkSession, d: str) -> DataFrame:
    """Tone at a span, of the sentence where the span can't be scored, and by which it was scored; each distinct text once."""
    spans = table(s, d, "documents").select("doc_id", "text", F.lit(0).alias("start"), (F.locate(" ", "text") - 1).alias("stop"))
    scored = spans.withColumn("targeted", models.target_tone_of(F.col("text"), F.coalesce("start", F.lit(0)), F.coalesce("stop", F.lit(-1))))
    whole = models.tone_of(F.col("text"))
    return scored.select("doc_id", F.coalesce("targeted", whole).alias("tone"), F.when(F.col("targeted").isNull(), "sentence").otherwise("targeted").alias("scored_by"))


def mcnemar(s: SparkSession, d: str) -> DataFrame:
    n = run_sql(s, d, "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0 AND doc_id % 2 = 0) AS b, count(*) FILTER (WHERE quality = 0 AND doc_id % 2 = 1) AS c FROM labels")
    return n.select("b", "c", F.round(evalstats.mcnemar_p(F.col("b"), F.col("c")), 9).alias("p"))


def _two_methods(s: SparkSession, d: str) -> DataFrame:
    """Labels as gold classes, and the classes of two scores of different quality."""
    gold = F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").otherwise("neu")
    good = F.when(F.col("doc_id") % 7 < 5, gold).otherwise("neu")
    return table(s, d, "labels").where("doc_id is not null").select("doc_id", gold.alias("gold"), good.alias("a"), F.when(F.col("doc_id") % 3 == 0, gold).otherwise("pos").alias("b"), (F.when(gold == "pos", 0.4).when(gold == "neg", -0.4).otherwise(0.1) * (F.col("doc_id") % 4 + 1) / 4).alias("score"))


def people_section(s: SparkSession, d: str) -> DataFrame:
    rows = evalstats.split(_two_methods(s, d), "doc_id")
    return evalstats.tuned_and_fixed(rows.where("split = 'dev'"), rows.where("split = 'test'"))


def stacked(s: SparkSession, d: str) -> DataFrame:
    """Multinomial regression over two scores, chosen by cross-validation; accuracy in test articles, which no training row shares."""
    rows = table(s, d, "labels").where("quality is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, 0.0).when(F.col("quality") == 1, 2.0).otherwise(1.0).alias("label"), (F.col("doc_id") % 7 / 7 + F.col("quality")).alias("sentence"), (F.col("doc_id") % 5 / 5 - F.col("toxic")).alias("targeted"))
    return evalstats.stacked(evalstats.split(rows, "doc_id"), ["sentence", "targeted"])


def upserted(s: SparkSession, d: str) -> DataFrame:
    """Previews (title, tone) under a later batch that has some titles only."""
    docs = table(s, d, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    batch = table(s, d, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("doc_id"), F.lit(7).alias("quality"))
    return stories.upsert(docs, batch, "doc_id").select("doc_id", "quality", "toxic")


def named(s: SparkSession, d: str) -> DataFrame:
    """Names in whole texts, with offsets: the capitalised words of the benchmark as a gazetteer, beside what the model and titles find."""
    return names.mentions(table(s, d, "documents").select("doc_id", "text"), "text", ["doc_id"], _gazetteer(s, d))


def _gazetteer(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("surface")).distinct()
    licence = s.range(1).select(F.explode(F.array(F.lit("Apache License"), F.lit("License"))).alias("surface"))
    rows = words.unionByName(licence).distinct()
    return rows.select("surface", F.when(F.length("surface") > 6, "ORG").otherwise("PERSON").alias("label"), F.lower("surface").alias("id"), (F.length("surface") % 2 == 0).alias("case_sensitive"))


def listed_counts(s: SparkSession, d: str) -> DataFrame:
    """How often each listed name stands in whole texts, alone."""
    found = names.mentions(table(s, d, "documents").select("doc_id", "text"), "text", ["doc_id"], _gazetteer(s, d), model=None, titles=False)
    return found.groupBy("id", "label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def turn_diffs(s: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation with the words marked that the turn before it of the same role has not."""
    turns = table(s, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return turns.withColumn("other", before).where("other is not null").select("conv_id", "turn", "role", wording.word_diff(F.col("text"), F.col("other")).alias("marked"))


def reclustered(s: SparkSession, d: str) -> DataFrame:
    """Stories after two runs over a sliding window: what was published up to a day before the newest, then everything."""
    rows = weeks(s, d).where("window = 0").select(F.col("id").alias("article_id"), "vector", "source").join(table(s, d, "events").select(F.col("event_id").alias("article_id"), F.col("ts").alias("published")), "article_id")
    root = f"{snapshots.shared_dir(s).rstrip('/')}/stories-{uuid.uuid4().hex}"
    newest = rows.agg(F.max("published").alias("newest"))
    early = rows.crossJoin(F.broadcast(newest)).where("published < newest - INTERVAL 6 HOURS").drop("newest")
    runs.recluster(s, root, early, most=1.0)
    runs.recluster(s, root, rows, most=1.0)
    return runs.state(s, root)["members"].join(runs.state(s, root)["clusters"].select("cluster_id", "status", "run"), "cluster_id")


QUERIES = {
    "stories_per_source_lateral": lateral,
    "outlet_topics_nested": outlet_topics,
    "story_titles_by_time": titles_in_order,
    "contested_ranking": contested,
    "stories_by_differences": by_differences,
    "figure_digest": digest,
    "number_sections": sections,
    "coverage_pivot": coverage_pivot,
    "search_with_story": hits_with_story,
    "related_centroids": related_centroids,
    "search_story_groups": search_groups,
    "showcase_pick": showcase,
    "separation_stats": separation_stats,
    "hdbscan_sweep": sweep,
    "hdbscan_stability": lambda s, d: density.stability(weeks(s, d)),
    "hdbscan_density_curve": lambda s, d: density.density_curve(weeks(s, d), [0.25, 0.4, 0.55, 0.7, 0.85, 1.0]),
    "claim_pair_pool": claim_pool,
    "targeted_tone": target_tones,
    "topic_model": lambda s, d: table(s, d, "documents").select("doc_id", models.topic_of(F.col("text")).alias("topic")),
    "mcnemar_exact": mcnemar,
    "listed_names": listed_counts,
    "word_diff": turn_diffs,
    "sliding_recluster": reclustered,
    "bootstrap_lead": lambda s, d: evalstats.bootstrap(_two_methods(s, d), "gold", "a", "b"),
    "bootstrap_method": lambda s, d: evalstats.bootstrap(_two_methods(s, d), "gold", "a"),
    "bootstrap_thresholds": people_section,
    "kappa_weighted": lambda s, d: evalstats.kappas(_two_methods(s, d), "gold", "b").select("n", F.round("kappa", 9).alias("kappa"), F.round("quadratic", 9).alias("quadratic")),
    "stacked_regression": stacked,
    "upsert_preview": upserted,
    "name_mentions": named,
    "span_marking": lambda s, d: table(s, d, "pages").select("page_id", T.marked(F.col("url"), F.lit(0), F.lit(4)).alias("marked"), T.span_holds(F.col("url"), F.lit(0), F.lit(4), F.lit("http")).alias("holds")),
    "class_of_scores": lambda s, d: table(s, d, "events").select("event_id", T.most_likely(F.array(F.col("value"), 100 - F.col("value"), F.lit(40.0))).cast("long").alias("class")),
}

_DIGEST = """f AS (SELECT l_orderkey AS story, l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS pos, l_suppkey % 3 AS source, l_linestatus AS sentence, l_returnflag AS unit, l_quantity AS value FROM lineitem),
t AS (SELECT *, row_number() OVER (PARTITION BY story, source, sentence, unit ORDER BY value DESC, pos) AS rn FROM f),
x AS (SELECT story, source, sentence, unit, max(value) AS m FROM f GROUP BY ALL),
b AS (SELECT f.story, f.source, f.sentence, f.unit, count(*) FILTER (WHERE f.value <> x.m) AS rest FROM f JOIN x USING (story, source, sentence, unit) GROUP BY ALL),
k AS (SELECT t.*, row_number() OVER (PARTITION BY story, source, value, unit ORDER BY pos) AS k FROM t WHERE rn = 1),
u AS (SELECT k.*, b.rest FROM k JOIN b USING (story, source, sentence, unit) WHERE k = 1),
dig AS (SELECT story, pos, source, unit, value, rest, count(*) OVER (PARTITION BY story, unit) - count(*) OVER (PARTITION BY story, unit, source) AS peers FROM u)"""
_DISPUTED = T.DISPUTED
_LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
_SPLIT = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def _tone(x: str) -> str:
    """The lexical tone backend, as SQL over a text expression."""
    good, bad = (f"len(list_filter({_SPLIT.format(x=x)}, lambda w: list_contains({_LISTED(v)}, w)))" for v in (models.GOOD, models.BAD))
    return f"CASE WHEN {good} + {bad} > 0 THEN ({good} - {bad}) / CAST({good} + {bad} AS DOUBLE) ELSE 0 END"


_HITS = {k: f"len(list_intersect({_SPLIT.format(x='text')}, {_LISTED(v)}))" for k, v in models.TOPICS.items()}
_FURNITURE = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "nav", "header", "footer", "aside"))
ORACLES = {
    "listed_names": """WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS surface FROM benchmark UNION SELECT 'License'),
t AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, 'Apache License', 'Apache_License'), '[\\p{L}\\p{N}_]+')) AS w FROM documents),
u AS (SELECT t.doc_id, s.surface FROM t JOIN s ON lower(w) = lower(surface) AND (w = surface OR length(surface) % 2 = 1) UNION ALL SELECT doc_id, 'Apache License' FROM t WHERE w = 'Apache_License')
SELECT lower(surface) AS id, CASE WHEN length(surface) > 6 THEN 'ORG' ELSE 'PERSON' END AS label, count(*) AS n, count(DISTINCT doc_id) AS docs FROM u GROUP BY surface""",
    "kappa_weighted": """WITH g AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS a FROM labels WHERE doc_id IS NOT NULL), p AS (SELECT a, CASE WHEN doc_id % 3 = 0 THEN a ELSE 2 END AS b FROM g),
x AS (SELECT avg(CAST(a <> b AS INTEGER)) AS d, avg((a - b) * (a - b)) AS q, count(*) AS n FROM p), e AS (SELECT avg(CAST(l.a <> r.b AS INTEGER)) AS d, avg((l.a - r.b) * (l.a - r.b)) AS q FROM p l CROSS JOIN p r)
SELECT n, round(1 - x.d / e.d, 9) AS kappa, round(1 - x.q / e.q, 9) AS quadratic FROM x, e""",
    "html_to_text": ORACLES_TEXT["snippet_plain"].replace("coalesce(html, '')", f"regexp_replace(coalesce(html, ''), '(?is){_FURNITURE}', ' ', 'g')").replace("AS plain", "AS body"),
    "rate_limit_sliding": "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events), r AS (SELECT user_id, rn, CAST(NULL AS BIGINT) AS older, t AS last, true AS admitted FROM e WHERE rn = 1 UNION ALL SELECT user_id, rn, CASE WHEN ok THEN last ELSE older END, CASE WHEN ok THEN t ELSE last END, ok FROM (SELECT e.user_id, e.rn, e.t, r.older, r.last, r.older IS NULL OR r.older <= e.t - 86400000000 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) x) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE admitted) AS admitted FROM r GROUP BY user_id",
    "contested_ranking": DUCK_PREFIX + f", p AS (SELECT cluster_id, avg(CASE WHEN coalesce(regexp_matches(lower(title), '{_DISPUTED}'), false) OR article_id % 3 = 0 THEN 1e0 ELSE 0e0 END) AS share, count(DISTINCT source) AS outlets, max(us) AS latest, count(*) FILTER (WHERE article_id % 11 = 0) AS quotes FROM members GROUP BY cluster_id), s AS (SELECT cluster_id, round(share + CASE WHEN cluster_id % 2 = 0 THEN 0.25e0 ELSE 0e0 END + 0.25e0 * quotes, 6) AS score, outlets, latest FROM p) SELECT cluster_id, score, outlets, latest FROM s WHERE score >= 0.5 ORDER BY score DESC, outlets DESC, latest DESC NULLS LAST, cluster_id LIMIT 20",
    "collapse_hits_per_story": "WITH h AS (SELECT vec_id AS article_id, CASE WHEN vec_id % 3 > 0 THEN label END AS cluster_id, CAST(embedding[1] AS DOUBLE) AS sim FROM embeddings), t AS (SELECT * FROM h WHERE sim >= 0.1 ORDER BY sim DESC, article_id LIMIT 120), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce('s' || cluster_id, 'a' || article_id) ORDER BY sim DESC, article_id) AS rn FROM t) SELECT article_id, cluster_id, round(sim, 6) AS sim FROM (SELECT * FROM r WHERE rn = 1 ORDER BY sim DESC, article_id LIMIT 20)",
    "tone_model": f"SELECT doc_id, {_tone('text')} AS tone FROM documents",
    "targeted_tone": f"WITH s AS (SELECT doc_id, text, instr(text, ' ') - 1 AS stop FROM documents) SELECT doc_id, CASE WHEN stop > 0 THEN {_tone('substr(text, 1, stop + 300)')} ELSE {_tone('text')} END AS tone, CASE WHEN stop > 0 THEN 'targeted' ELSE 'sentence' END AS scored_by FROM s",
    "topic_model": "SELECT doc_id, CASE " + " ".join(f"WHEN {v} > 0 AND {v} / CAST({' + '.join(_HITS.values())} AS DOUBLE) >= 0.75 THEN '{k}'" for k, v in _HITS.items()) + " ELSE 'General' END AS topic FROM documents",
    "claim_pair_pool": f"WITH {_SIM}, w AS (SELECT doc_id, list_distinct({_SPLIT.format(x='text')}) AS w FROM documents), r AS (SELECT a, b, len(list_intersect(x.w, y.w)) >= 0.5 * len(y.w) AND len(y.w) > 0 AS one, len(list_intersect(x.w, y.w)) >= 0.5 * len(x.w) AND len(x.w) > 0 AS two FROM pairs JOIN w x ON x.doc_id = a JOIN w y ON y.doc_id = b WHERE la = lb AND sim >= 0.35) SELECT a, b, CASE WHEN one AND two THEN 'same' WHEN one THEN 'first_more' WHEN two THEN 'second_more' ELSE 'different' END AS relation FROM r",
    "stories_per_source_lateral": DUCK_PREFIX + ", o AS (SELECT cluster_id, list(DISTINCT source) AS outlets FROM members GROUP BY cluster_id), e AS (SELECT unnest(outlets) AS source FROM o) SELECT source, count(*) AS stories FROM e GROUP BY source",
    "outlet_topics_nested": DUCK_PREFIX + ", n AS (SELECT source, category, count(*) AS n FROM articles GROUP BY source, category) SELECT source, string_agg(category || ':' || n, ',' ORDER BY n DESC, category) AS topics FROM n GROUP BY source",
    "story_titles_by_time": DUCK_PREFIX + ", m AS (SELECT * FROM members WHERE title <> '' AND us IS NOT NULL) SELECT cluster_id, (list(title ORDER BY us, article_id))[1] AS first_title, (list(title ORDER BY us DESC, article_id DESC))[1] AS last_title, count(*) AS n FROM m GROUP BY cluster_id",
    "stories_by_differences": DUCK_PREFIX + ", p AS (SELECT cluster_id, count(*) FILTER (WHERE article_id % 5 = 0) + count(*) FILTER (WHERE article_id % 7 = 0) AS r, count(DISTINCT article_id % 2) AS tones, count(DISTINCT source) AS outlets FROM members GROUP BY cluster_id) SELECT cluster_id, outlets, r + CASE WHEN outlets > 2 THEN 1 ELSE 0 END + CASE WHEN tones = 2 THEN 1 ELSE 0 END AS gaps FROM p",
    "figure_digest": f"WITH {_DIGEST} SELECT story, pos, source, unit, value, rest, peers, CASE WHEN peers > 0 THEN 'shared' ELSE 'single' END AS tier FROM dig",
    "number_sections": f"WITH {_DIGEST}, g AS (SELECT story, unit, value FROM dig GROUP BY ALL HAVING count(DISTINCT source) >= 2) SELECT CASE WHEN g.story IS NOT NULL THEN 'grouped' WHEN dig.peers > 0 THEN 'ungrouped' ELSE 'solo' END AS section, count(*) AS n FROM dig LEFT JOIN g USING (story, unit, value) GROUP BY 1",
    "coverage_pivot": DUCK_PREFIX + ", n AS (SELECT cluster_id, source, count(*) AS n FROM members WHERE source IS NOT NULL GROUP BY cluster_id, source) SELECT cluster_id, string_agg(source || ':' || n, ',' ORDER BY source) AS coverage, count(*) AS outlets FROM n GROUP BY cluster_id",
    "search_with_story": f"WITH {_SIM}, firm AS (SELECT la FROM pairs WHERE la = lb GROUP BY la HAVING avg(sim) >= 0.3) SELECT vec_id, firm.la AS story_id, round(distance, 6) AS distance FROM (SELECT * FROM {_DIST} ORDER BY distance, vec_id LIMIT 20) t LEFT JOIN firm ON firm.la = t.label",
    "related_centroids": f"WITH {_CENT}, n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM cent GROUP BY label), p AS (SELECT x.label AS a, y.label AS b, sum(x.m * y.m) AS s FROM cent x JOIN cent y ON x.pos = y.pos AND x.label < y.label GROUP BY x.label, y.label) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(s / (n.norm * k.norm), 6) AS sim FROM p JOIN n ON n.label = a JOIN n k ON k.label = b WHERE s / (n.norm * k.norm) >= 0.1",
    "separation_stats": f"WITH {_APART} SELECT count(*) AS n, round(avg(first), 6) AS mean, round(quantile_cont(first, 0.5), 6) AS median, round(min(first), 6) AS least, round(avg(second), 6) AS mean_second, round(quantile_cont(second, 0.5), 6) AS median_second, round(quantile_cont(second, 0.9) - quantile_cont(second, 0.1), 6) AS spread FROM sep",
    "mcnemar_exact": "WITH n AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0 AND doc_id % 2 = 0) AS b, count(*) FILTER (WHERE quality = 0 AND doc_id % 2 = 1) AS c FROM labels), i AS (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS i FROM n) SELECT b, c, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))), 9) AS p FROM i GROUP BY b, c",
    "upsert_preview": "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, o.toxic FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) o FULL OUTER JOIN (SELECT page_id AS doc_id, 7 AS quality FROM pages WHERE page_id % 2 = 0) n ON n.doc_id = o.doc_id",
    "span_marking": "SELECT page_id, '[[' || substr(url, 1, 4) || ']]' || substr(url, 5) AS marked, coalesce(substr(url, 1, 4) = 'http', false) AS holds FROM pages",
    "class_of_scores": "SELECT event_id, CASE WHEN value >= 100 - value AND value >= 40 THEN 0 WHEN 100 - value >= 40 THEN 1 ELSE 2 END AS class FROM events",
}
