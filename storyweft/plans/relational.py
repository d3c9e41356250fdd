"""Queries that are plain SQL over the article model; the same text runs in Spark and, as its check, in DuckDB."""

from __future__ import annotations

DAY = 86_400_000_000
_PAIR = "(SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'neg' WHEN l.quality = 1 THEN 'pos' ELSE 'neu' END AS gold, CASE WHEN length(d.text) % 3 = 0 THEN 'neg' WHEN length(d.text) % 3 = 1 THEN 'pos' ELSE 'neu' END AS guess FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"

BODIES: dict[str, str] = {
    # lists of stories and their filters
    "story_list_latest": "SELECT cluster_id, outlets, article_count, latest, latest_title FROM stories WHERE outlets >= 2 ORDER BY latest DESC NULLS LAST, cluster_id LIMIT 20",
    "story_topic_filter": "SELECT cluster_id, outlets, article_count, topic FROM stories WHERE outlets >= 2 AND topic = 'fr'",
    "story_source_filter": "SELECT cluster_id, outlets, article_count FROM stories WHERE outlets >= 2 AND has_src0",
    "story_paged": "SELECT cluster_id, outlets, article_count FROM stories ORDER BY outlets DESC, article_count DESC, cluster_id LIMIT 5 OFFSET 2",
    "story_total": "SELECT count(*) AS total FROM stories WHERE outlets >= 2",
    "topic_counts": "SELECT coalesce(topic, 'General') AS topic, count(*) AS n FROM stories GROUP BY coalesce(topic, 'General')",
    "most_covered_window": f"WITH w AS (SELECT cluster_id, count(DISTINCT source) AS outlets, count(*) AS articles, max(us) AS latest FROM members WHERE us >= (SELECT max(us) FROM members) - 7 * {DAY} GROUP BY cluster_id) SELECT s.cluster_id, w.outlets AS window_outlets, w.articles AS window_articles, s.article_count FROM stories s JOIN w ON w.cluster_id = s.cluster_id ORDER BY w.outlets DESC, w.articles DESC, w.latest DESC, s.cluster_id LIMIT 10",
    "window_articles": f"SELECT article_id, source FROM articles WHERE us >= (SELECT max(us) FROM articles) - 7 * {DAY} AND embedding IS NOT NULL",
    "source_counts": "SELECT source, count(*) AS articles, count(DISTINCT cluster_id) AS stories, min(us) AS first_us, max(us) AS last_us FROM articles GROUP BY source",
    "source_topic_mix": "SELECT source, category, count(*) AS n FROM articles GROUP BY source, category",
    "source_share": "SELECT source, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM articles GROUP BY source",
    "analysis_candidates_anti": "SELECT s.cluster_id, s.outlets, s.article_count FROM stories s WHERE s.outlets >= 2 AND NOT EXISTS (SELECT 1 FROM members m JOIN labels l ON l.doc_id = m.article_id WHERE m.cluster_id = s.cluster_id AND l.toxic = 1)",
    "noise_articles_anti": "SELECT article_id, category FROM articles a WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.article_id = a.article_id)",
    "noise_by_category": "SELECT category, count(*) AS n FROM articles WHERE cluster_id IS NULL GROUP BY category",
    "noise_titles_capped": "WITH r AS (SELECT category, title, article_id, row_number() OVER (PARTITION BY category ORDER BY article_id) AS rn FROM articles WHERE cluster_id IS NULL) SELECT category, article_id, title FROM r WHERE rn <= 20",
    "missing_summary_left_join": "SELECT a.article_id, l.quality FROM articles a LEFT JOIN labels l ON l.doc_id = a.article_id WHERE l.doc_id IS NULL",
    "loose_story_left_join": "SELECT a.article_id, s.cluster_id AS story_id FROM articles a LEFT JOIN stories s ON s.cluster_id = a.cluster_id AND s.outlets >= 19",
    "health_scalar_counts": "SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM stories) AS stories, (SELECT count(*) FROM labels) AS analysed, (SELECT max(us) FROM articles) AS latest_us, (SELECT count(DISTINCT source) FROM articles) AS sources",
    "status_histogram": "WITH st AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'not analysed' WHEN l.quality = 1 THEN 'analysed' ELSE 'headline only' END AS status FROM articles a LEFT JOIN labels l ON l.doc_id = a.article_id) SELECT status, count(*) AS n FROM st GROUP BY status",
    "filtered_counts": "SELECT count(*) AS n, count(*) FILTER (WHERE embedding IS NULL) AS no_vector, count(*) FILTER (WHERE us IS NULL) AS no_time, count(*) FILTER (WHERE cluster_id IS NOT NULL) AS placed FROM articles",
    "cluster_fresh_bool_or": f"SELECT cluster_id, bool_or(us >= (SELECT max(us) FROM members) - {DAY}) AS fresh, count(DISTINCT source) AS outlets FROM members GROUP BY cluster_id",
    "stories_of_new_articles": f"SELECT cluster_id, min(us) AS first_us FROM members GROUP BY cluster_id HAVING min(us) >= (SELECT min(us) FROM members) + 1000000",
    "known_identifiers_semi": "SELECT article_id FROM articles a WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.article_id)",
    "new_items_anti": "WITH c AS (SELECT article_id, title, row_number() OVER (PARTITION BY lower(title) ORDER BY article_id) AS rn FROM articles WHERE title <> '') SELECT c.article_id FROM c WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.article_id)",
    "feed_first_25": "WITH r AS (SELECT article_id, source, row_number() OVER (PARTITION BY source ORDER BY article_id) AS pos FROM articles) SELECT article_id, source, pos FROM r WHERE pos <= 25",
    "repeat_snippet_blank": "WITH r AS (SELECT snippet FROM articles GROUP BY snippet HAVING count(*) >= 3), k AS (SELECT snippet, 1 AS tag FROM r) SELECT a.article_id, CASE WHEN k.tag = 1 THEN '' ELSE a.snippet END AS snippet FROM articles a LEFT JOIN k ON k.snippet IS NOT DISTINCT FROM a.snippet",
    "first_article_per_outlet": "WITH r AS (SELECT cluster_id, source, article_id, row_number() OVER (PARTITION BY cluster_id, source ORDER BY us DESC NULLS LAST, article_id) AS rn FROM members) SELECT cluster_id, source, article_id FROM r WHERE rn = 1",
    "majority_topic": "WITH v AS (SELECT cluster_id, category, article_id, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) AS pos FROM members), c AS (SELECT cluster_id, category, count(*) AS n, min(pos) AS first_pos FROM v WHERE pos <= 10 GROUP BY cluster_id, category), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN category = 'es' THEN 1 ELSE 0 END, n DESC, first_pos) AS rn FROM c) SELECT cluster_id, category, n FROM r WHERE rn = 1",
    "cluster_share_guard": "SELECT max(article_count) / CAST(sum(article_count) AS DOUBLE) > 0.25 AS rejected, max(article_count) AS largest FROM stories",
    "membership_overlap_jaccard": "WITH a AS (SELECT cluster_id AS old_id, article_id FROM members), b AS (SELECT article_id % 7 AS new_id, article_id FROM members), n AS (SELECT old_id, count(*) AS na FROM a GROUP BY old_id), k AS (SELECT new_id, count(*) AS nb FROM b GROUP BY new_id), s AS (SELECT old_id, new_id, count(*) AS shared FROM a JOIN b ON a.article_id = b.article_id GROUP BY old_id, new_id) SELECT s.old_id, s.new_id, shared, round(shared / CAST(na + nb - shared AS DOUBLE), 6) AS jaccard, round(shared / CAST(least(na, nb) AS DOUBLE), 6) AS of_smaller FROM s JOIN n ON n.old_id = s.old_id JOIN k ON k.new_id = s.new_id",
    "ended_stories_anti": "SELECT s.cluster_id FROM stories s WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.cluster_id = s.cluster_id AND m.article_id % 50 = 0)",
    "document_frequency": "WITH n AS (SELECT count(DISTINCT article_id) AS total FROM articles WHERE {has_word}), t AS (SELECT w, count(*) AS df FROM (SELECT {explode_distinct_words} AS w FROM articles) x WHERE w <> '' GROUP BY w) SELECT w, df FROM t CROSS JOIN n WHERE df > 0.25 * total",
    "keyword_subject": "WITH t AS (SELECT cluster_id, article_id, {explode_words} AS w FROM articles WHERE cluster_id IS NOT NULL), c AS (SELECT cluster_id, w, count(DISTINCT article_id) AS n FROM t WHERE length(w) > 3 GROUP BY cluster_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, w) AS rn FROM c) SELECT cluster_id, w, n FROM r WHERE rn <= 6",
    "never_named_by": "WITH o AS (SELECT DISTINCT source FROM articles), p AS (SELECT DISTINCT category FROM articles), seen AS (SELECT DISTINCT source, category FROM members) SELECT p.category, o.source FROM p CROSS JOIN o WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.source = o.source AND seen.category = p.category)",
    "coverage_set_algebra": "WITH o AS (SELECT DISTINCT source FROM articles), rep AS (SELECT DISTINCT cluster_id, source FROM members WHERE article_id % 2 = 0), rel AS (SELECT DISTINCT cluster_id, source FROM members WHERE article_id % 2 = 1) SELECT s.cluster_id, o.source, CASE WHEN rep.source IS NOT NULL THEN 'reported' WHEN rel.source IS NOT NULL THEN 'related' ELSE 'omitted' END AS state FROM stories s CROSS JOIN o LEFT JOIN rep ON rep.cluster_id = s.cluster_id AND rep.source = o.source LEFT JOIN rel ON rel.cluster_id = s.cluster_id AND rel.source = o.source",
    "readability_by_outlet": "WITH f AS (SELECT m.cluster_id, m.source, bool_or(l.doc_id IS NOT NULL) AS was_read FROM members m LEFT JOIN labels l ON l.doc_id = m.article_id GROUP BY m.cluster_id, m.source) SELECT source, count(*) FILTER (WHERE was_read) AS read_stories, count(*) FILTER (WHERE NOT was_read) AS unread_stories FROM f GROUP BY source",
    "framing_mean_spread": "WITH s AS (SELECT m.cluster_id, m.source, avg(CAST(l.quality AS DOUBLE) - l.toxic) AS mean, count(*) AS n FROM members m JOIN labels l ON l.doc_id = m.article_id GROUP BY m.cluster_id, m.source) SELECT cluster_id, round(max(mean) - min(mean), 6) AS spread, count(*) AS outlets FROM s WHERE n >= 2 GROUP BY cluster_id HAVING count(*) >= 2",
    "strongest_sentence": "SELECT m.source, max_by(m.article_id, abs(l.quality - 2 * l.toxic) * 1000000 - m.article_id) AS example, count(*) AS n FROM members m JOIN labels l ON l.doc_id = m.article_id GROUP BY m.source",
    "tone_mix": "WITH t AS (SELECT a.source, CAST(l.quality AS DOUBLE) * 4e-1 - l.toxic * 9e-1 AS tone FROM articles a JOIN labels l ON l.doc_id = a.article_id), m AS (SELECT source, count(*) AS n, avg(CASE WHEN tone > 0.15 THEN 1e0 ELSE 0e0 END) AS pos, avg(CASE WHEN tone < -0.15 THEN 1e0 ELSE 0e0 END) AS neg FROM t GROUP BY source HAVING count(*) >= 4) SELECT source, n, round(CAST(pos AS DOUBLE), 6) AS pos, round(CAST(neg AS DOUBLE), 6) AS neg, CASE WHEN 1 - pos - neg >= 0.6 THEN 'mostly neutral' WHEN pos - neg >= 0.25 THEN 'leans positive' WHEN neg - pos >= 0.25 THEN 'leans negative' ELSE 'mixed' END AS label FROM m",
    "weighted_tone": "WITH s AS (SELECT a.category, a.source, avg(CAST(l.quality AS DOUBLE)) AS tone, count(*) AS n FROM articles a JOIN labels l ON l.doc_id = a.article_id GROUP BY a.category, a.source) SELECT category, round(sum(tone * n) / sum(n), 6) AS tone, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY category",
    "newest_mentions": "WITH r AS (SELECT category, source, article_id, row_number() OVER (PARTITION BY category, source ORDER BY us DESC NULLS LAST, article_id) AS rn FROM articles), k AS (SELECT category, source, count(*) AS total FROM articles GROUP BY category, source) SELECT r.category, r.source, r.article_id, k.total FROM r JOIN k ON k.category IS NOT DISTINCT FROM r.category AND k.source IS NOT DISTINCT FROM r.source WHERE r.rn <= 3",
    "one_per_role_first": "WITH r AS (SELECT source, category, article_id, us, row_number() OVER (PARTITION BY source, category ORDER BY us DESC NULLS LAST, article_id) AS in_role FROM articles), q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN in_role = 1 THEN 0 ELSE 1 END, us DESC NULLS LAST, article_id) AS rn FROM r) SELECT source, category, article_id FROM q WHERE rn <= 6",
    "role_shares": "WITH c AS (SELECT source, category, count(*) AS n FROM articles GROUP BY source, category) SELECT source, category, n, round(n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE), 6) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, category) AS place FROM c",
    "share_extremes": "WITH c AS (SELECT source, category, count(*) AS n FROM articles GROUP BY source, category), s AS (SELECT source, category, n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS share FROM c) SELECT category, round(max(share) - min(share), 6) AS apart, max(share) - min(share) >= 0.15 AS tell FROM s GROUP BY category",
    "largest_figure_per_claim": "WITH f AS (SELECT l_orderkey, l_suppkey, l_quantity, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) - 1 AS others FROM lineitem) SELECT l_orderkey, l_suppkey, l_quantity, others FROM f WHERE rn = 1",
    "distinct_figure_first": "WITH f AS (SELECT l_suppkey, l_quantity, l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_quantity, l_returnflag ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) SELECT l_suppkey, l_quantity, l_returnflag, l_orderkey, l_linenumber FROM f WHERE rn = 1",
    "figure_peers": "WITH f AS (SELECT DISTINCT o_custkey, o_orderpriority, o_orderkey FROM orders), a AS (SELECT o_orderpriority, count(*) AS n FROM f GROUP BY o_orderpriority), b AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM f GROUP BY o_orderpriority, o_custkey) SELECT f.o_orderkey, a.n - b.n AS peers FROM f JOIN a ON a.o_orderpriority IS NOT DISTINCT FROM f.o_orderpriority JOIN b ON b.o_orderpriority IS NOT DISTINCT FROM f.o_orderpriority AND b.o_custkey IS NOT DISTINCT FROM f.o_custkey",
    "spread_gate": "SELECT l_partkey, max(l_quantity) / min(l_quantity) <= 3 AS near, count(DISTINCT l_suppkey) AS outlets FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2",
    "confusion_matrix": f"SELECT gold, guess, count(*) AS n FROM {_PAIR} p GROUP BY gold, guess",
    "macro_f1": f"WITH c AS (SELECT k.k, count(*) FILTER (WHERE gold = k.k AND guess = k.k) AS tp, count(*) FILTER (WHERE gold <> k.k AND guess = k.k) AS fp, count(*) FILTER (WHERE gold = k.k AND guess <> k.k) AS fn FROM {_PAIR} p CROSS JOIN (SELECT 'neg' AS k UNION ALL SELECT 'neu' UNION ALL SELECT 'pos') k GROUP BY k.k) SELECT round(avg(CASE WHEN tp = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END), 6) AS f1m, CAST(sum(tp) AS BIGINT) AS hits FROM c",
    "kappa": f"WITH p AS (SELECT gold, guess FROM {_PAIR} q), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE gold = guess) AS DOUBLE) AS same FROM p), e AS (SELECT sum(g.n * h.n) AS e FROM (SELECT gold AS k, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY gold) g JOIN (SELECT guess AS k, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY guess) h ON g.k = h.k) SELECT round((same / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n CROSS JOIN e",
    "wilson_interval": "WITH r AS (SELECT a.source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l.quality) AS DOUBLE) AS k FROM articles a JOIN labels l ON l.doc_id = a.article_id GROUP BY a.source) SELECT source, round((k / n + 1.96e0 * 1.96e0 / (2 * n) - 1.96e0 * sqrt(k / n * (1 - k / n) / n + 1.96e0 * 1.96e0 / (4 * n * n))) / (1 + 1.96e0 * 1.96e0 / n), 6) AS low, round((k / n + 1.96e0 * 1.96e0 / (2 * n) + 1.96e0 * sqrt(k / n * (1 - k / n) / n + 1.96e0 * 1.96e0 / (4 * n * n))) / (1 + 1.96e0 * 1.96e0 / n), 6) AS high FROM r",
    "fisher_z_interval": "WITH c AS (SELECT corr(CAST(length(text) AS DOUBLE), CAST(us % 1000003 AS DOUBLE)) AS r, count(us) AS n FROM articles WHERE us IS NOT NULL) SELECT round(tanh(0.5e0 * ln((1 + r) / (1 - r)) - 1.96e0 / sqrt(CAST(n - 3 AS DOUBLE))), 6) AS low, round(tanh(0.5e0 * ln((1 + r) / (1 - r)) + 1.96e0 / sqrt(CAST(n - 3 AS DOUBLE))), 6) AS high FROM c",
    "stratified_weights": "SELECT a.category, count(*) AS pool, count(*) FILTER (WHERE l.quality = 1) AS kept, round(count(*) FILTER (WHERE l.quality = 1) / CAST(count(*) AS DOUBLE), 6) AS share FROM articles a JOIN labels l ON l.doc_id = a.article_id GROUP BY a.category",
    "annotation_merge": "SELECT a.article_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.quality = 1 AND a.article_id % 2 = 1 THEN 'agreed' WHEN l.toxic = 1 THEN 'settled' ELSE 'pending' END AS status FROM articles a LEFT JOIN labels l ON l.doc_id = a.article_id",
    "training_pool_anti": "WITH u AS (SELECT min(article_id) AS article_id FROM articles GROUP BY text) SELECT u.article_id FROM u WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = u.article_id)",
    "event_time_vs_ingest": f"SELECT count(*) FILTER (WHERE us < article_id * 1000000) AS early, count(*) FILTER (WHERE us >= (SELECT max(us) FROM articles) - 7 * {DAY}) AS in_window FROM articles",
    "source_availability": "SELECT event_type, round(1 - count(*) FILTER (WHERE value < 10) / CAST(count(*) AS DOUBLE), 6) AS availability FROM events GROUP BY event_type",
    "quality_checks": "SELECT 'double_member' AS check_name, count(*) AS bad FROM (SELECT article_id FROM members GROUP BY article_id HAVING count(*) > 1) x UNION ALL SELECT 'count_mismatch', count(*) FROM stories s WHERE article_count <> (SELECT count(*) FROM members m WHERE m.cluster_id = s.cluster_id) UNION ALL SELECT 'no_title', count(*) FROM articles WHERE title = ''",
    "due_check": "SELECT count(*) >= 40 AS due, count(*) AS new_articles FROM articles a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.article_id)",
    "latest_stories": "SELECT cluster_id, latest FROM stories ORDER BY latest DESC NULLS LAST, cluster_id LIMIT 3",
    "index_newest_by_url": "WITH r AS (SELECT article_id, url, row_number() OVER (PARTITION BY url ORDER BY us DESC NULLS LAST, article_id) AS rn FROM articles WHERE url IS NOT NULL) SELECT article_id, url FROM r WHERE rn = 1",
    "visualisation_join": "SELECT a.article_id, s.cluster_id, s.outlets, l.quality FROM articles a LEFT JOIN stories s ON s.cluster_id = a.cluster_id LEFT JOIN labels l ON l.doc_id = a.article_id WHERE a.us IS NOT NULL",
}
