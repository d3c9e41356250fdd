"""Composite reports, state changes and evaluation reports; the same SQL runs in Spark and, as its check, in DuckDB. {marks} are filled per engine."""

from __future__ import annotations

HOUR = 3_600_000_000
_SCORED = "scored AS (SELECT a.article_id, a.category, a.source, CASE WHEN l.toxic = 1 THEN 'neg' WHEN l.quality = 1 THEN 'pos' ELSE 'neu' END AS gold, CASE WHEN a.article_id % 4 < 3 THEN (a.article_id * 7919 % 200 - 100) / 1e2 END AS targeted, (a.article_id * 104729 % 200 - 100) / 1e2 AS sentence FROM articles a JOIN labels l ON l.doc_id = a.article_id)"
_GUESS = "CASE WHEN {x} > {t} THEN 'pos' WHEN {x} < -{t} THEN 'neg' ELSE 'neu' END"
_OLD_NEW = "old AS (SELECT cluster_id, article_id FROM members WHERE article_id % 10 > 0), fresh AS (SELECT cluster_id, article_id FROM members WHERE article_id % 10 < 9)"

BODIES: dict[str, str] = {
    # one story, one outlet, one person
    "story_detail": "SELECT m.cluster_id, m.article_id, m.source, m.title, a.url, l.doc_id IS NOT NULL AS readable FROM members m JOIN articles a ON a.article_id = m.article_id LEFT JOIN labels l ON l.doc_id = m.article_id WHERE m.cluster_id = (SELECT min(cluster_id) FROM stories WHERE outlets >= 2)",
    "story_glance_sole_carriers": "WITH f AS (SELECT cluster_id, category, count(DISTINCT source) AS carriers, min(source) AS carrier FROM members GROUP BY cluster_id, category) SELECT cluster_id, count(*) AS facts, count(*) FILTER (WHERE carriers = 1) AS sole, min(CASE WHEN carriers = 1 THEN carrier END) AS first_sole FROM f GROUP BY cluster_id",
    "people_index": "WITH t AS (SELECT count(DISTINCT source) AS n FROM articles), p AS (SELECT category, count(*) AS articles, count(DISTINCT source) AS outlets, max(us) AS latest FROM members GROUP BY category) SELECT category, articles, outlets, n - outlets AS absent, latest FROM p CROSS JOIN t WHERE articles >= 6 AND outlets >= 2",
    "person_totals_left_join": "WITH t AS (SELECT source, count(*) AS total FROM articles GROUP BY source), p AS (SELECT source, category, count(*) AS n FROM members GROUP BY source, category) SELECT t.source, p.category, coalesce(p.n, 0) AS n, t.total, round(coalesce(p.n, 0) / CAST(t.total AS DOUBLE), 6) AS share FROM t LEFT JOIN p ON p.source = t.source AND p.category = 'en'",
    "outlet_page_stories": "SELECT s.cluster_id, s.outlets, s.article_count, s.latest FROM stories s WHERE EXISTS (SELECT 1 FROM members m WHERE m.cluster_id = s.cluster_id AND m.source = 'src3') ORDER BY s.latest DESC NULLS LAST, s.cluster_id LIMIT 20",
    "role_per_person_first": "WITH t AS (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations) SELECT conv_id, role, turn FROM t WHERE rn = 1",
    "modal_title_form": "WITH f AS (SELECT source, lower(title) AS k, title, count(*) AS n FROM articles WHERE title <> '' GROUP BY source, lower(title), title), r AS (SELECT source, title, sum(n) OVER (PARTITION BY source, k) AS uses, n, k FROM f), q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY uses DESC, k, n DESC, title) AS rn FROM r) SELECT source, title, CAST(uses AS BIGINT) AS uses FROM q WHERE rn = 1",
    # work lists
    "preview_titles_capped": "WITH d AS (SELECT cluster_id, title, article_id, row_number() OVER (PARTITION BY cluster_id, lower(title) ORDER BY us DESC NULLS LAST, article_id) AS again FROM members WHERE title <> ''), r AS (SELECT cluster_id, title, article_id, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) AS pos FROM d WHERE again = 1) SELECT cluster_id, pos, title FROM r WHERE pos <= 12",
    "review_tally": "WITH v AS (SELECT s.cluster_id, CASE WHEN count(l.doc_id) = 0 THEN 'open' WHEN avg(l.quality) >= 5e-1 THEN 'good' ELSE 'mixed' END AS verdict FROM stories s JOIN members m ON m.cluster_id = s.cluster_id LEFT JOIN labels l ON l.doc_id = m.article_id GROUP BY s.cluster_id) SELECT verdict, count(*) AS n FROM v GROUP BY verdict",
    "export_multi_source": "SELECT cluster_id, outlets, article_count, latest_title FROM stories WHERE outlets >= 3 ORDER BY outlets DESC, article_count DESC, cluster_id LIMIT 12",
    "candidates_fresh_first": f"SELECT cluster_id, bool_or(us >= (SELECT max(us) FROM members) - {HOUR}) AS is_fresh, count(DISTINCT source) AS outlets FROM members GROUP BY cluster_id ORDER BY is_fresh DESC NULLS LAST, outlets DESC, cluster_id DESC LIMIT 5",
    "publish_checks": "SELECT 'pages' AS check_name, (SELECT count(*) FROM stories) AS expected, (SELECT count(DISTINCT cluster_id) FROM members) AS built UNION ALL SELECT 'links', (SELECT count(*) FROM articles WHERE url IS NOT NULL), (SELECT count(*) FROM articles WHERE lower(url) LIKE 'http%') UNION ALL SELECT 'index', (SELECT count(DISTINCT url) FROM articles), (SELECT count(*) FROM (SELECT url FROM articles WHERE url IS NOT NULL GROUP BY url) x)",
    # state: inserts, changed memberships, windows over rows
    "idempotent_insert": "WITH known AS (SELECT article_id FROM articles WHERE article_id % 3 = 0), batch AS (SELECT article_id FROM articles WHERE article_id % 2 = 0 UNION ALL SELECT article_id FROM articles WHERE article_id % 4 = 0) SELECT article_id, false AS added FROM known UNION ALL SELECT DISTINCT b.article_id, true FROM batch b WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.article_id = b.article_id)",
    "changed_memberships": f"WITH {_OLD_NEW} SELECT coalesce(o.cluster_id, f.cluster_id) AS cluster_id, count(*) FILTER (WHERE f.article_id IS NULL) AS gone, count(*) FILTER (WHERE o.article_id IS NULL) AS arrived, count(*) FILTER (WHERE o.article_id IS NULL OR f.article_id IS NULL) > 0 AS invalid FROM old o FULL OUTER JOIN fresh f ON f.article_id = o.article_id AND f.cluster_id = o.cluster_id GROUP BY coalesce(o.cluster_id, f.cluster_id)",
    "figure_window_bounds": "SELECT conv_id, turn, length(text) AS size, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, text) AS after FROM conversations",
    "speaker_look_back": "WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role END AS speaker FROM conversations) SELECT conv_id, turn, {last_known} OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS speaker FROM s",
    "age_and_day": f"SELECT article_id, CAST(floor(((SELECT max(us) FROM articles) - us) / CAST({HOUR} AS DOUBLE)) AS BIGINT) AS age_hours, CASE WHEN us >= (SELECT max(us) FROM articles) - 24 * {HOUR} THEN 'today' ELSE 'earlier' END AS period FROM articles WHERE us IS NOT NULL",
    "runtime_upper_median": "WITH c AS (SELECT event_type, value, count(*) AS c FROM events GROUP BY event_type, value), t AS (SELECT event_type, sum(c) AS n FROM c GROUP BY event_type), r AS (SELECT c.event_type, c.value, c.c, t.n, sum(c.c) OVER (PARTITION BY c.event_type ORDER BY c.value) AS upto FROM c JOIN t ON t.event_type IS NOT DISTINCT FROM c.event_type) SELECT event_type, CAST(n AS BIGINT) AS n, value AS median FROM r WHERE upto >= floor(n / 2e0) + 1 AND upto - c < floor(n / 2e0) + 1",
    "round_half_even": "SELECT event_id, {half_even} AS v FROM events",
    # how many stories a share of the corpus yields, in seeded subsamples
    "subsample_stability": "WITH k AS (SELECT 0 AS seed UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4), s AS (SELECT k.seed, m.cluster_id, m.source FROM members m CROSS JOIN k WHERE substr(md5(CAST(k.seed AS STRING) || '-' || CAST(m.article_id AS STRING)), 1, 2) < 'e6'), c AS (SELECT seed, cluster_id, count(*) AS n, count(DISTINCT source) AS outlets FROM s GROUP BY seed, cluster_id) SELECT seed, count(*) FILTER (WHERE outlets >= 2) AS stories, CAST(sum(n) AS BIGINT) AS articles FROM c GROUP BY seed",
    "density_curve": "WITH k AS (SELECT '40' AS lim, 25 AS pct UNION ALL SELECT '80', 50 UNION ALL SELECT 'c0', 75 UNION ALL SELECT 'g', 100), s AS (SELECT k.pct, m.cluster_id, m.source FROM members m CROSS JOIN k WHERE substr(md5(CAST(m.article_id AS STRING)), 1, 2) < k.lim), c AS (SELECT pct, cluster_id, count(*) AS n, count(DISTINCT source) AS outlets FROM s GROUP BY pct, cluster_id), d AS (SELECT pct, CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE outlets >= 3) AS DOUBLE) AS stories FROM c GROUP BY pct) SELECT CAST(a.pct AS BIGINT) AS pct, CAST(a.n AS BIGINT) AS articles, CAST(a.stories AS BIGINT) AS stories, CASE WHEN a.stories > 0 AND a.n < b.n THEN round(ln(b.stories / a.stories) / ln(b.n / a.n), 6) END AS elasticity FROM d a CROSS JOIN (SELECT n, stories FROM d WHERE pct = 100) b",
    # evaluation: samples, splits, comparisons
    "sample_in_turns": "WITH r AS (SELECT article_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('0-' || CAST(article_id AS STRING)), article_id) AS turn FROM articles) SELECT article_id, category, turn FROM r WHERE turn <= 40 ORDER BY turn, category LIMIT 40",
    "sample_per_story_capped": "WITH r AS (SELECT cluster_id, article_id, row_number() OVER (PARTITION BY cluster_id, article_id % 2 ORDER BY md5('1-' || CAST(article_id AS STRING)), article_id) AS rn FROM members) SELECT cluster_id, article_id, CASE WHEN article_id % 2 = 0 THEN 'kept' ELSE 'split' END AS half FROM r WHERE rn <= 3",
    "split_by_article": "SELECT article_id, CASE WHEN substr(md5('0-' || text), 1, 1) < '8' THEN 'test' ELSE 'dev' END AS part FROM articles WHERE text IS NOT NULL",
    "blinded_pairs": "WITH t AS (SELECT doc_id AS article_id, md5('blind-' || CAST(doc_id AS STRING)) AS h FROM labels WHERE toxic = 1 ORDER BY h, article_id LIMIT 40) SELECT article_id, CASE WHEN substr(h, 1, 1) < '8' THEN 'rules' ELSE 'hybrid' END AS a_is, row_number() OVER (ORDER BY h, article_id) AS pos FROM t",
    "role_contingency": f"WITH {_SCORED} SELECT {_GUESS.format(x='sentence', t='0.15')} AS rules, count(*) FILTER (WHERE gold = 'neg') AS neg, count(*) FILTER (WHERE gold = 'neu') AS neu, count(*) FILTER (WHERE gold = 'pos') AS pos FROM scored GROUP BY {_GUESS.format(x='sentence', t='0.15')}",
    "method_fallback": f"WITH {_SCORED}, g AS (SELECT gold, {_GUESS.format(x='sentence', t='0.15')} AS s, CASE WHEN targeted IS NULL THEN {_GUESS.format(x='sentence', t='0.15')} ELSE {_GUESS.format(x='targeted', t='0.29')} END AS t, targeted IS NULL AS fell_back FROM scored) SELECT count(*) AS n, count(*) FILTER (WHERE fell_back) AS fell_back, count(*) FILTER (WHERE s = gold) AS sentence_right, count(*) FILTER (WHERE t = gold) AS targeted_right, count(*) FILTER (WHERE s = gold AND t <> gold) AS only_sentence, count(*) FILTER (WHERE t = gold AND s <> gold) AS only_targeted FROM g",
    "subset_reports": f"WITH {_SCORED}, g AS (SELECT category, source, gold, {_GUESS.format(x='sentence', t='0.15')} AS guess FROM scored), u AS (SELECT 'all' AS subset, gold, guess FROM g UNION ALL SELECT 'lang ' || category, gold, guess FROM g UNION ALL SELECT 'polar', gold, guess FROM g WHERE gold <> 'neu') SELECT subset, count(*) AS n, round(avg(CASE WHEN gold = guess THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM u GROUP BY subset",
    "blend_grid": f"WITH {_SCORED}, k AS (SELECT 0 AS w UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4), g AS (SELECT w, gold, round(w / 4e0 * coalesce(targeted, sentence) + (4 - w) / 4e0 * sentence, 9) AS x FROM scored CROSS JOIN k) SELECT CAST(w AS BIGINT) AS w, count(*) FILTER (WHERE {_GUESS.format(x='x', t='0.15')} = gold) AS hits FROM g GROUP BY w",
    "training_polar_share": f"WITH {_SCORED} SELECT source, count(*) AS n, round(avg(CASE WHEN abs(sentence) > 0.6 THEN 1e0 ELSE 0e0 END), 6) AS polar FROM scored GROUP BY source",
}
MARKS = {
    "last_known": {"spark": "last_value(speaker) IGNORE NULLS", "duck": "last_value(speaker IGNORE NULLS)"},
    "half_even": {"spark": "bround(value, 0)", "duck": "round_even(value, 0)"},
}
