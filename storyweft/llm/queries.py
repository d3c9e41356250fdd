"""The contract queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    targets = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
    chain = toxicity.train(docs, labels, targets)
    scored = toxicity.classify(docs.select("doc_id", "text"), chain, list(targets))
    return scored.select("doc_id", F.col("p_low_quality"), F.col("p_toxic"), (F.col("p_toxic") >= 0.5).alias("toxic"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica as a store may hand it back: pages whose id leaves 5 over 97 have a byte changed, those that leave 7 over 101 are lost."""
    html = F.coalesce("html", F.lit(""))
    flipped = F.concat(F.lit("\u0001"), F.substring(html, 2, 1 << 30))
    return pages.where("page_id is null or page_id % 101 <> 7").withColumn("html", F.when(F.col("page_id") % 97 == 5, flipped).otherwise(html))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import audit

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


OP3_SQL = """
WITH r AS (
  SELECT page_id, page_id // 1000 AS warc_file, page_id % 1000 AS slot,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS whole
  FROM pages)
SELECT page_id, warc_file, slot,
  CAST(coalesce(sum(strlen(whole)) OVER (PARTITION BY warc_file ORDER BY slot, sha256(whole) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS warc_offset,
  CAST(strlen(whole) AS BIGINT) AS record_length, sha256(whole) AS record_sha256,
  CASE WHEN page_id % 101 = 7 THEN 'missing' WHEN page_id % 97 = 5 THEN 'corrupt' ELSE 'ok' END AS status
FROM r
"""


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_corpus

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_corpus(docs, held)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  coalesce(doc_id = max(doc_id) OVER w, false) AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dups

    return near_dups(_table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill, restored

    made = infill(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import run_counts, variants

    return variants(run_counts(_table(spark, sf_dir, "documents"), least=7, least_n=2, slip=31), ratio=10)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leaks import decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    n = F.size("items").cast("long").alias("n_items")
    return out.select("doc_id", "n_words", "n_hit", n, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near"))


OP13_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS a FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
g AS (
  SELECT r, k, a, array_to_string(w[a:a + k - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
m AS (SELECT r, k, a, item_id FROM g JOIN i USING (k, win)),
h AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(a, a + k)) AS spot FROM (SELECT DISTINCT r, k, a FROM m)) GROUP BY r),
n AS (SELECT r, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items, count(DISTINCT item_id) AS n_items FROM m GROUP BY r),
f AS (SELECT term, count(*) AS f FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
q AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(f, 0), place) AS rank
  FROM (SELECT item_id, term, min(place) AS place FROM (SELECT item_id, unnest(w) AS term, unnest(range(0, len(w))) AS place FROM b WHERE item_id IS NOT NULL) GROUP BY ALL) LEFT JOIN f USING (term)
  QUALIFY rank <= 4),
s AS (SELECT item_id, count(*) AS many FROM q GROUP BY item_id HAVING count(f) = count(*)),
x AS (
  SELECT r, item_id, many, count(DISTINCT rank) OVER (PARTITION BY r, item_id ORDER BY place RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS met
  FROM (SELECT r, unnest(w) AS term, unnest(range(0, len(w))) AS place FROM d) JOIN (SELECT item_id, term, rank FROM q) USING (term) JOIN s USING (item_id)),
y AS (SELECT r, count(DISTINCT item_id) AS n_near FROM x WHERE met = many GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r) LEFT JOIN y USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1,
    "op2_suffix_array_dedup": op2,
    "op3_warc_merkle_audit": op3,
    "op4_pruned_graph_search": op4,
    "op5_kneser_ney": op5,
    "op6_bpe_chunk_reuse": op6,
    "op7_exact_dedup": op7,
    "op8_line_dedup": op8,
    "op9_source_mix": op9,
    "op10_chosen_path_near_dedup": op10,
    "op11_escaped_infill": op11,
    "op12_errata_trie": op12,
    "op13_positional_decontamination": op13,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op3_warc_merkle_audit": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op11_escaped_infill": OP11_SQL, "op13_positional_decontamination": OP13_SQL}
