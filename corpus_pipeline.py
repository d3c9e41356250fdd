"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokens. Every stage takes and returns documents; the last returns token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't call toxic. It is fitted on the labelled rows of these documents.

    Null and empty texts have no features and stay unless the chain's bias alone is toxic; null ids have no label but are
    judged; repeated rows are judged alike; without labels nothing is toxic."""
    from storyweft.llm import toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    targets = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
    chain = toxicity.train(docs, labels, targets)
    return toxicity.classify(docs, chain, list(targets)).where("p_toxic < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; a document that lost lines and has no text left goes.

    Null and empty texts stay, null ids stay whole; repeated rows lose the same lines."""
    from storyweft.llm.line_dedup import dedup_lines

    kept = dedup_lines(docs).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", "n_removed")
    return kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies (five-word shingles, similarity 0.8).

    Rows of one id are one document: of repeated ones, the least by its columns stays. Texts without words are copies of
    nothing; rows with a null id all stay."""
    from storyweft.llm.near_dedup import near_dups

    kept = near_dups(docs, percent=80).where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    docs = docs.select(*COLUMNS)
    once = docs.join(kept.where("_n = 1 or _id is null"), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    several = docs.join(kept.where("_n > 1"), docs["doc_id"] == F.col("_id"), "left_semi")
    least = several.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return once.unionByName(least.select("doc_id", "row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to three times, as rows of their own).

    Null and empty texts are never taken. Rows of one id are told apart by source and text; ones that are repeated with
    all of these are numbered and taken one by one."""
    from storyweft.llm.mixing import mix, numbered, row_key

    taken = mix(docs).where("copies > 0").select(row_key(F.col("doc_id"), F.col("source"), F.col("text_hash")).alias("_of"), F.col("repeat").alias("_nth"), "copies")
    rows = numbered(docs.select(*COLUMNS).withColumn("_row", row_key(F.col("doc_id"), F.col("source"), F.xxhash64("text"))), "_row", "_repeat")
    rows = rows.join(taken, (F.col("_row") == F.col("_of")) & (F.col("_repeat") == F.col("_nth")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of their decoding; null text counts as empty, every row comes back."""
    import public_tokenizers

    from storyweft.llm.bpe import encode as encoded

    return encoded(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    from storyweft.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
