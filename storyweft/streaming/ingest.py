"""Polled ingest and the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import canonical_url, clean_text, identifier, is_web_url

WINDOW_S, MOST = 60.0, 30


def valid_candidates(raw: DataFrame) -> DataFrame:
    """raw (url, title, published) -> rows with an identifier; no title or no web link, no row."""
    rows = raw.withColumn("title", clean_text(F.col("title"))).where((F.col("title") != "") & is_web_url(F.trim(F.col("url"))))
    return rows.withColumn("url_canon", canonical_url(F.col("url"))).withColumn("identifier", identifier(F.col("url"), F.col("title")))


def append_batch(table: str):
    """foreachBatch: new identifiers only, so a replayed batch adds nothing. Of several rows of one identifier the earliest published stays, then the first by title and url."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = valid_candidates(batch)
        others = [c for c in rows.columns if c != "identifier"]
        order = F.struct(F.col("published").isNull().alias("late"), *others) if "published" in others else F.struct(*others)
        first = rows.groupBy("identifier").agg(F.min(order).alias("r")).select("identifier", *[F.col("r")[c].alias(c) for c in others]).select(*rows.columns)
        try:
            # Only the identifiers of the table are read.
            first = first.join(spark.read.parquet(table).select("identifier"), "identifier", "left_anti").select(*rows.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        first.write.mode("append").parquet(table)

    return run


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, schema: str = "url string, title string, published timestamp"):
    """Everything that has landed in `source` (JSON), once; run it on a schedule."""
    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(append_batch(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit(times: list[float], held: list[float] | None = None, most: int = MOST, window: float = WINDOW_S) -> tuple[list[bool], list[float]]:
    """Sliding log: a request passes if fewer than `most` passed in the last window; refused ones don't count, and one exactly a window old has expired."""
    log, out = list(held or []), []
    for t in times:
        log = [x for x in log if x > t - window]
        ok = len(log) < most
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def rate_limit(requests: DataFrame, key: list[str], time_us: str, tie: str, most: int = MOST, window: float = WINDOW_S) -> DataFrame:
    """requests with `admitted`. A key's log is sequential; keys run side by side."""
    kind = requests.withColumn("admitted", F.lit(True)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time_us, tie])
        return pdf.assign(admitted=admit((pdf[time_us] / 1e6).tolist(), None, most, window)[0])

    return requests.groupBy(*key).applyInPandas(run, kind)


def rate_limit_stream(requests: DataFrame, key: str, time_s: str, most: int = MOST, window: float = WINDOW_S) -> DataFrame:
    """The same limiter on a stream; state is the log of requests that passed, and a quiet key's state expires."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        for pdf in parts:
            pdf = pdf.sort_values(time_s)
            ok, log = admit(pdf[time_s].tolist(), log, most, window)
            yield pd.DataFrame({"key": [str(k[0])] * len(pdf), "at": pdf[time_s], "admitted": ok})
        state.update((log,))
        state.setTimeoutDuration(int(window * 2000))

    return requests.groupBy(key).applyInPandasWithState(run, "key string, at double, admitted boolean", "log array<double>", "append", "ProcessingTimeTimeout")
