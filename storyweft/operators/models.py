"""Model backends. Neural models may be plugged in; the offline ones here are deterministic and lexical, and no accuracy figure carries over to them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Tone words and topic cues of the offline backends.
GOOD = {"good", "great", "win", "success", "praised", "progress", "peace", "growth", "hope"}
BAD = {"bad", "crisis", "failed", "attack", "corrupt", "dead", "scandal", "worthless", "pathetic"}
TOPICS = {"Politics": {"president", "minister", "parliament", "election"}, "Business": {"market", "bank", "shilling", "growth"}, "Health": {"hospital", "doctor", "disease"}, "Sport": {"match", "goal", "league"}}


def _words(t: str | None) -> list[str]:
    return re.findall(r"\w+", (t or "").lower())


def embed(t: str | None, size: int = 384) -> list[float]:
    """Hashed words, normalised."""
    x = np.zeros(size)
    for w in _words(t):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        x[h % size] += 1 if h >> 63 else -1
    n = np.linalg.norm(x)
    return (x / n if n else x).tolist()


def topic(t: str | None, least: float = 0.75) -> str:
    words = set(_words(t))
    score = {k: len(words & v) for k, v in TOPICS.items()}
    best = max(score, key=lambda k: score[k])
    return best if score[best] and score[best] / sum(score.values()) >= least else "General"


def entail(premise: str | None, hypothesis: str | None) -> float:
    """Share of the hypothesis' words that the premise has."""
    h = set(_words(hypothesis))
    return len(h & set(_words(premise))) / len(h) if h else 0.0


def relation(a: str, b: str, least: float = 0.5, fn: Callable[[str, str], float] = entail) -> str:
    one, two = fn(a, b) >= least, fn(b, a) >= least
    return "same" if one and two else "first_more" if one else "second_more" if two else "different"


def tone(t: str | None) -> float:
    w = _words(t or "")
    good, bad = sum(x in GOOD for x in w), sum(x in BAD for x in w)
    return (good - bad) / (good + bad) if good + bad else 0.0


def target_tone(t: str | None, start: int, end: int, window: int = 300) -> float | None:
    """Tone near a span; None if the span is outside the text."""
    if t is None or not 0 <= start < end <= len(t):
        return None
    return tone(t[max(0, start - window) : end + window])


def _listed(words: Column, held: set[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(sorted(held))))


def tone_of(text: Column) -> Column:
    """tone(...) as an expression."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    good, bad = _listed(words, GOOD), _listed(words, BAD)
    return F.when(good + bad > 0, (good - bad) / (good + bad)).otherwise(F.lit(0.0))


def target_tone_of(text: Column, start: Column, end: Column, window: int = 300) -> Column:
    """target_tone(...) as an expression: null if the span is outside the text."""
    first = F.greatest(F.lit(0), start - window)
    inside = text.isNotNull() & (start >= 0) & (start < end) & (end <= F.length(text))
    return F.when(inside, tone_of(F.substring(text, first + 1, end + window - first)))


def topic_of(text: Column, least: float = 0.75) -> Column:
    """topic(...) as an expression: of topics with as many words, the one listed first."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    scores = F.array(*[_listed(words, v) for v in TOPICS.values()])
    best, total = F.array_max(scores), F.aggregate(scores, F.lit(0), lambda a, x: a + x)
    name = F.element_at(F.array(*[F.lit(k) for k in TOPICS]), F.array_position(scores, best).cast("int"))
    return F.when((best > 0) & (best / F.nullif(total, F.lit(0)) >= least), name).otherwise(F.lit("General"))


def words_of(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def relation_by(shared: Column, words_a: Column, words_b: Column, least: float = 0.5) -> Column:
    """relation(...) with the lexical entailment, from how many distinct words two texts share and have."""
    holds = lambda n: F.coalesce(shared / F.nullif(n, F.lit(0)), F.lit(0.0)) >= least
    return F.when(holds(words_b) & holds(words_a), "same").when(holds(words_b), "first_more").when(holds(words_a), "second_more").otherwise("different")


def relation_of(a: Column, b: Column, least: float = 0.5) -> Column:
    """relation(...) with the lexical entailment, as an expression."""
    return relation_by(F.size(F.array_intersect(words_of(a), words_of(b))), F.size(words_of(a)), F.size(words_of(b)), least)


def batched(load: Callable[[], Callable[[list[str]], list]], kind: T.DataType, size: int = 32) -> Callable[..., Column]:
    """A column function of a model that takes texts in batches: `load` runs once a worker, and gets each distinct text of an Arrow batch once, `size` at a time, texts of like length together. Null texts have no score."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for s in parts:
            model = model or load()
            texts = sorted({t for t in s if t is not None}, key=lambda t: (len(t), t))
            known: dict[str, object] = {}
            for a in range(0, len(texts), size):
                known |= dict(zip(texts[a : a + size], model(texts[a : a + size]), strict=True))
            yield pd.Series([known.get(t) for t in s], dtype=object)

    return run


def column(fn: Callable, kind: T.DataType) -> Callable[..., Column]:
    """An Arrow-batched column function of a backend, set up once per worker."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(fn)

    return run


def score_once(rows: DataFrame, key: str, text: str, cache: DataFrame, fn: Callable, version: str) -> DataFrame:
    """rows with score: what the cache (key, version, score) has is not scored again, and each distinct key is scored once."""
    known = cache.where(F.col("version") == version).select(key, "score")
    new = rows.select(key, text).dropDuplicates([key]).join(known, key, "left_anti").select(key, column(fn, T.DoubleType())(F.col(text)).alias("score"))
    return rows.join(known.unionByName(new), key, "left")
