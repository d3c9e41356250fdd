"""Evaluation statistics: F1, kappa, thresholds, intervals, tests, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

CLASSES = ("neg", "neu", "pos")


def f1_of(cells: np.ndarray) -> np.ndarray:
    """Macro F1 of confusion matrices (..., gold, guess); a class without hits counts 0."""
    hits = np.diagonal(cells, axis1=-2, axis2=-1)
    both = cells.sum(-1) + cells.sum(-2)
    return np.where(hits > 0, 2 * hits / np.maximum(both, 1), 0.0).mean(-1)


def bootstrap(rows: DataFrame, gold: str, guess: str, other: str | None = None, times: int = 5000, seed: int = 0, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """One row (n, value, low, high): macro F1 of `guess`, or its lead over `other` on the same rows, with the 2.5 and 97.5 percentiles of `times` resamples.

    Rows are counted by gold and guesses once; a resample of n rows is a multinomial draw of n over those cells, so its
    work does not grow with them. Draws are seeded by their number, so that reruns agree. Rows with a class that is not
    listed, or none, take no part; without rows the values are null.
    """
    k, named = len(classes), [gold, guess] + ([other] if other else [])
    code = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    known = rows.select(*[F.try_element_at(code, F.col(c)).alias(f"c{i}") for i, c in enumerate(named)]).dropna()
    at = sum((F.col(f"c{i}") * k ** (len(named) - 1 - i) for i in range(len(named))), F.lit(0))
    counts = known.groupBy(at.alias("cell")).agg(F.count("*").alias("m")).agg(F.collect_list(F.struct("cell", "m")).alias("cells"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            m = np.zeros(k ** len(named), np.int64)
            for c in pdf["cells"].iloc[0] if len(pdf) else []:
                m[c["cell"]] = c["m"]
            n = int(m.sum())
            # The first is the rows as they are.
            draws = np.array([np.random.default_rng([seed, int(i)]).multinomial(n, m / n) if i else m for i in pdf["id"]]) if n and len(pdf) else np.zeros((0, len(m)))
            cube = draws.reshape(-1, *[k] * len(named))
            value = f1_of(cube) if other is None else f1_of(cube.sum(3)) - f1_of(cube.sum(2))
            yield pd.DataFrame({"id": pdf["id"].iloc[: len(value)], "n": n, "value": value})

    drawn = rows.sparkSession.range(times + 1).crossJoin(F.broadcast(counts)).mapInPandas(run, "id long, n long, value double")
    first = F.col("id") == 0
    out = drawn.agg(F.max("n").alias("n"), F.max(F.when(first, F.col("value"))).alias("value"), F.percentile(F.when(~first, F.col("value")), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return out.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), "value", F.try_element_at("p", F.lit(1)).alias("low"), F.try_element_at("p", F.lit(2)).alias("high"))


def classed(score: Column, threshold: float) -> Column:
    """pos or neg beyond the threshold either way, else neu."""
    return F.when(score > threshold, "pos").when(score < -threshold, "neg").when(score.isNotNull(), "neu")


def tuned_and_fixed(dev: DataFrame, test: DataFrame, fixed: float = 0.15, least: int = 10, times: int = 5000, seed: int = 0) -> DataFrame:
    """(threshold_of, threshold, n, value, low, high) on test(gold, score) with the threshold that is best on dev(gold, score), and with the fixed one; no rows if test has fewer than `least`."""
    best = tuned_threshold(dev).first()
    enough = test.where("score is not null").limit(least).count() >= least
    out = None
    for name, t in (("dev", best["step"] / 100 if best else fixed), ("fixed", fixed)):
        one = bootstrap(test.withColumn("guess", classed(F.col("score"), t)), "gold", "guess", None, times, seed)
        one = one.select(F.lit(name).alias("threshold_of"), F.lit(float(t)).alias("threshold"), "*")
        out = one if out is None else out.unionByName(one)
    return out if enough else out.limit(0)


def kappas(rows: DataFrame, a: str, b: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """One row (n, kappa, quadratic): Cohen's agreement of two markers, unweighted and with squared distances of the classes' places; 1 where chance leaves nothing to disagree on."""
    code = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    pairs = rows.select(F.try_element_at(code, F.col(a)).alias("a"), F.try_element_at(code, F.col(b)).alias("b")).dropna()
    cells = pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("m"))
    left, right = cells.groupBy("a").agg(F.sum("m").alias("p")), cells.groupBy("b").agg(F.sum("m").alias("q"))
    # As many rows as pairs of classes.
    grid = left.crossJoin(right).join(cells, ["a", "b"], "left").fillna(0.0, ["m"]).crossJoin(F.broadcast(cells.agg(F.sum("m").alias("n"))))
    far = F.col("a") - F.col("b")
    off = lambda w: 1 - F.sum(w * F.col("m")) / F.nullif(F.sum(w * F.col("p") * F.col("q") / F.col("n")), F.lit(0.0))
    return grid.agg(F.max("n").cast("long").alias("n"), F.coalesce(off((far != 0).cast("double")), F.lit(1.0)).alias("kappa"), F.coalesce(off((far * far).cast("double")), F.lit(1.0)).alias("quadratic"))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p value of discordant counts: twice the binomial tail, summed term by term from their logarithms."""
    n, k = b + c, F.least(b, c)
    step = lambda s, i: F.struct((s["log"] + F.log((n - i + 1) / i)).alias("log"), (s["sum"] + F.exp(s["log"] + F.log((n - i + 1) / i))).alias("sum"))
    first = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), first, step, lambda s: s["sum"])
    return F.least(F.lit(1.0), 2 * tail)


def threshold_scores(rows: DataFrame, gold: str = "gold", score: str = "score", steps: int = 81) -> DataFrame:
    """(step, f1): the macro F1 of each threshold step / 100, scores beyond it either way being pos and neg.

    Rows are first counted by gold class, sign and the number of steps they are beyond, so that work on the grid does
    not grow with them."""
    beyond = F.least(F.lit(steps), F.ceil(F.round(F.abs(score) * 100, 9))).cast("int")
    cells = rows.where(F.col(score).isNotNull()).groupBy(F.col(gold).alias("g"), F.signum(score).alias("sign"), beyond.alias("beyond")).agg(F.count("*").alias("n"))
    each = cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    guess = F.when(F.col("step") >= F.col("beyond"), "neu").when(F.col("sign") > 0, "pos").otherwise("neg")
    held = lambda c: (F.sum(F.when((F.col("g") == c) & (guess == c), F.col("n")).otherwise(0)), F.sum(F.when((F.col("g") == c) != (guess == c), F.col("n")).otherwise(0)))
    part = lambda hit, wrong: F.when(hit > 0, 2 * hit / (2 * hit + wrong)).otherwise(F.lit(0.0))
    return each.groupBy("step").agg((sum(part(*held(c)) for c in CLASSES) / len(CLASSES)).alias("f1"))


def tuned_threshold(rows: DataFrame, gold: str = "gold", score: str = "score", near: int = 15) -> DataFrame:
    """The one row of threshold_scores that is best; of equal ones, the nearest to `near`."""
    return threshold_scores(rows, gold, score).orderBy(F.round("f1", 6).desc(), F.abs(F.col("step") - near), "step").limit(1)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    p, q = k / n, z * z
    mid, half = p + q / (2 * n), z * F.sqrt(p * (1 - p) / n + q / (4 * n * n))
    return F.struct(((mid - half) / (1 + q / n)).alias("low"), ((mid + half) / (1 + q / n)).alias("high"))


def pool_estimate(kept_right: int, kept: int, split_right: int, split: int, kept_pool: int, split_pool: int) -> tuple[float, float]:
    """(share of all pairs that are one fact, share of such pairs that are kept), marked samples weighted back to their pools."""
    a, b = kept_right / kept * kept_pool, split_right / split * split_pool
    return (a + b) / (kept_pool + split_pool), a / (a + b)


def take_turns(rows: DataFrame, stratum: list[str], id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, strata in turn, each in the order of a seeded hash."""
    own = Window.partitionBy(*stratum).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)
    return rows.withColumn("turn", F.row_number().over(own)).orderBy("turn", *stratum).limit(n)


def split(rows: DataFrame, article: str, test_share: float = 0.5, seed: int = 0) -> DataFrame:
    """dev or test by article, so that no article is in both."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(article)), F.lit(1000))
    return rows.withColumn("split", F.when(h < int(test_share * 1000), "test").otherwise("dev"))


def stacked(rows: DataFrame, features: list[str], folds: int = 3, seed: int = 0) -> DataFrame:
    """(split, n, accuracy) of a multinomial regression over method scores, fitted on rows of split dev (label 0, 1, 2), its penalty chosen by cross-validation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows)
    model = LogisticRegression(featuresCol="_x", labelCol="label", family="multinomial", maxIter=20)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 0.1]).build()
    fit = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, seed=seed).fit(x.where("split = 'dev'"))
    return fit.transform(x).groupBy("split").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
