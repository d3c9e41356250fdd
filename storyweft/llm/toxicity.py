"""Classifier chain for toxicity categories.

Each category's linear model sees a text's words and their beginnings (inflected languages vary the rest) and the probabilities of the categories before it; in training these
are out-of-fold predictions, so that a later model doesn't trust an earlier one more than it will deserve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import portions, words

#: Labelled rows used for fitting at most (those with the least hash of their id), words a category's model keeps, folds.
TRAIN_ROWS, MOST_WORDS, FOLDS = 6_000, 2_048, 4
#: Rows that a word must be in to be learnt from.
LEAST = 3
#: First bytes of words that are features of their own.
HEADS = (4, 5)
_STEPS, _L1, _L2 = 120, 0.7, 1e-3


def _fit_linear(rows: np.ndarray, codes: np.ndarray, size: int, n: int, extra: np.ndarray, y: np.ndarray) -> dict:
    """L1-selected logistic regression on word presence and dense extras. rows, codes: (row, word) pairs; words are numbered below `size`."""
    pos = float(y.sum())
    if n == 0 or pos == 0 or pos == n:
        return {"words": np.zeros(0, np.int64), "w": np.zeros(0), "u": np.zeros(extra.shape[1]), "b": 12.0 if n and pos == n else -12.0}
    seen, hit = np.bincount(codes, minlength=size), np.bincount(codes[y[rows] == 1], minlength=size)
    rate = pos / n
    z = (hit - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1e-9)
    z[seen < min(LEAST, pos)] = 0
    best = np.sort(np.argsort(-np.abs(z), kind="stable")[:MOST_WORDS])
    slot = np.full(size, -1, np.int32)
    slot[best] = np.arange(len(best))
    c = slot[codes]
    held = c >= 0
    r, c, k = rows[held], c[held], len(best)
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    scale = np.maximum(1.0, np.bincount(c, weights=weight[r], minlength=k) / n * 8)
    w, u, b = np.zeros(k), np.zeros(extra.shape[1]), 0.0
    # First, which words: what chance can do to a useless word's gradient keeps it out. Then their weights, without that penalty.
    for l1, l2, able in ((_L1 / np.sqrt(n), 0.0, None), (0.0, _L2, True)):
        able = np.ones(k) if able is None else (w != 0).astype(float)
        vw, vu, vb, t = w.copy(), u.copy(), b, 1.0
        for _ in range(_STEPS):  # accelerated proximal gradient, steps scaled by how common a word is
            m = np.bincount(r, weights=vw[c], minlength=n) + extra @ vu + vb
            g = weight * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) / n
            step = 10.0 / scale
            nw = vw - step * (np.bincount(c, weights=g[r], minlength=k) + l2 * vw)
            nw = able * np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
            nu, nb = vu - 0.05 * (extra.T @ g), vb - 1.0 * g.sum()
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            a = (t - 1) / t2
            vw, vu, vb = nw + a * (nw - w), nu + a * (nu - u), nb + a * (nb - b)
            w, u, b, t = nw, nu, nb, t2
    used = w != 0
    return {"words": best[used], "w": w[used], "u": u, "b": float(b)}


def _score(model: dict, rows: np.ndarray, feats: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
    m = extra @ model["u"] + model["b"]
    if len(model["words"]):
        i = np.minimum(np.searchsorted(model["words"], feats), len(model["words"]) - 1)
        hit = model["words"][i] == feats
        m = m + np.bincount(rows[hit], weights=model["w"][i[hit]], minlength=n)
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit_chain(own: list[np.ndarray], y: np.ndarray, folds: np.ndarray) -> list[dict]:
    """One model per column of y, from each row's distinct hashes; column j's model gets out-of-fold probabilities of the columns before it."""
    flat = np.sort(np.concatenate([*own, np.zeros(0, np.uint64)]))
    at = np.flatnonzero(np.concatenate((flat[:1] == flat[:1], flat[1:] != flat[:-1])))
    vocab = flat[at[np.diff(np.concatenate((at, [len(flat)]))) >= min(LEAST, max(len(own), 1))]]
    del flat, at
    coded = []
    for x in own:  # words in fewer rows than LEAST could not be learnt from
        i = np.searchsorted(vocab, x)
        i[i == len(vocab)] = 0
        coded.append(i[vocab[i] == x].astype(np.int32) if len(vocab) else np.zeros(0, np.int32))
    rows = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in coded])
    codes = np.concatenate([*coded, np.zeros(0, np.int32)])
    del coded
    n, size, extra, chain = len(y), len(vocab), np.zeros((len(y), 0)), []
    for j in range(y.shape[1]):
        chain.append(_fit_linear(rows, codes, size, n, extra, y[:, j]))
        oof = np.zeros(n)
        for f in range(FOLDS if j + 1 < y.shape[1] else 0):
            test = folds == f
            number = (np.cumsum(~test) - 1).astype(np.int32)
            inside = ~test[rows]
            part = _fit_linear(number[rows[inside]], codes[inside], size, int((~test).sum()), extra[~test], y[~test, j])
            number = np.cumsum(test) - 1
            inside = ~inside
            oof[test] = _score(part, number[rows[inside]], codes[inside], int(test.sum()), extra[test])
        extra = np.column_stack([extra, oof])
    for model in chain:
        model["words"] = vocab[model["words"]]
    return chain


def run_chain(chain: list[dict], rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
    extra = np.zeros((n, 0))
    for model in chain:
        extra = np.column_stack([extra, _score(model, rows, feats, n, extra)])
    return extra


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) for the distinct words of each text."""
    h, at = words(texts, HEADS)
    own = [np.unique(h[a:b].reshape(-1)) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own) if own else np.zeros(0, np.uint64)


def train(docs: DataFrame, labels: DataFrame, targets: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Fits a chain for `targets` (category: SQL condition on a row of labels), in one task on at most TRAIN_ROWS labelled documents."""
    names = list(targets)
    known = labels.select(F.col(id_col).alias("_id"), *[F.expr(targets[c]).cast("int").alias(f"_y{j}") for j, c in enumerate(names)]).dropna()
    known = known.groupBy("_id").agg(*[F.max(f"_y{j}").alias(f"_y{j}") for j in range(len(names))])
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)  # bounded: may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")

    def features(batches):
        for batch, texts in portions(batches, "_text"):
            r, f = _pairs(texts)
            cut_at = np.searchsorted(r, np.arange(1, len(texts)))
            blobs = [x.tobytes() for x in np.split(f, cut_at)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), pa.array(blobs, pa.binary()), *[batch.column(f"_y{j}") for j in range(len(names))]], names=["_id", "words", *[f"_y{j}" for j in range(len(names))]])

    def fit(table: pa.Table) -> pa.Table:
        import pickle

        table = table.sort_by([("_id", "ascending"), ("words", "ascending")])
        own = [np.frombuffer(b, np.uint64) for b in table.column("words").to_pylist()]
        y = np.column_stack([table.column(f"_y{j}").to_numpy().astype(float) for j in range(len(names))])
        del table
        chain = fit_chain(own, y, np.arange(len(own)) % FOLDS)
        return pa.table({"model": pa.array([pickle.dumps(chain)], pa.binary())})

    kinds = "_id string, words binary, " + ", ".join(f"_y{j} int" for j in range(len(names)))
    import pickle

    got = rows.mapInArrow(features, kinds).withColumn("all", F.lit(1)).groupBy("all").applyInArrow(fit, "model binary").collect()
    if got:
        return pickle.loads(bytes(got[0][0]))  # noqa: S301 - made by `fit` just above
    return fit_chain([], np.zeros((0, len(names))), np.zeros(0, np.int64))


def classify(docs: DataFrame, chain: list[dict], names: list[str], text_col: str = "text") -> DataFrame:
    """`docs` with a double p_<name> for each category, from whole texts. Null and empty texts get the models' intercepts; columns of docs that are so named already are replaced."""
    docs = docs.drop(*[f"p_{c}" for c in names])
    schema = docs.withColumns({f"p_{c}": F.lit(0.0) for c in names}).schema

    def run(batches):
        for batch, texts in portions(batches, text_col):
            r, f = _pairs(texts)
            p = run_chain(chain, r, f, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, j]) for j in range(len(names))]], names=[*batch.schema.names, *[f"p_{c}" for c in names]])

    return docs.mapInArrow(run, schema)
