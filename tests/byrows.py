"""Statistics over plain lists, which the operators are held against."""

import math

import numpy as np

from storyweft.operators.evalstats import CLASSES


def f1(gold: list[str], guess: list[str], classes=CLASSES) -> float:
    """Macro F1; a class without hits counts 0."""
    out = []
    for c in classes:
        tp = sum(g == c == p for g, p in zip(gold, guess, strict=True))
        wrong = sum((g == c) != (p == c) for g, p in zip(gold, guess, strict=True))
        out.append(2 * tp / (2 * tp + wrong) if tp else 0.0)
    return sum(out) / len(out)


def paired_bootstrap(gold: list[str], a: list[str], b: list[str], times: int = 5000, seed: int = 0) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of the difference in macro F1."""
    rng, n = np.random.default_rng(seed), len(gold)
    code = {c: i for i, c in enumerate(CLASSES)}
    g, x, y = (np.array([code[v] for v in z]) for z in (gold, a, b))

    def score(p: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at))
        for c in range(len(CLASSES)):
            tp = ((g[at] == c) & (p[at] == c)).sum(1)
            wrong = ((g[at] == c) != (p[at] == c)).sum(1)
            total += np.where(tp > 0, 2 * tp / np.maximum(2 * tp + wrong, 1), 0)
        return total / len(CLASSES)

    at = rng.integers(0, n, (times, n))
    low, high = np.percentile(score(x, at) - score(y, at), [2.5, 97.5])
    return float(low), float(high)


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p value of discordant counts."""
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def kappa(a: list[str], b: list[str], quadratic: bool = False, classes=CLASSES) -> float:
    k = {c: i for i, c in enumerate(classes)}
    m = np.zeros((len(classes),) * 2)
    for x, y in zip(a, b, strict=True):
        m[k[x], k[y]] += 1
    d = np.subtract.outer(np.arange(len(classes)), np.arange(len(classes)))
    w = d * d if quadratic else (d != 0)
    e = np.outer(m.sum(1), m.sum(0)) / max(m.sum(), 1)
    return 1 - (w * m).sum() / (w * e).sum() if (w * e).sum() else 1.0
