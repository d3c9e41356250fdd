"""Two versions of a wording side by side: the words that one has and the other doesn't."""

from __future__ import annotations

import difflib
import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: What is no part of a word when two are compared.
_EDGE = ".,;:!?“”\"'"


def _plain(text: str) -> list[str]:
    return [w.lower().strip(_EDGE) for w in text.split()]


def matching(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Blocks (start in a, start in b, length) of the longest common run and, recursively, of what is before and after it."""
    return [tuple(m) for m in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks() if m.size]


def marked(text: str | None, other: str | None, opening: str = "<mark>", closing: str = "</mark>") -> str:
    """`text` with its words escaped for a page, those that `other` has not between marks; null counts as empty."""
    words = (text or "").split()
    kept = {i for a, _, n in matching(_plain(text or ""), _plain(other or "")) for i in range(a, a + n)}
    return " ".join(html.escape(w, quote=True) if i in kept else f"{opening}{html.escape(w, quote=True)}{closing}" for i, w in enumerate(words))


def word_diff(text: Column, other: Column) -> Column:
    """marked(text, other), Arrow batch by batch."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([marked(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(text, other)
