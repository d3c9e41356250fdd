"""All queries over the driver tables, and their SQL."""

from __future__ import annotations

from .plans import composite, desk, expressions, newsroom, relational, reports, special
from .sources.tables import duck_sql, run_sql

_WORDS = {"spark": "split(lower(text), '[^a-z]+')", "duck": "string_split_regex(lower(text), '[^a-z]+')"}
_MARKS = {
    "explode_words": {"spark": f"explode({_WORDS['spark']})", "duck": f"unnest({_WORDS['duck']})"},
    "explode_distinct_words": {"spark": f"explode(array_distinct({_WORDS['spark']}))", "duck": f"unnest(list_distinct({_WORDS['duck']}))"},
    "has_word": {"spark": "lower(text) RLIKE '[a-z]'", "duck": "regexp_matches(lower(text), '[a-z]')"},
} | reports.MARKS
_BODIES = relational.BODIES | reports.BODIES


def _fill(body: str, engine: str) -> str:
    for mark, forms in _MARKS.items():
        body = body.replace("{" + mark + "}", forms[engine])
    return body


QUERIES = {k: (lambda spark, sf_dir, body=_fill(v, "spark"): run_sql(spark, sf_dir, body)) for k, v in _BODIES.items()} | expressions.QUERIES | special.QUERIES | composite.QUERIES | desk.QUERIES | newsroom.QUERIES
ORACLES = {k: duck_sql(_fill(v, "duck")) for k, v in _BODIES.items()} | expressions.ORACLES | special.ORACLES | composite.ORACLES | desk.ORACLES | newsroom.ORACLES
