"""Fill-in-middle by escaped marker injection, in built-in functions only.

A delimiter is escaped in the text, then appended after every unit by regexp_replace. Counting it gives the number of
units, substring_index cuts the text at ranked delimiters, and the three parts are freed of it, unescaped and put
together in the order of the form. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import unused

#: A unit: a line with its break, or the last one without.
LINE = r"[^\n]*\n|[^\n]+"
#: What goes before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
_ESCAPE, _CUT = "\u0001", "\u0002"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _escaped(text: Column) -> Column:
    return _swap(_swap(text, _ESCAPE, _ESCAPE + "e"), _CUT, _ESCAPE + "c")


def _plain(part: Column) -> Column:
    """A part without delimiters, unescaped: the delimiter comes back first, as every escape left is then the escape itself."""
    return _swap(_swap(_swap(part, _CUT, ""), _ESCAPE + "c", _CUT), _ESCAPE + "e", _ESCAPE)


def _parts(text: Column, mark: str | Column, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark) if isinstance(mark, str) else mark, count.cast("int"))


def draws(id_column: Column, seed: int, n: int = 4) -> list[Column]:
    """`n` unsigned 32-bit numbers from the sha256 of `seed:id`; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def _check(markers: tuple[str, str, str]) -> None:
    """Markers can be found again only if none begins within or at the end of another."""
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} may overlap")
    if len(set(markers)) < 3:
        raise ValueError("three different markers are needed")


def infill(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, unit: str = LINE, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, and n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    `rate` of a hundred texts are split, `spm` of a hundred of those put the suffix first; texts that hold a marker and
    empty ones stay plain. `unit` must match every character of a text, by itself or with others. Null text counts as
    empty; a null id is drawn as an empty one; repeated rows of one id are cut alike where their units are as many.
    Columns of `docs` named like a result are replaced by it. An empty table gives no rows.
    """
    _check(markers)
    p, s, m = (F.lit(x) for x in markers)
    text, marked, n, low, high, form = unused(docs.columns, "text", "marked", "units", "low", "high", "form")
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    held = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    held = held.withColumn(marked, F.regexp_replace(_escaped(F.col(text)), f"(?:{unit})", "$0" + _CUT))
    held = held.withColumn(n, F.length(marked) - F.length(_swap(F.col(marked), _CUT, "")))
    spots = h1 % (F.col(n) + 1), h2 % (F.col(n) + 1)
    held = held.withColumn(low, F.least(*spots)).withColumn(high, F.greatest(*spots))
    stays = (F.col(text) == "") | F.contains(F.col(text), p) | F.contains(F.col(text), s) | F.contains(F.col(text), m) | (h3 % 100 >= rate)
    held = held.withColumn(form, F.when(stays, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))
    # The marked text ends in a delimiter, so that its last parts are one more than its last units.
    first = _parts(F.col(marked), _CUT, F.col(high))
    parts = {
        "prefix": F.when(F.col(low) == 0, F.lit("")).otherwise(_parts(F.col(marked), _CUT, F.col(low))),
        "middle": F.when(F.col(low) == F.col(high), F.lit("")).otherwise(_parts(first, _CUT, F.col(low) - F.col(high))),
        "suffix": _parts(F.col(marked), _CUT, F.col(high) - F.col(n) - 1),
    }
    own = unused([*docs.columns, text, marked, n, low, high, form], *parts)
    for at, part in zip(own, parts.values(), strict=True):
        held = held.withColumn(at, F.when(F.col(form) != "plain", _plain(part)))
    a, b, c = (F.col(x) for x in own)
    output = F.when(F.col(form) == "plain", F.col(text)).when(F.col(form) == "psm", F.concat(p, a, s, c, m, b)).otherwise(F.concat(s, c, p, a, m, b))
    found = {"n": F.col(n).cast("long"), "form": F.col(form), "prefix": a, "middle": b, "suffix": c, "output": output}
    taken = {x.lower() for x in found}
    return held.select(*(F.col(x) for x in docs.columns if x.lower() not in taken), *(v.alias(k) for k, v in found.items()))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text an output was made of, from output and form alone: texts with markers of their own are plain, so each marker stands once."""
    p, s, m = markers
    one, last = F.lit(1), F.lit(-1)
    between = lambda a, b: _parts(_parts(output, b, one), a, last)
    middle = _parts(output, m, last)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
