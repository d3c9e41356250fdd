"""Names in text: a gazetteer of any size found by one automaton a worker, and the settling of spans that overlap.

The gazetteer's surfaces make an Aho-Corasick automaton, built once in each worker, that reads a text once however many
names there are. What several finders say of one place (the gazetteer, a model, titles) is settled by a sweep over
spans in order, by stated rules.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Words that make a longer place name the better one, particles within names, titles before names, titles matched only as written, capitalised words that are no names.
PLACES = {
    "county", "sub-county", "ward", "constituency", "town", "city", "estate", "road", "street", "avenue", "highway", "market", "cemetery", "stadium", "hospital", "school", "college",
    "university", "church", "mosque", "airport", "port", "prison", "station", "bridge", "dam", "forest", "park", "gardens", "refinery", "region", "gymnasium", "hall", "grounds", "centre",
    "center", "arena", "showground", "camp",
}
PARTICLES = {"ole", "arap", "wa", "bin", "binti"}
TITLES = ["president", "deputy president", "minister", "senator", "governor", "mp", "judge", "pastor", "justice", "bishop", "speaker"]
CASED_TITLES = ["Dr", "Prof", "Hon", "Rev"]
NO_NAMES = {
    "ministry", "department", "committee", "court", "commission", "council", "party", "house", "office", "service", "authority", "board", "fund", "bank", "university", "school", "hospital",
    "county", "government", "assembly", "senate", "police", "nominee", "nominees", "aspirant", "aspirants", "candidate", "candidates", "elect", "emeritus", "general", "secretary", "state",
    "national", "republic", "congo", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday",
    "wednesday", "thursday", "friday", "saturday", "sunday",
}

#: Surfaces of a gazetteer that a worker holds; a larger one is refused.
MOST = 2_000_000
#: Names that a worker holds before it passes them on.
HELD = 8192
_TITLE_WORDS = {w for t in TITLES for w in t.split()} | {t.lower() for t in CASED_TITLES}
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_TITLE = re.compile(r"(?<!\w)(?:(?i:" + "|".join(sorted(TITLES, key=len, reverse=True)) + ")|" + "|".join(CASED_TITLES) + r")\.?\s+")
_WORKER: dict[str, tuple] = {}


class Span(NamedTuple):
    start: int
    end: int
    label: str
    id: str | None


def spelled(surface: str) -> set[str]:
    """As outlets print a name: apostrophes straight, curly, or left out."""
    return {surface, surface.replace("’", "'"), surface.replace("'", "’"), surface.replace("’", "").replace("'", "")}


def _low(text: str) -> str:
    """Lower-cased, character by character, so that offsets hold."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(entries: list[tuple[str, str, str | None, bool]]) -> ahocorasick.Automaton:
    """Of (surface, label, id, case_sensitive); of entries with one surface the last by label and id holds, one with an id before one without."""
    auto, at = ahocorasick.Automaton(), {}
    for surface, label, id_, exact in sorted(entries, key=lambda e: (e[0], e[2] is not None, e[1], e[2] or "")):
        for form in spelled(surface.strip()):
            if form:
                at.setdefault(_low(form), {})[form if exact else None] = (label, id_)
    for low, forms in at.items():
        auto.add_word(low, (len(low), forms))
    auto.make_automaton()
    return auto


def listed(text: str, auto: ahocorasick.Automaton) -> list[Span]:
    """Listed names that stand as whole words; of overlapping ones that of most words, then the first, then the longest."""
    if not len(auto):
        return []
    found = []
    for last, (length, forms) in auto.iter(_low(text)):
        a, b = last + 1 - length, last + 1
        inner = (a and (text[a - 1].isalnum() or text[a - 1] == "_") and (text[a].isalnum() or text[a] == "_")) or (b < len(text) and (text[b].isalnum() or text[b] == "_") and (text[b - 1].isalnum() or text[b - 1] == "_"))
        entry = forms.get(text[a:b]) or forms.get(None)
        if entry and not inner:
            found.append(Span(a, b, *entry))
    return _apart(found, text)


def _apart(spans: list[Span], text: str) -> list[Span]:
    """Spans that don't overlap: those of most words first, then those that begin first, then the longest."""
    kept: list[Span] = []
    taken = bytearray(len(text) + 1)
    for s in sorted(spans, key=lambda s: (-len(text[s.start : s.end].split()), s.start, -s.end)):
        if not any(taken[s.start : s.end]):
            taken[s.start : s.end] = b"\1" * (s.end - s.start)
            kept.append(s)
    return sorted(kept)


def _name_word(word: str) -> bool:
    bare = re.sub("['’-]", "", word)
    return bare[:1].isupper() and bare[1:].islower() and word.lower() not in _TITLE_WORDS | NO_NAMES


def guessed(text: str) -> list[Span]:
    """What a model may find: runs of two capitalised words or more, particles among them, as organisations. Any other finder may take its place."""
    out, run = [], []
    for m in [*_TOKEN.finditer(text), None]:
        gap = run and (m is None or text[run[-1].end() : m.start()] != " ")
        if run and (gap or not (m[0][0].isupper() or m[0].lower() in PARTICLES)):
            while run and run[-1][0].lower() in PARTICLES:
                run.pop()
            if len(run) > 1:
                out.append(Span(run[0].start(), run[-1].end(), "ORG", None))
            run = []
        if m is not None and (m[0][0].isupper() or (run and m[0].lower() in PARTICLES)):
            run.append(m)
    return out


def titled(text: str, most: int = 4) -> list[Span]:
    """Names after a title: up to `most` words, particles taken in stride. Lines mostly in capitals' style are not read, as every word there looks like a name."""
    out = []
    for m in _TITLE.finditer(text):
        line = text[text.rfind("\n", 0, m.start()) + 1 : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
        words = re.findall(r"[A-Za-z]+", line)
        if len(words) > 3 and sum(w[0].isupper() for w in words) > 0.8 * len(words):
            continue
        held, at = [], m.end()
        while len(held) < most and (w := _TOKEN.match(text, at)) and (_name_word(w[0]) or (held and w[0].lower() in PARTICLES)):
            held.append(w)
            at = w.end() + 1 if text[w.end() : w.end() + 1] == " " else len(text)
        while held and held[-1][0].lower() in PARTICLES:
            held.pop()
        if held:
            out.append(Span(held[0].start(), held[-1].end(), "PERSON", None))
    return _apart(out, text)


def _beyond(text: str, outer: Span, inner: Span) -> list[str]:
    return [w[0] for a, b in ((outer.start, inner.start), (inner.end, outer.end)) for w in _TOKEN.finditer(text[a:b])]


def _untitled(text: str, span: Span) -> Span | None:
    """A span without the title words that it begins with; none if nothing else is left."""
    for w in _TOKEN.finditer(text[span.start : span.end]):
        if w[0].lower() not in _TITLE_WORDS:
            return span._replace(start=span.start + w.start())
    return None


def settle(text: str, found: list[Span], model: list[Span], named: list[Span], words_of: Callable[[str], set[str]]) -> list[Span]:
    """One list of spans that don't overlap, out of listed, model and titled ones.

    Titles are no part of the model's spans. A listed span drops the model's that it overlaps, unless the model's holds it whole and adds only words of a place,
    or, around a person, only words of a name: that is then the span, a person if the listed is one, with the listed
    identity if all its words are that person's. A titled name drops what isn't a person inside it; a listed person
    inside grows to it, under the same condition; otherwise it gives way.
    """

    def grown(outer: Span, inner: Span) -> Span:
        own = {w[0].lower() for w in _TOKEN.finditer(text[outer.start : outer.end])} - PARTICLES
        return outer._replace(label="PERSON", id=outer.id or (inner.id if inner.id and own <= words_of(inner.id) else None))

    def better(outer: Span, inner: Span) -> Span | None:
        extra = _beyond(text, outer, inner)
        if not (outer.start <= inner.start and inner.end <= outer.end and extra):
            return None
        if inner.label == "PERSON" and all(_name_word(w) or w.lower() in PARTICLES for w in extra):
            return grown(outer, inner)
        return outer if all(w.lower() in PLACES | {"the"} for w in extra) else None

    def swept(first: list[Span], second: list[Span], judge: Callable[[Span, list[Span]], Span | None]) -> list[Span]:
        """Both lists in order: a span of the second that meets some of the first is what `judge` makes of it, and takes their place, or goes."""
        out, drop = [], set()
        for s in second:
            met = [f for f in first if f.start < s.end and s.start < f.end]
            made = judge(s, met) if met else s
            if made is not None:
                out.append(made)
                drop.update(met)
        return sorted([f for f in first if f not in drop] + out)

    def beside_listed(s: Span, met: list[Span]) -> Span | None:
        for f in met:
            s = better(s, f) if s is not None else None
        return s

    def beside_all(s: Span, met: list[Span]) -> Span | None:
        inside = all(s.start <= f.start and f.end <= s.end for f in met)
        people = [f for f in met if f.label == "PERSON"]
        if not people:
            return s if inside else s._replace(end=met[0].end) if len(met) == 1 and met[0].start == s.start else None
        return grown(s, people[0]) if inside and len(met) == 1 and _beyond(text, s, people[0]) else None

    bare = [x for x in (_untitled(text, s) for s in model) if x is not None]
    return swept(swept(found, bare, beside_listed), named, beside_all)


def mentions(rows: DataFrame, column: str, keys: list[str], gazetteer: DataFrame, model: Callable[[str], list[Span]] | None = guessed, titles: bool = True) -> DataFrame:
    """keys, and text, label, id, start, end of every name in whole texts, in no order.

    gazetteer(surface, label, id, case_sensitive) is sent to the workers, MOST surfaces at most; its rows with a null or
    blank surface are left out. Without `model` and titles only listed names are found. Null texts have no names.
    """
    spark = rows.sparkSession
    listing = gazetteer.where("trim(surface) <> ''").select("surface", "label", "id", F.coalesce("case_sensitive", F.lit(False)).alias("exact")).distinct()
    entries = [tuple(r) for r in listing.limit(MOST + 1).collect()]
    if len(entries) > MOST:
        raise ValueError(f"a gazetteer of {MOST} surfaces at most")
    shared = spark.sparkContext.broadcast(entries)
    types, named, token = dict(rows.dtypes), titles, uuid.uuid4().hex

    def worker() -> tuple:
        if token not in _WORKER:
            _WORKER.clear()
            words: dict[str, set[str]] = {}
            for surface, _, id_, _ in shared.value:
                if id_:
                    words.setdefault(id_, set()).update(w[0].lower() for form in spelled(surface) for w in _TOKEN.finditer(form))
            _WORKER[token] = (automaton(shared.value), words)
        return _WORKER[token]

    names = [*keys, "text", "label", "id", "start", "end"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, words = worker()
        for batch in parts:
            kinds = [*(batch.schema.field(k).type for k in keys), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            # Texts are read one by one, and names go on as they are found: a batch of long texts is held once, its names never all at once.
            out: list[list] = [[] for _ in names]
            for i in range(len(batch)):
                text = batch.column(column)[i].as_py()
                if not text:
                    continue
                spans = listed(text, auto)
                if model or named:
                    spans = settle(text, spans, model(text) if model else [], titled(text) if named else [], lambda i: words.get(i, set()))
                k = [batch.column(c)[i].as_py() for c in keys]
                for a in range(0, len(spans), HELD):
                    for s in spans[a : a + HELD]:
                        for held, v in zip(out, (*k, text[s.start : s.end], s.label, s.id, s.start, s.end), strict=True):
                            held.append(v)
                    if len(out[0]) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)
                        out = [[] for _ in names]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return rows.select(*keys, column).mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "text string, label string, id string, start long, end long"]))


def identify(typed: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """typed(name) -> name, id, canonical: the person whose id, name or alias, in any spelling and case, was typed; null where none is. Of several, the least id."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "['’]", "")
    people = gazetteer.where("label = 'PERSON' and id is not null")
    keys = people.select(plain(F.col("surface")).alias("key"), "id", "name").unionByName(people.select(plain(F.col("id")).alias("key"), "id", "name"))
    best = keys.groupBy("key").agg(F.min(F.struct("id", "name")).alias("who"))
    return typed.withColumn("key", plain(F.col("name"))).join(best, "key", "left").select("name", F.col("who.id").alias("id"), F.col("who.name").alias("canonical"))
