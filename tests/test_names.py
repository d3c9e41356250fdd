"""Gazetteer, conflicts, word diff and the external scorer."""

import random
import re
import sys

import pytest

from storyweft.operators import external, names, people, wording
from storyweft.operators.names import Span

KIND = "surface string, label string, id string, name string, case_sensitive boolean"


def _naive(text, entries):
    """Every surface by itself, then the rule for overlaps, word by word."""
    hits = set()
    for surface, label, id_, exact in entries:
        for form in names.spelled(surface):
            for m in re.finditer(f"(?=({re.escape(form)}))", text, 0 if exact else re.I):
                a, b = m.span(1)
                word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
                if not (word(a - 1) and word(a)) and not (word(b) and word(b - 1)):
                    hits.add((a, b, label, id_))
    out = []
    for h in sorted(hits, key=lambda h: (-len(text[h[0] : h[1]].split()), h[0], -h[1])):
        if all(h[1] <= o[0] or o[1] <= h[0] for o in out):
            out.append(h)
    return sorted(out)


def test_ten_thousand_names_equal_a_search_for_each(spark):
    rng = random.Random(2)
    syllables = ["ka", "ma", "ng'a", "ro", "wé", "tu", "li", "Ö"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))).capitalize()
    entries = {}
    while len(entries) < 10_000:
        entries.setdefault(" ".join(word() for _ in range(rng.randint(1, 3))), (rng.choice(["PERSON", "ORG", "GPE"]), f"i{len(entries)}", False))
    # One spelling, one entry: forms without an apostrophe may fall together.
    seen, rows = set(), []
    for s, (label, i, exact) in entries.items():
        forms = {f.lower() for f in names.spelled(s)}
        if not forms & seen:
            seen |= forms
            rows.append((s, label, i, exact))
    exact = [("Kerio", "GPE", "kerio", True), ("IT", "ORG", "it", True)]
    rows += exact
    texts = [" ".join(rng.choice([rng.choice(rows)[0], rng.choice(rows)[0].upper(), rng.choice(rows)[0].replace("'", "’"), "and", "kerio Kerio it IT", "x" + rng.choice(rows)[0]]) for _ in range(8)) + rng.choice(["", ".", "’s"]) for _ in range(12)]
    auto = names.automaton(rows)
    for t in texts:
        near = [r for r in rows if any(f.lower() in t.lower() for f in names.spelled(r[0]))]
        assert [tuple(s) for s in names.listed(t, auto)] == _naive(t, near)
    gazetteer = spark.createDataFrame([(s, label, i, s, e) for s, label, i, e in rows] + [(" ", "ORG", None, None, None), (None, "ORG", None, None, True)], KIND)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "")], "doc_id long, text string")
    got = names.mentions(docs, "text", ["doc_id"], gazetteer, model=None, titles=False).collect()
    want = [(i, t[s.start : s.end], s.label, s.id, s.start, s.end) for i, t in enumerate(texts) for s in names.listed(t, auto)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40


def _settled(text, entries, model=None, titles=True):
    words = {}
    for surface, _, i, _ in entries:
        words.setdefault(i, set()).update(surface.lower().split())
    spans = names.settle(text, names.listed(text, names.automaton(entries)), names.guessed(text) if model is None else model, names.titled(text) if titles else [], lambda i: words.get(i, set()))
    return [(text[s.start : s.end], s.label, s.id) for s in spans]


PEOPLE = [("Rigathi Gachagua", "PERSON", "gachagua", False), ("Gachagua", "PERSON", "gachagua", False), ("Kithure Kindiki", "PERSON", "kindiki", False), ("Kindiki", "PERSON", "kindiki", False), ("Abraham Kithure Kindiki", "PERSON", "kindiki", False)]


def test_conflicts_are_settled_by_rule():
    assert _settled("He met Rigathi Gachagua today", PEOPLE) == [("Rigathi Gachagua", "PERSON", "gachagua")]
    # A longer name around a listed one is the person, but not that person unless all its words are.
    assert _settled("late Nderitu Gachagua of Nyeri", PEOPLE, titles=False) == [("Nderitu Gachagua", "PERSON", None)]
    assert _settled("then Abraham Kindiki spoke", PEOPLE, titles=False) == [("Abraham Kindiki", "PERSON", "kindiki")]
    # A place that a model reads longer by a word of a place keeps its extent; other additions give way to the list.
    places = [("Isiolo", "GPE", "isiolo", False), ("Nairobi", "GPE", "nairobi", False)]
    assert _settled("in Isiolo County now", places, [Span(3, 16, "GPE", None)], False) == [("Isiolo County", "GPE", None)]
    assert _settled("in Nairobi Talks now", places, [Span(3, 16, "ORG", None)], False) == [("Nairobi", "GPE", "nairobi")]
    # The model's span across two listed ones, neither of which it holds with detail only.
    assert _settled("Nairobi and Isiolo", places, [Span(0, 18, "ORG", None)], False) == [("Nairobi", "GPE", "nairobi"), ("Isiolo", "GPE", "isiolo")]


def test_titles():
    assert _settled("Governor Patrick ole Ntutu said so", []) == [("Patrick ole Ntutu", "PERSON", None)]
    assert _settled("the Senator Justice Ministry", [], []) == []
    assert _settled("Governor Begins Probe Into Land", [], []) == []
    assert _settled("then DR Congo and Dr Were met", [], []) == [("Were", "PERSON", None)]
    assert _settled("Governor Nderitu Gachagua went home", PEOPLE, []) == [("Nderitu Gachagua", "PERSON", None)]
    assert _settled("Deputy President Kithure Kindiki went", PEOPLE, []) == [("Kithure Kindiki", "PERSON", "kindiki")]
    assert _settled("Minister Jane Doe left", [("Jane Doe Party", "ORG", "j", False)], []) == [("Jane Doe", "PERSON", None)]


def test_identify(spark):
    rows = spark.createDataFrame([("Matiang'i", "PERSON", "matiangi", "Fred Matiang'i", False), ("Fred Matiang'i", "PERSON", "matiangi", "Fred Matiang'i", False), ("Nairobi", "GPE", "nairobi", "Nairobi", False)], KIND)
    typed = spark.createDataFrame([(" matiangi ",), ("FRED MATIANG’I",), ("Nairobi",), (None,)], "name string")
    assert sorted((str(r.name), r.id) for r in names.identify(typed, rows).collect()) == [(" matiangi ", "matiangi"), ("FRED MATIANG’I", "matiangi"), ("Nairobi", None), ("None", None)]


def _blocks(a, b):
    """Longest common run, then both sides of it: the first longest in a, then in b."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    i, j, n = best
    if not n:
        return set()
    return _blocks(a[:i], b[:j]) | set(range(i, i + n)) | {i + n + k for k in _blocks(a[i + n :], b[j + n :])}


def test_word_diff_equals_plain_python(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choice(["a", "B", "c,", "d<", "“e”", "f"]) for _ in range(rng.randint(0, 14))), " ".join(rng.choice(["A", "b", "c", "d<", "e", "g."]) for _ in range(rng.randint(0, 14)))) for _ in range(60)] + [(None, "a"), ("a", None), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.m for r in df.select("i", wording.word_diff(df["a"], df["b"]).alias("m")).collect()}
    strip = lambda t: [w.lower().strip(".,;:!?“”\"'") for w in (t or "").split()]
    esc = lambda w: w.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    for i, (a, b) in enumerate(pairs):
        kept = _blocks(strip(a), strip(b))
        assert got[i] == " ".join(esc(w) if k in kept else f"<mark>{esc(w)}</mark>" for k, w in enumerate((a or "").split()))


SCORER = """
import json, os, sys, time
for line in sys.stdin:
    q = json.loads(line)
    t = q["text"]
    if t == "hang": time.sleep(60)
    if t == "die": os._exit(3)
    if t == "junk": print("not json", flush=True); continue
    print(json.dumps({"id": q["id"] - 1, "score": -9}), flush=True)
    print(json.dumps({"id": q["id"], "score": len(t) / 10}), flush=True)
"""


def test_scorer_that_hangs_or_dies(spark, tmp_path):
    at = tmp_path / "scorer.py"
    at.write_text(SCORER)
    one = external.Scorer([sys.executable, str(at)], timeout=1.0, restarts=2, ready=20.0)
    assert one.score("abc") == (0.3, True) and one.score("die") == (None, False) and one.score("abcd") == (0.4, True)
    assert one.score("hang") == (None, False) and one.score("ab") == (0.2, True) and one.score("junk") == (None, False)
    assert one.score("ab") == (None, False)  # no start left
    one.close()
    assert external.Scorer(["/nonexistent/program"], restarts=0).score("x") == (None, False)


def test_scored_once_with_cache_and_fallback(spark, tmp_path):
    at = tmp_path / "scorer.py"
    at.write_text(SCORER)
    command = [sys.executable, str(at)]
    rows = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "die"), (4, None), (5, "abcdef"), (6, "known")], "id long, text string").repartition(1)
    import hashlib

    cache = spark.createDataFrame([(hashlib.sha256(b"known").hexdigest(), "v1", 7.0), (hashlib.sha256(b"abc").hexdigest(), "v0", 9.0)], "key string, version string, score double")
    out, new = external.scored(rows, "text", command, "v1", cache, fallback=lambda t: 0.0, timeout=5.0)
    got = {r.id: (r.score, r.scored_by) for r in out.collect()}
    assert got == {1: (0.3, "program"), 2: (0.3, "program"), 3: (0.0, "fallback"), 4: (None, "none"), 5: (0.6, "program"), 6: (7.0, "cache")}
    assert new.count() == 2
    again, none = external.scored(rows, "text", ["/nonexistent/program"], "v1", cache.unionByName(new), timeout=5.0)
    assert {r.id: r.scored_by for r in again.collect()} == {1: "cache", 2: "cache", 3: "none", 4: "none", 5: "cache", 6: "cache"} and none.count() == 0
    assert external.stamp(command) != external.stamp([*command, "--new"])


def test_empty_rows_and_a_gazetteer_too_large(spark, monkeypatch):
    empty = spark.createDataFrame([], "id long, text string")
    out, new = external.scored(empty, "text", ["/nonexistent/program"], "v1")
    assert out.count() == 0 and new.count() == 0
    gazetteer = spark.range(5).selectExpr("cast(id as string) surface", "'ORG' label", "cast(null as string) id", "false case_sensitive")
    assert names.mentions(empty, "text", ["id"], gazetteer).count() == 0
    monkeypatch.setattr(names, "MOST", 3)
    with pytest.raises(ValueError):
        names.mentions(empty, "text", ["id"], gazetteer)


def test_portrayal_from_text(spark):
    texts = [
        (1, "a", "Governor Jane Doe said the plan works. Later Jane Doe was arrested on Monday."), (2, "a", "Critics blame Governor Jane Doe"), (3, "b", "Doe is a lawyer. It was a great day for Doe."),
        (4, "b", None), (5, "b", "Nobody is named here."), (6, "a", "Minister Paul Kamau left."),
    ]
    listed = spark.createDataFrame([("Jane Doe", "PERSON", "doe", "Jane Doe", False), ("Doe", "PERSON", "doe", "Jane Doe", True), ("Monday", "GPE", None, "Monday", False)], KIND)
    found = people.person_mentions(spark.createDataFrame(texts, "article long, outlet string, text string"), listed)
    rows = sorted((r.article, r.person, r.role, r.title) for r in found.collect())
    assert rows == [(1, "doe", "acted on", None), (1, "doe", "speaks", "Governor"), (2, "doe", "acted on" if rows[2][2] == "acted on" else "mentioned", "Governor"), (3, "doe", "described", None), (3, "doe", "mentioned", None), (6, "paul kamau", rows[5][2], "Minister")]
    out = {(r.person, r.outlet): r for r in people.portrayal_of(found, least_articles=2, examples=1).collect()}
    a, b = out[("doe", "a")], out[("doe", "b")]
    assert set(out) == {("doe", "a"), ("doe", "b")} and (a.articles, a.mentions, a.speaks, a.title) == (2, 3, 1, "Governor")
    assert (b.described, b.mentioned, b.warm, b.title) == (1, 1, 1, None) and [e.role for e in b.examples] == ["described", "mentioned"]


def test_names_are_passed_on_as_they_are_found(spark):
    """One batch of texts with more names than a worker holds comes out in several, and none is lost."""
    import pyarrow as pa

    class Rows:
        sparkSession, dtypes = spark, [("doc_id", "bigint"), ("text", "string")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    listed = spark.createDataFrame([("Otieno", "PERSON", "o", None, True)], KIND)
    run = names.mentions(Rows(), "text", ["doc_id"], listed, model=None, titles=False)
    texts = ["Otieno " * 5000, None, "Otieno and Otieno", "none"] * 4
    out = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])))
    assert len(out) > 2 and max(len(b) for b in out) < 2 * names.HELD and sum(len(b) for b in out) == 4 * 5002
