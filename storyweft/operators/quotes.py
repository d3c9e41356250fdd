"""Direct quotes and who said them: one scan of a text from left to right, with state.

Quoted words are masked, so that only what stands around them is read. The scan meets people, reporting verbs with
their subjects, and quotes, in order; it keeps who was named with which titles, who spoke or acted, and who spoke last.
A pattern stands in for a parser: a subject is the name, pronoun, title or description next to a reporting verb.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from ..functions.text import ENGLISH, REPORTING, TITLES
from .extract import sentences
from .names import CASED_TITLES, PARTICLES, TITLES as NAME_TITLES

# Least words and most characters of a quote, words of a sentence after it that attributes it, sentences looked back for a person and for a speaker, words of a name of a thing, share of English, pronouns, irregular forms.
LEAST_WORDS, MOST_CHARS, AFTER, LOOK_BACK, CONTINUES, THING_WORDS, ENGLISH_SHARE = 4, 400, 12, 3, 2, 8, 0.15
PRONOUNS = {"he", "she", "i", "we"}
IRREGULAR = {"said": "say", "told": "tell", "spoke": "speak", "spoken": "speak", "wrote": "write", "written": "write", "took": "take", "taken": "take"}

_QUOTE = re.compile(r"“([^“”]{2,}?)”|\"([^\"]{2,}?)\"|(?:(?<=\s)|^)‘([^‘’]{2,}?)’(?=[\s,.:;!?]|$)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[^\w\s]")
_HELPERS = {"has", "had", "have", "also", "later", "then", "is", "was", "who", "further", "earlier", "yesterday", "today"}
_TITLE_WORDS = {w for t in [*NAME_TITLES, *TITLES, *TITLES.values(), *CASED_TITLES] for w in t.lower().split()} | {"former", "chairperson", "chair", "ceo", "mr", "mrs", "ms"}


def _forms() -> dict[str, list[tuple[str, str]]]:
    """Inflected first word -> (base phrase, rest) of every reporting verb, longer phrases first."""
    out: dict[str, list[tuple[str, str]]] = {}
    for phrase in (v for verbs in REPORTING.values() for v in verbs):
        base, _, rest = phrase.partition(" ")
        stem = base[:-1] if base.endswith("e") else base
        made = {base, base + "s", base + "es", stem + "ed", stem + "ing", base + base[-1] + "ed", base + base[-1] + "ing"}
        if base.endswith("y") and base[-2] not in "aeiou":
            made |= {base[:-1] + "ies", base[:-1] + "ied"}
        for f in made | {k for k, v in IRREGULAR.items() if v == base}:
            out.setdefault(f, []).append((phrase, rest))
    return {f: sorted(set(p), key=lambda x: -len(x[1])) for f, p in out.items()}


FORMS = _forms()


class Person(NamedTuple):
    at: int
    sentence: int
    name: str
    titles: frozenset
    rank: int  # 0: spoke, 1: acted, 2: was named


class Said(NamedTuple):
    at: int
    end: int
    sentence: int
    kind: str  # named, pronoun, title, described
    who: str
    titles: frozenset
    verb: str


def _full(words: list[str]) -> frozenset:
    """Title words, short ones written out."""
    return frozenset(x for w in words for x in TITLES.get(w.lower(), w.lower()).split()) - {"former", "the", "of"}


def names_a_thing(quote: str) -> bool:
    words = re.findall(r"[A-Za-z][A-Za-z'’-]*", quote)
    long_ = [w for w in words if len(w) > 3]
    return len(words) <= THING_WORDS and len(long_) >= 2 and all(w[0].isupper() for w in long_)


def language(quote: str) -> str:
    words = re.findall(r"[A-Za-z']+", quote.lower())
    return "en" if len(words) < LEAST_WORDS or sum(w in set(ENGLISH) for w in words) >= ENGLISH_SHARE * len(words) else "other"


class _Text:
    """Tokens of a masked text, their sentences, and the phrases around a token."""

    def __init__(self, masked: str):
        self.tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(masked)]
        self.starts = [a for a, _ in sentences(masked)] or [0]
        self.sizes = [0] * len(self.starts)
        self.of, s = [], 0
        for _, a, _ in self.tokens:
            while s + 1 < len(self.starts) and self.starts[s + 1] <= a:
                s += 1
            self.of.append(s)
            self.sizes[s] += 1

    def sentence(self, at: int) -> int:
        from bisect import bisect_right

        return max(0, bisect_right(self.starts, at) - 1)

    def word(self, i: int, s: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) and self.of[i] == s else ""

    def named(self, i: int, s: int) -> bool:
        w = self.word(i, s)
        return w[:1].isupper() and w.lower() not in _TITLE_WORDS | PRONOUNS and (len(w) > 1 or not w.isupper()) and w.lower() not in ENGLISH + ["according", "but", "when"] and not w.lower().endswith(("n't", "n’t"))

    def person(self, i: int, s: int) -> tuple[int, int, str, list[str]] | None:
        """(first, end, name, titles before it) of the name that token i is in."""
        if not self.named(i, s):
            return None
        a, b = i, i + 1
        while self.named(a - 1, s) or (self.word(a - 1, s) in PARTICLES and self.named(a - 2, s)):
            a -= 1
        while self.named(b, s) or (self.word(b, s) in PARTICLES and self.named(b + 1, s)):
            b += 1
        t = a
        while self.word(t - 1, s).lower() in _TITLE_WORDS or (self.word(t - 1, s) == "." and self.word(t - 2, s) in CASED_TITLES):
            t -= 1
        titles = [w for w, *_ in self.tokens[t:a] if w != "."]
        return a, b, " ".join(w for w, *_ in self.tokens[a:b]), titles

    def subject(self, i: int, step: int, s: int) -> tuple[str, str, frozenset, int] | None:
        """(kind, who, titles, token) of the subject that ends (step -1) or begins (step 1) at token i."""
        if step > 0 and self.word(i, s).lower() in ("the", "a"):
            i += 1
        while step > 0 and self.word(i, s).lower() in _TITLE_WORDS and (self.named(i + 1, s) or self.word(i + 1, s).lower() in _TITLE_WORDS):
            i += 1
        w = self.word(i, s)
        if w.lower() in PRONOUNS:
            return "pronoun", w, frozenset(), i
        if found := self.person(i, s):
            # A body, a title and then a name: the person, not the body.
            after = found[1]
            while step > 0 and self.word(after, s).lower() in _TITLE_WORDS:
                after += 1
            if after > found[1] and self.named(after, s):
                found = self.person(after, s)
            return "named", found[2], _full(found[3]), found[0]
        if w.lower() in _TITLE_WORDS:
            a, b = i, i + 1
            while self.word(a - 1, s).lower() in _TITLE_WORDS:
                a -= 1
            while step > 0 and self.word(b, s).lower() in _TITLE_WORDS:
                b += 1
            return "title", w, _full([x for x, *_ in self.tokens[a:b]]), a
        if w.isalpha() and w.islower() and w not in _HELPERS:
            a = i
            while step < 0 and i - a < 4 and self.word(a - 1, s).isalpha() and (self.word(a - 1, s).islower() or self.word(a - 1, s) == "The") and self.word(a, s).lower() != "the":
                a -= 1
            b = i + 1
            while step > 0 and b - i < 4 and self.word(b, s).isalpha() and self.word(b, s).islower():
                b += 1
            return "described", " ".join(x for x, *_ in self.tokens[a:b]), frozenset(), a
        return None


def _read(text: _Text) -> tuple[list[Person], list[Said]]:
    """People and reporting verbs with subjects, in order."""
    said: list[Said] = []
    spoke: set[int] = set()
    for i, (w, a, end) in enumerate(text.tokens):
        s, low = text.of[i], w.lower()
        if low == "according" and text.word(i + 1, s) == "to":
            found = text.subject(i + 2, 1, s)
            # A body before a name is what the person belongs to.
            j = i + 2
            while found and found[0] != "named" and j < i + 7 and text.word(j, s).isalpha() and not text.person(j, s):
                j += 1
            found = text.subject(j, 1, s) if found and found[0] != "named" and text.person(j, s) else found
            if found:
                said.append(Said(a, end, s, *found[:3], "according to"))
            continue
        phrase = next((p for p, rest in FORMS.get(low, []) if not rest or " ".join(text.word(i + k, s).lower() for k in range(1, 1 + len(rest.split()))) == rest), None)
        if phrase is None:
            continue
        j = i - 1
        while text.word(j, s).lower() in _HELPERS:
            j -= 1
        found = text.subject(j, -1, s)
        if (found is None or found[0] == "described") and text.word(j, s) in ("", ",", '"', "”", "’"):
            found = text.subject(i + 1, 1, s)
        if found:
            spoke.add(found[3])
            said.append(Said(a, end, s, *found[:3], phrase))
    people, i = [], 0
    while i < len(text.tokens):
        found = text.person(i, text.of[i])
        if found:
            first, end, name, titles = found
            after = text.word(end, text.of[i])
            rank = 0 if first in spoke else 1 if after.isalpha() and after.islower() and after not in ENGLISH else 2
            people.append(Person(text.tokens[first][1], text.of[i], name, _full(titles), rank))
            i = end
        else:
            i += 1
    return people, said


def extract_quotes(text: str | None) -> list[dict]:
    """Quotes of LEAST_WORDS or more, names of things left out: quote (MOST_CHARS of it), speaker, verb, how, language, start, end.

    how: named; pronoun (the subject is one, or a bare title: the nearest person of the last LOOK_BACK sentences, one who
    spoke before one who acted before one named); described; continued (no attribution of its own, and one spoke within
    CONTINUES sentences); none. Whole texts are read."""
    t = text or ""
    spans = [(m.start(), m.end(), (m[1] or m[2] or m[3]).strip()) for m in _QUOTE.finditer(t)]
    masked = list(t)
    for a, b, _ in spans:
        masked[a + 1 : b - 1] = "\0" * (b - a - 2)
        if t[b - 2] in ".!?":
            masked[b - 2] = t[b - 2]
    view = _Text("".join(masked))
    people, said = _read(view)

    def resolved(s: Said) -> tuple[str | None, str]:
        if s.kind in ("named", "described"):
            return s.who, s.kind
        near = [p for p in people if s.sentence - LOOK_BACK <= p.sentence and p.at < s.at and (s.kind == "pronoun" or p.titles == s.titles)]
        best = min(near, key=lambda p: (p.rank, -p.at), default=None)
        return (best.name, "pronoun") if best else (None, "none")

    out, held = [], []
    for a, b, quote in spans:
        if len(quote.split()) < LEAST_WORDS or names_a_thing(quote):
            continue
        here, last = view.sentence(a), view.sentence(b - 1)
        reach = [s for s in range(here, last + 1)]
        if last + 1 < len(view.starts) and view.sizes[last + 1] <= AFTER and view.starts[last + 1] >= b:
            reach.append(last + 1)
        if here and "".join(masked[: view.starts[here]]).rstrip().endswith(":"):
            reach.insert(0, here - 1)
        speaker = verb = None
        how = "none"
        for s in sorted((s for s in said if s.sentence in reach), key=lambda s: (reach.index(s.sentence), s.at)):
            speaker, found = resolved(s)
            if speaker:
                verb, how = s.verb, found
                break
        if speaker is None:
            floor = max(0, here - CONTINUES)
            before = [(end, who) for end, who in held if view.sentence(end) >= floor and end <= a]
            before += [(s.at, r[0]) for s in said if floor <= s.sentence <= here and s.at < a and (r := resolved(s))[0] and r[1] != "described"]
            if before:
                speaker, how = max(before, key=lambda x: x[0])[1], "continued"
        elif how != "described":
            held.append((b - 1, speaker))
        out.append({"quote": quote[:MOST_CHARS], "speaker": speaker, "verb": verb, "how": how, "language": language(quote), "start": a, "end": b})
    return out
