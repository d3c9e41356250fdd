"""Row-to-rows extraction from text: sentences, figures, quotes, names, roles. Each is a plain function over one text, and an Arrow-batched table function around it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Number words, scales, casualty states, currencies, units of time, persons and money, what stands before an age, nouns that are not counted, stop words, reporting verbs, titles.
NUMBERS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "dozen": 12,
}
SCALES = {"hundred": 1e2, "thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12}
STATES = {
    "dead": ["killed", "kill", "dead", "death", "deaths", "died", "die", "toll", "fatalities", "fatality", "casualties", "casualty", "perished"],
    "missing": ["missing", "unaccounted"],
    "injured": ["injured", "wounded", "hurt"],
    "displaced": ["displaced", "homeless"],
    "arrested": ["arrested", "detained"],
    "rescued": ["rescued", "evacuated"],
}
CURRENCIES = {"$": "USD", "us$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "sh": "KES", "ksh": "KES", "kes": "KES"}
TIMES = ["hour", "day", "week", "month", "year"]
PERSONS = {
    "people", "person", "persons", "resident", "residents", "leader", "leaders", "worker", "workers", "trader", "traders", "student", "students", "voter", "voters",
    "delegate", "delegates", "teacher", "teachers", "farmer", "farmers", "officer", "officers", "patient", "patients", "family", "families", "household", "households",
    "refugee", "refugees", "passenger", "passengers", "victim", "victims", "survivor", "survivors", "civilian", "civilians",
}
MONEY = {
    "investment", "investments", "funding", "budget", "budgets", "revenue", "worth", "cost", "costs", "fdi", "capital", "loan", "loans", "debt", "refund", "aid",
    "grant", "grants", "profit", "turnover", "sales", "salary", "salaries", "wage", "wages", "allocation", "bailout",
}
AGES = r"\b(?:aged|age of|at the age of|died at|dies at|was)\s*$"
UNCOUNTED = {"time", "way", "part", "number", "total", "case", "point", "kind", "sort", "lot", "bit", "end", "side", "level", "rate", "value", "result", "figure", "one", "other", "same", "such", "own", "half", "third", "quarter"}
STOPPED = {
    "the", "a", "an", "and", "or", "but", "of", "in", "on", "at", "to", "for", "from", "with", "by", "as", "is", "are", "was", "were", "be", "been", "has", "have", "had", "that", "this",
    "these", "those", "it", "its", "their", "his", "her", "they", "them", "than", "then", "there", "over", "under", "after", "before", "into", "about", "more", "most", "least", "some",
    "new", "now", "across", "within", "during", "through", "near", "around", "between", "among", "since", "until", "against", "per", "each", "every", "another", "also", "will", "would",
    "can", "could", "may", "still", "yet", "not", "said", "says", "say", "told", "confirmed", "announced", "reported", "according", "shows", "showed", "show", "data", "report", "reports",
    "gives", "give", "given", "gave", "reached", "reach", "rose", "stood", "raised", "remain", "remains", "remained", "added", "noted", "revealed",
}
SPEAKING = ["said", "says", "told", "stated", "added", "argued", "claimed", "denied", "warned", "noted", "explained", "insisted"]
TITLES = ["president", "deputy president", "minister", "senator", "governor", "mp", "dr", "prof", "mr", "mrs", "ms", "judge", "pastor"]
PARTICLES = ["ole", "arap", "wa", "bin", "binti", "de", "van"]
FURNITURE = re.compile(r"^(read also|read more|advertisement|share this|subscribe|photo:|follow us)", re.I)

_FIGURE = re.compile(
    r"(?:(?P<cur>us\$|[$€£]|\b(?:usd|eur|gbp|ksh|kes|sh)\.?\s*)|(?<![\w.,]))(?P<num>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\b(?:" + "|".join(NUMBERS) + r")\b)"
    r"(?:\s*(?P<scale>" + "|".join(SCALES) + r")\b)?(?:(?P<pct>\s*(?:%|per\s?cent\b|percent\b))|(?P<after>\s*(?:usd|eur|gbp|ksh|kes)\b))?",
    re.I,
)
_WORD = re.compile(r"[A-Za-z][A-Za-z'-]*")
_QUOTE = re.compile(r"[\"“]([^\"“”]+)[\"”]|(?<![\w'])['‘]([^'‘’]+(?:['’]\w[^'‘’]*)*)['’](?!\w)")
_NAME = r"[A-Z][\w'-]+(?:\s+(?:(?:" + "|".join(PARTICLES) + r")\s+)?[A-Z][\w'-]+){0,3}"
_SENTENCE = re.compile(r"(?<=[.!?])[\"”']?\s+(?=[A-Z\"“'])|\n+")


def sentences(text: str | None) -> list[tuple[int, str]]:
    """(start, sentence)."""
    out, at = [], 0
    for m in [*_SENTENCE.finditer(text or ""), None]:
        end = m.start() if m else len(text or "")
        s = (text or "")[at:end].strip()
        if s:
            out.append((at, s))
        at = m.end() if m else end
    return out


def claims(text: str | None, most: int = 8) -> list[dict]:
    """Sentences worth comparing: 40 characters or more, no table row or furniture, with a number in digits or words; each with its neighbours (600 characters)."""
    all_ = [s for _, s in sentences((text or "")[:20_000]) if not FURNITURE.match(s)]
    hits = [i for i, s in enumerate(all_) if len(s) >= 40 and not (s.startswith("|") and s.endswith("|")) and _FIGURE.search(s)]
    return [{"pos": i, "claim": all_[i], "context": " ".join(all_[max(0, i - 1) : i + 2])[:600]} for i in hits[:most]]


def state_of(text: str) -> str | None:
    """The casualty state a text names, if it is just one."""
    words = set(w.lower() for w in _WORD.findall(text))
    found = [s for s, names in STATES.items() if words & set(names)]
    return found[0] if len(found) == 1 else None


#: What a word beside a number says that it counts.
_UNITS = {w: (f"{t}s", None) for t in TIMES for w in (t, f"{t}s")} | dict.fromkeys(["percent", "per", "cent", "%"], ("percent", None)) | dict.fromkeys(MONEY, ("currency", None)) | dict.fromkeys(PERSONS, ("people", None)) | {w: ("people", state) for state, names in STATES.items() for w in names}


def singular(word: str) -> str:
    for tail, cut_, put in (("ies", 3, "y"), ("ses", 2, ""), ("xes", 2, ""), ("zes", 2, ""), ("ches", 2, ""), ("shes", 2, "")):
        if word.endswith(tail) and (tail != "ies" or len(word) > 4):
            return word[:-cut_] + put
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def _near_unit(words: list[str]) -> tuple[str | None, str | None, str | None]:
    """(unit, word, state) by the first word that has one; persons take a state named further on."""
    at = next((i for i, w in enumerate(words) if w in _UNITS), None)
    if at is None:
        return None, None, None
    unit, state = _UNITS[words[at]]
    if words[at] in PERSONS:
        state = next((_UNITS[w][1] for w in words[at + 1 :] if w in _UNITS and _UNITS[w][1]), None)
    return unit, None if state and words[at] not in PERSONS else words[at], state


def _counted(words: list[str]) -> str | None:
    """The noun that ends the run of plain words after a number."""
    span = []
    for w in words[:4]:
        if w in STOPPED or w in SCALES or w in UNCOUNTED or len(w) < 3 or not w.isalpha():
            break
        span.append(w)
    return singular(span[-1]) if span else None


def figures(sentence: str | None) -> list[dict]:
    """Figures with value, unit, state, currency, the word that is the unit, and offsets. Years, ages and digits glued to letters are none.

    The unit is percent or money where the figure says so, else what the nearest word says, up to the next number, then
    from the last number on; of a scaled number it is money, else the noun counted."""
    s = sentence or ""
    marks = [m for m in _FIGURE.finditer(s) if not (m.end("num") < len(s) and s[m.end("num")].isalpha() and m["num"][-1].isdigit() and not m["scale"] and not m["after"])]
    out = []
    for k, m in enumerate(marks):
        raw, bare = m["num"].lower(), not (m["scale"] or m["pct"] or m["cur"] or m["after"])
        value = float(NUMBERS[raw]) if raw in NUMBERS else float(raw.replace(",", ""))
        cur = CURRENCIES.get((m["cur"] or m["after"] or "").lower().strip(" ."))
        if bare and re.fullmatch(r"(19|20)\d\d|2100", raw):
            continue
        after = s[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(s)]
        before = s[max(marks[k - 1].end() if k else 0, m.start() - 60) : m.start()]
        if bare and (re.match(r"[- ]?years?[- ]old|,? aged\b", after.strip(), re.I) or re.search(AGES, s[max(0, m.start() - 24) : m.start()], re.I)):
            continue
        value *= SCALES.get((m["scale"] or "").lower(), 1)
        words = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z'-]*|%", after)]
        if m["pct"] or cur:
            unit, word, state = ("percent" if m["pct"] else "currency"), None, None
        else:
            unit, word, state = _near_unit(words)
            if not unit:
                unit, word, state = _near_unit([w.lower() for w in re.findall(r"[A-Za-z][A-Za-z'-]*|%", before)][::-1])
            if not unit and m["scale"] and len(m["scale"]) > 1:
                unit = "currency"
            if not unit:
                unit = word = _counted(words)
            if unit == "people":
                state = state or state_of(s)
        out.append({"value": value, "unit": unit, "state": state, "currency": cur, "word": word, "start": m.start("num"), "end": m.end()})
    return out


def subject(text: str | None, word: str | None = None) -> dict:
    """What a figure is about: tokens (plain words of the sentence, singular, without the figure's own unit word), acronyms (initials of three or four of them in a row), upper (words written in capitals)."""
    drop = STOPPED | set(SCALES) | {w for w, (unit, state) in _UNITS.items() if unit in ("percent", "people") or w.rstrip("s") in TIMES}
    plain = [w for w in _WORD.findall(text or "") if len(w) >= 3 and w.lower() not in drop]
    stems = [singular(w.lower()) for w in plain]
    initials = {"".join(w[0] for w in stems[i : i + n]) for n in (3, 4) for i in range(len(stems) - n + 1)}
    return {"tokens": sorted(set(stems) - {singular(word) if word else ""}), "acronyms": sorted(initials), "upper": sorted({w.lower() for w in plain if w.isupper()})}


def quotes(text: str | None) -> list[dict]:
    """Direct quotes of 4 words and 400 characters at most, with speaker, verb and how they were found: named, pronoun, continued or none."""
    t, out, last = text or "", [], None
    for m in _QUOTE.finditer(t):
        body = (m[1] or m[2]).strip()
        if len(body.split()) < 4 or len(body) > 400:
            continue
        tail, head = t[m.end() : m.end() + 120], t[max(0, m.start() - 120) : m.start()]
        verbs = "|".join(SPEAKING)
        hit = re.match(rf"[,.]?\s*(?:(?P<v>{verbs})\s+(?P<n>{_NAME})|(?P<n2>{_NAME})\s+(?P<v2>{verbs}))", tail) or re.search(rf"(?P<n>{_NAME})\s+(?P<v>{verbs})[^.]{{0,40}}[,:]?\s*$", head) or re.search(rf"[Aa]ccording to\s+(?P<n>{_NAME})(?P<v>),?\s*$", head)
        speaker = verb = None
        how = "none"
        if hit:
            g = hit.groupdict()
            speaker, verb, how = g.get("n") or g.get("n2"), g.get("v") or g.get("v2") or "according to", "named"
        elif re.match(rf"[,.]?\s*(?:he|she|they)\s+(?:{verbs})|[,.]?\s*(?:{verbs})\s+(?:he|she|they)", tail, re.I) and last:
            speaker, how = last, "pronoun"
        elif last and not t[: m.start()].rstrip().endswith((".", "!", "?")) and not re.search(r"[A-Za-z]", tail[:3]) and out and m.start() - out[-1]["end"] < 40:
            speaker, how = last, "continued"
        if speaker in ("He", "She", "They", "The", "It"):
            speaker, how = last, "pronoun" if last else "none"
        last = speaker or last
        out.append({"quote": body, "speaker": speaker, "verb": verb, "how": how, "start": m.start(), "end": m.end()})
    return out


def names(text: str | None, gazetteer: dict[str, tuple[str, str]]) -> list[dict]:
    """Listed surfaces (longest first) and titled names: text, label, id, start, end. A titled name isn't read in Title Case text."""
    t, out, taken = text or "", [], set()
    if gazetteer:
        listed = re.compile(r"(?<!\w)(" + "|".join(re.escape(g).replace("'", "['’]?") for g in sorted(gazetteer, key=len, reverse=True)) + r")(?!\w)", re.I)
        fold = {re.sub("['’]", "", k).lower(): v for k, v in gazetteer.items()}
        for m in listed.finditer(t):
            label, id_ = fold[re.sub("['’]", "", m[0]).lower()]
            out.append({"text": m[0], "label": label, "id": id_, "start": m.start(), "end": m.end()})
            taken.update(range(m.start(), m.end()))
    words = re.findall(r"[A-Za-z']+", t)
    if not (len(words) > 3 and sum(w[0].isupper() for w in words) > 0.8 * len(words)):
        for m in re.finditer(r"\b(?:" + "|".join(x.title() for x in TITLES) + rf")\.?\s+({_NAME})", t):
            if not taken & set(range(m.start(1), m.end(1))):
                out.append({"text": m[1], "label": "PERSON", "id": None, "start": m.start(1), "end": m.end(1)})
    return sorted(out, key=lambda e: e["start"])


def role(text: str, person: str) -> dict | None:
    """How a text presents a person, by pattern: speaks, acts, acted on, spoken about, described or mentioned. A parser backend may do better."""
    p = re.escape(person)
    if not re.search(rf"(?<!\w){p}(?!\w)", text, re.I):
        return None
    verbs = "|".join(SPEAKING)
    rules: list[tuple[str, str]] = [
        ("speaks", rf"^{p}\s*:|{p}(?:,[^,]*,)?\s+(?P<v>{verbs})\b|\b(?P<v2>{verbs})\s+{p}|[Aa]ccording to {p}|^{p} to \w+:"),
        ("acted on", rf"{p}\s+(?:was|were|is|has been|been)\s+(?P<v>\w+ed)\b|\b(?P<v2>\w+(?:ed|s))\s+{p}\s*$"),
        ("spoken about", rf"(?:{verbs})\s+(?:that\s+)?{p}\s+\w+"),
        ("described", rf"{p}\s+(?:is|was)\s+(?:a|an|the)\b"),
        ("acts", rf"{p}\s+(?P<v>\w+(?:s|ed))\b"),
    ]
    for name, pattern in rules:
        m = re.search(pattern, text, re.I if name != "acts" else 0)
        if m:
            g = {k: v for k, v in m.groupdict().items() if v}
            return {"role": name, "verb": next(iter(g.values()), None)}
    return {"role": "mentioned", "verb": None}


def table_function(rows: DataFrame, column: str, fn: Callable[[str | None], list[dict]], fields: str, keys: list[str]) -> DataFrame:
    """Explodes fn(column) per row, Arrow batch by batch; keys are kept."""
    names_ = [f.split()[0] for f in fields.split(", ")]
    types = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(*k, *(r[n] for n in names_)) for *k, text in pdf[[*keys, column]].itertuples(index=False, name=None) for r in fn(text)]
            yield pd.DataFrame(out, columns=[*keys, *names_])

    return rows.select(*keys, column).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), fields]))
