"""Scalar text functions as column expressions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Function words that Title Case capitalises, English function words, markers of running totals, reporting verbs by family, words of controversy, short titles, words of attribution, authorities, kinds of entities that can be framed, currencies.
FUNCTION_WORDS = [
    "a", "an", "the", "and", "or", "but", "nor", "of", "in", "on", "at", "to", "for", "with", "into", "onto", "over", "after", "from", "as", "by", "about", "amid",
    "against", "before", "between", "during", "under", "up", "out", "off", "is", "are", "was", "were", "be", "will", "his", "her", "their", "its", "this", "that",
    "who", "what", "why", "how", "not", "no", "than", "via", "per",
]
ENGLISH = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "this", "to", "was", "were", "which", "will", "with"]
CUMULATIVE = [
    "since", "so far", "to date", "this year", "last year", "nationally", "in total", "altogether", "annually", "cumulative", "year to date",
    "over the past", "already this", "between january", "each year", "across the two", "both countries", "combined", "in total across",
    "on both sides", "overall", "nationwide",
]
REPORTING = {
    "said": ["say", "tell", "state", "note", "add", "explain", "announce", "reveal", "respond", "reply", "react", "describe", "disclose", "confirm", "speak", "remark", "address", "write", "report", "affirm", "reaffirm", "reiterate", "stress", "emphasise", "emphasize", "recall", "acknowledge", "admit"],
    "claimed": ["claim", "allege", "insist", "maintain", "contend", "purport"],
    "promised or assured": ["assure", "reassure", "pledge", "promise", "vow"],
    "praised": ["hail", "laud", "praise", "commend", "congratulate", "thank", "applaud", "celebrate", "champion"],
    "criticised": ["slam", "blast", "criticise", "criticize", "castigate", "attack", "accuse", "blame", "condemn", "decry", "dismiss", "rubbish", "lash out", "hit back", "fire back", "hit out", "challenge", "censure", "fault", "rebuke", "mock", "ridicule", "taunt", "take aim", "take swipe", "take jibe", "take dig"],
    "denied or defended": ["deny", "defend", "refute", "reject", "dispute", "counter"],
    "urged or warned": ["urge", "call on", "call for", "appeal", "ask", "implore", "plead", "warn", "caution", "direct", "order", "demand", "threaten"],
}
CONTROVERSY = [
    "rows?", "disputes?", "disputed", "clash(?:es|ed)?", "protests?", "protesters", r"impeach\w*", "probes?", "probed", "scandals?", "petitions?", "arrest(?:s|ed)?", "murder(?:s|ed)?",
    "kill(?:s|ed|ings?)?", "crackdown", "ultimatum", "rift", "feud", "showdown", "war", "attacks?", "attacked", "standoff", "outcry", "backlash", "fraud", "corruption", "graft",
    "sack(?:s|ed)?", "suspend(?:s|ed)?", "ousts?", "ousted", "defy", "defies", "condemns?", "condemned", "demands?", "warns?", "threat(?:s|ens)?", "bans?", "banned", r"evict\w*",
    r"demoli\w*", "court", "charged", "accused", "controversy", "controversial", "uproar", "fury", "anger",
]
TITLES = {"dp": "deputy president", "cs": "cabinet secretary", "ps": "principal secretary", "cj": "chief justice", "ig": "inspector general", "ag": "attorney general"}
ATTRIBUTES = ["according to", "said", "says", "told", "reported by", "data from", "figures from", "revealed", "disclosed", "announced", "confirmed", "estimates?"]
AUTHORITIES = [
    "police", "court", "judiciary", "ministry", "government", "treasury", "parliament", "senate", "KNBS", "IEBC", "KNCHR", "EACC", "KRA", "CBK", "NTSA", "IPOA", "county", "officials?", "hospital", "morgue",
    "union", "commission", "authority", "regulator", "census", "survey", "poll", "audit", "report", "Red Cross", "UN", "(?-i:WHO)", "UNICEF", "World Bank", "IMF", "rights group", "watchdog",
]
FRAMED_TYPES = ["PERSON", "ORG", "GPE", "NORP", "LAW", "EVENT", "FAC", "PRODUCT"]
CURRENCY = {"$": "USD", "us$": "USD", "€": "EUR", "£": "GBP", "sh": "KES", "ksh": "KES", "kes": "KES"}


def _lits(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_text(s: Column) -> Column:
    """White space (any, Unicode) collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))


def title_key(s: Column) -> Column:
    """Lower-cased words without punctuation: titles that differ in nothing else have the same key."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_text(s)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def is_web_url(u: Column) -> Column:
    return F.coalesce(u.rlike(r"(?i)^https?://[^\s/]"), F.lit(False))


def canonical_url(u: Column) -> Column:
    """Without fragment and query."""
    return F.split_part(F.split_part(F.trim(u), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))


def identifier(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(canonical_url(url), F.lit("||"), title_key(title)), 256)


def embed_text(title: Column, body: Column, snippet: Column) -> Column:
    rest = F.when(F.coalesce(body, F.lit("")) != "", body).otherwise(F.coalesce(snippet, F.lit("")))
    return F.substring(F.trim(F.concat_ws(" ", title, rest)), 1, 1000)


def outlet_slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def site(u: Column) -> Column:
    return F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(u, F.lit("HOST")))


def strip_markup(s: Column) -> Column:
    """Tags (a last unclosed one too) and the commonest entities gone, white space collapsed."""
    out = F.regexp_replace(F.coalesce(s, F.lit("")), r"<[^>]*>|<[^>]*$", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(c))
    return clean_text(out)


def html_body(html: Column) -> Column:
    """Text of a page without scripts, styles and page furniture."""
    return strip_markup(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>", " "))


def readable_body(body: Column, least: int = 250) -> Column:
    """The body, or '' if it starts with a paywall notice or is too short."""
    wall = F.substring(body, 1, 400).rlike(r"(?i)subscribe to (read|continue)|subscribers only|log in to continue|premium content")
    return F.when(wall | (F.length(body) < least), "").otherwise(body)


def singular(w: Column) -> Column:
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(cut(3), F.lit("y")))
        .when(w.rlike("(ses|xes|zes|ches|shes)$"), cut(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), cut(1))
        .otherwise(w)
    )


def stem(w: Column) -> Column:
    """The first ending of ing, ed, es, s, e that leaves four letters is dropped."""
    out = F.when(F.lit(False), w)
    for end in ("ing", "ed", "es", "s", "e"):
        out = out.when(w.endswith(end) & (F.length(w) - len(end) >= 4), F.substring(w, F.lit(1), F.length(w) - len(end)))
    return out.otherwise(w)


def word_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"[a-z][a-z'-]*|%"), F.lit(0))


def currency_code(mark: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv]), F.lower(mark))


def is_cumulative(s: Column) -> Column:
    return F.lower(s).rlike("|".join(CUMULATIVE))


def verb_family(phrase: Column) -> Column:
    """The family of a verb's base form: of the whole phrase, else of its first two words, else of the first."""
    families = F.create_map(*[F.lit(x) for family, verbs in REPORTING.items() for v in verbs for x in (v, family)])
    words = F.split(F.lower(F.trim(phrase)), r"\s+")
    return F.coalesce(F.try_element_at(families, F.lower(F.trim(phrase))), F.try_element_at(families, F.array_join(F.slice(words, 1, 2), " ")), F.try_element_at(families, F.try_element_at(words, F.lit(1))))


def inflections(verb: str) -> str:
    """A regular expression of a verb's forms, a final consonant doubled or not; of a phrase, those of its first word before the rest as it is."""
    verb, _, rest = verb.partition(" ")
    if rest:
        return inflections(verb) + r"\s+" + rest
    before, last = verb[-2:-1], verb[-1:]
    if last == "y" and before not in "aeiou":
        return f"{verb[:-1]}(y|ies|ied|ying)"
    if last == "e":
        return f"{verb[:-1]}(e|es|ed|ing)"
    doubled = f"|{last}ed|{last}ing" if before and before in "aeiou" and last not in "aeiouwxy" else ""
    return f"{verb}(s|es|ed|ing{doubled})?"


#: Headlines with a verb of attack or denial, or a word of controversy.
DISPUTED = r"\b(" + "|".join([*map(inflections, [*REPORTING["criticised"], *REPORTING["denied or defended"]]), *CONTROVERSY]) + r")\b"


def disputed(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike(DISPUTED), F.lit(False))


def headline_tense(verb: Column) -> Column:
    """Present tense, third person."""
    return (
        F.when(verb == "have", "has").when(verb == "be", "is").when(verb.rlike("(s|x|z|ch|sh|o)$"), F.concat(verb, F.lit("es")))
        .when(verb.rlike("[^aeiou]y$"), F.concat(F.substring(verb, F.lit(1), F.length(verb) - 1), F.lit("ies"))).otherwise(F.concat(verb, F.lit("s")))
    )


def is_title_case(title: Column) -> Column:
    """A capitalised function word inside, or two long words or more, all capitalised; the first word doesn't count."""
    words = F.regexp_extract_all(title, F.lit(r"[\p{L}']+"), F.lit(0))
    inner = F.when(F.size(words) > 1, F.slice(words, F.lit(2), F.size(words))).otherwise(F.array().cast("array<string>"))
    cap = lambda w: w.rlike(r"^\p{Lu}")
    long_ = F.filter(inner, lambda w: F.length(w) >= 4)
    return F.exists(inner, lambda w: cap(w) & F.array_contains(_lits(FUNCTION_WORDS), F.lower(w))) | ((F.size(long_) >= 2) & F.forall(long_, cap))


def spellings(name: Column) -> Column:
    return F.array_distinct(F.array(name, F.replace(name, F.lit("'"), F.lit("’")), F.replace(name, F.lit("'"), F.lit(""))))


def entity_key(s: Column) -> Column:
    """Without possessive, punctuation, title and article, lower-cased."""
    out = F.regexp_replace(F.coalesce(s, F.lit("")), "['’]s\\b", "")
    out = F.lower(clean_text(F.regexp_replace(out, r"[^\p{L}\p{N}\s-]", " ")))
    return F.regexp_replace(out, r"^((the|a|an|mr|mrs|ms|dr|president|minister|senator|governor)\s+)+", "")


def tone_label(score: Column, band: float = 0.15) -> Column:
    return F.when(score > band, "positive").when(score < -band, "negative").when(score.isNotNull(), "neutral")


def english_share(s: Column) -> Column:
    words = F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.array_contains(_lits(ENGLISH), w))) / F.size(words))


def language(s: Column) -> Column:
    return F.when((F.size(F.split(F.trim(s), r"\s+")) < 4) | (english_share(s) >= 0.15), "en").otherwise("other")


def names_a_thing(quote: Column) -> Column:
    words = F.regexp_extract_all(quote, F.lit(r"[\p{L}'-]+"), F.lit(0))
    long_ = F.filter(words, lambda w: F.length(w) >= 4)
    return (F.size(words) <= 8) & (F.size(long_) >= 2) & F.forall(long_, lambda w: w.rlike(r"^\p{Lu}"))


def initials(outlet: Column) -> Column:
    words = F.filter(F.regexp_extract_all(outlet, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.lower(w) != "the")
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def trim_to(s: Column, limit: int) -> Column:
    """Cut at a sentence end past 60 % of the limit, else at a word, with an ellipsis."""
    head = F.substring(s, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(\s|$)", 1)
    word = F.concat(F.regexp_replace(F.regexp_extract(head, r"(?s)^(.*)\s", 1), r"[\s,;:-]+$", ""), F.lit("…"))
    return F.when(F.length(s) <= limit, s).when(F.length(sentence) > limit * 0.6, sentence).otherwise(word)


def marked(text: Column, start: Column, end: Column) -> Column:
    """The span in double brackets."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit("[["), F.substring(text, start + 1, end - start), F.lit("]]"), F.substring(text, end + 1, F.length(text)))


def span_holds(text: Column, start: Column, end: Column, entity: Column) -> Column:
    """Whether a stored span still covers its entity."""
    return F.coalesce(F.substring(text, start + 1, end - start) == entity, F.lit(False))


def parse_vector(s: Column) -> Column:
    return F.transform(F.split(F.btrim(s, F.lit("[] ")), ","), lambda x: x.cast("double"))


def format_vector(v: Column) -> Column:
    """A vector as text, as parse_vector reads it."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("double").cast("string")), ","), F.lit("]"))


def first_date(*raw: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(x) for x in raw])


def most_likely(p: Column) -> Column:
    """Index, from 0, of the largest probability; the first wins."""
    return F.array_position(p, F.array_max(p)) - 1


def seven_point(s: Column) -> Column:
    """-3..3 as negative, neutral, positive; x as unusable; blank null; anything else invalid."""
    n = F.try_to_number(F.trim(s), F.lit("S9")).cast("int")
    return F.when(F.trim(F.coalesce(s, F.lit(""))) == "", None).when(F.lower(F.trim(s)) == "x", "unusable").when(n.between(-3, 3), F.when(n > 0, "positive").when(n < 0, "negative").otherwise("neutral")).otherwise("invalid")


def listing(names: Column) -> Column:
    """'A', 'A and B', 'A, B and C'; null without names."""
    n = F.size(names)
    return F.when(n == 1, names[0]).when(n > 1, F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def plural(n: Column, word: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {many or word + 's'}")))


def some_of(k: Column, n: Column) -> Column:
    return F.when(n == 1, F.lit("The one fact found was")).otherwise(F.concat(k.cast("string"), F.lit(" of the "), n.cast("string"), F.when(k == 1, F.lit(" facts was")).otherwise(F.lit(" facts were"))))


def excerpt(text: Column, start: Column, size: int = 280) -> Column:
    """About `size` characters around a place (from 0), from word to word; three dots where text is left out."""
    first = F.greatest(F.lit(0), start - size // 2)
    part = F.substring(text, first + 1, F.lit(size))
    more = first + size < F.length(text)
    part = F.when(first > 0, F.regexp_replace(part, r"^\S*\s+", "")).otherwise(part)
    part = F.when(more, F.regexp_replace(part, r"\s+\S*$", "")).otherwise(part)
    return F.concat(F.when(first > 0, F.lit("... ")).otherwise(F.lit("")), part, F.when(more, F.lit(" ...")).otherwise(F.lit("")))


def cited_authority(sentence: Column) -> Column:
    """Whom a sentence credits: the first authority, if it has a word of attribution."""
    who = F.regexp_extract(sentence, r"(?i)\b(" + "|".join(AUTHORITIES) + r")\b", 1)
    return F.when(sentence.rlike(r"(?i)\b(?:" + "|".join(ATTRIBUTES) + r")\b") & (who != ""), who)


def true_case(title: Column, lexicon: Column) -> Column:
    """A Title Case headline with words as the lexicon (map of lower-cased to usual form) writes them; the first word and acronyms stay, and so do headlines in sentence case."""
    pieces = F.regexp_extract_all(title, F.lit(r"[\p{L}']+|[^\p{L}']+"), F.lit(0))
    first = F.when(F.try_element_at(pieces, F.lit(1)).rlike(r"^[\p{L}']"), 0).otherwise(1)
    acronym = lambda w: (F.length(w) > 1) & (w == F.upper(w))
    fixed = F.transform(pieces, lambda w, i: F.when((i == first) | acronym(w), w).otherwise(F.coalesce(F.try_element_at(lexicon, F.lower(w)), w)))
    return F.when(is_title_case(title), F.array_join(fixed, "")).otherwise(title)


def straight_possessive(s: Column) -> Column:
    """A curly apostrophe of a possessive as a straight one; offsets hold."""
    return F.regexp_replace(s, r"(?<=\w)\u2019(?=s\b)", "'")


def title_words(title: Column) -> Column:
    """Words of a title, short titles written out."""
    short = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    words = F.filter(F.split(F.lower(F.trim(title)), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.try_element_at(short, w), w), " ")))


def escape_html(s: Column) -> Column:
    out = F.coalesce(s, F.lit(""))
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def web_link(url: Column) -> Column:
    """A link safe to follow, escaped, or nothing: only http and https leave the page."""
    return F.when(is_web_url(url), escape_html(url)).otherwise(F.lit(""))


def mark(value: Column) -> Column:
    """A reviewer's yes or no; null for anything else."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("y", "yes", "1"), F.lit(True)).when(v.isin("n", "no", "0"), F.lit(False))


def verdict(k: Column, n: Column, low: Column, threshold: float) -> Column:
    """Of k right ones in n, `low` the interval's lower end."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "not labelled").when(k / n < threshold, "FAIL").when(low >= threshold, "PASS").otherwise("PASS (interval reaches below the threshold)")


def clean_phrase(s: Column) -> Column:
    """A phrase without its leading article and the punctuation around it."""
    bare = F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), r"(?i)^(?:the|a|an)\s+", "")
    return F.regexp_replace(bare, r"^[ .,:;|\u2014-]+|[ .,:;|\u2014-]+$", "")


def worth_framing(kind: Column, name: Column, verbs: Column, key: Column, share: Column, most: float = 0.25) -> Column:
    """A mention that a tone can be about: of a framed kind, four words at most, no verb among them, a key of three letters or more, not in all the corpus."""
    return kind.isin(FRAMED_TYPES) & (F.size(F.split(F.trim(name), r"\s+")) <= 4) & ~F.coalesce(verbs, F.lit(False)) & (F.length(key) >= 3) & (F.coalesce(share, F.lit(0.0)) <= most)


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, in order: they end at a line's break, or after . ! ? (and a closing mark) where white space and a capital or an opening mark follow. Null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "(?<=[.!?][\"”']|[.!?])[ \\t\\n\\r\\f]+(?=[A-Z\"“'])|\\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
