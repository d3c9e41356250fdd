"""What a figure and what a story is about: subjects of figures, places, figures about one thing, and a story's head noun."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import FUNCTION_WORDS, is_cumulative
from .extract import figures, subject
from .grouping import complete_linkage

# Words that name who speaks, kinds of names that are places, heads that say nothing, words of every story.
SPEAKERS = {
    "cabinet", "secretary", "minister", "ministry", "interior", "principal", "administration", "national", "deputy", "president", "governor", "senator", "senate", "parliament", "assembly",
    "commissioner", "spokesperson", "official", "officials", "authority", "department", "office", "chief", "kenya", "kenyan", "kenyans", "government", "state", "county",
}
PLACE_KINDS = ["GPE", "LOC", "NORP", "FAC"]
NO_HEADS = {"the", "and", "for", "with", "from", "that", "this", "says", "said"}
UNIVERSAL = {"kenya", "kenyan", "kenyans", "kenya's", "kenyas"}
MOST_WORDS = 6

_FIGURES = "fig int, value double, unit string, state string, currency string, tokens array<string>, acronyms array<string>, upper array<string>"


def figure_subjects(claims: DataFrame, common: float = 0.25, least: int = 5) -> DataFrame:
    """claims(story, pos, source, text) -> story, pos, source, fig, value, unit, state, currency, tokens, acronyms, upper, cumulative.

    tokens are the plain words of the claim without the figure's own unit word and, in stories of `least` claims or more,
    without words that more than `common` of the story's claims have. Null texts have no figures; places are unique.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for story, pos, source, text in pdf.itertuples(index=False, name=None):
                for i, f in enumerate(figures(text)):
                    about = subject(text, f["word"])
                    out.append((story, pos, source, i, f["value"], f["unit"], f["state"], f["currency"], about["tokens"], about["acronyms"], about["upper"]))
            yield pd.DataFrame(out, columns=["story", "pos", "source", "fig", "value", "unit", "state", "currency", "tokens", "acronyms", "upper"])

    @F.pandas_udf("array<string>")
    def words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([subject(t)["tokens"] for t in s], dtype=object)

    texts = claims.select("story", "pos", "source", F.col("text").cast("string").alias("text"))
    types = dict(texts.dtypes)
    found = texts.where("text is not null").mapInPandas(run, f"story {types['story']}, pos {types['pos']}, source string, {_FIGURES}")
    sizes = texts.groupBy("story").agg(F.count("*").alias("claims")).where(F.col("claims") >= least)
    # A story's common words are as few as its claims are long: fewer than words of a claim over the share.
    per = texts.where("text is not null").select("story", "pos", F.explode(words("text")).alias("word")).groupBy("story", "word").agg(F.countDistinct("pos").alias("k"))
    usual = per.join(sizes, "story").where(F.col("k") > F.col("claims") * common).groupBy("story").agg(F.collect_set("word").alias("usual"))
    none = F.array().cast("array<string>")
    flags = texts.select("story", "pos", is_cumulative(F.col("text")).alias("cumulative"))
    return found.join(usual, "story", "left").withColumn("tokens", F.array_except("tokens", F.coalesce("usual", none))).drop("usual").join(flags, ["story", "pos"])


def scopes(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and scope: the lower-cased places that names.mentions(...) found in a text."""
    return mentions.where(F.col("label").isin(PLACE_KINDS)).groupBy(*keys).agg(F.sort_array(F.collect_set(F.lower(F.trim("text")))).alias("scope"))


def _stem(word: str) -> str:
    return next((word[: -len(s)] for s in ("ing", "ed", "es", "s", "e") if word.endswith(s) and len(word) - len(s) >= 4), word)


class _Figure:
    """What of a figure decides whether it is about the same as another."""

    def __init__(self, row: dict):
        named = {w.lower() for w in row.get("named") if w} if row.get("named") is not None else set()
        self.kind = (row["state"], bool(row["cumulative"])) if row["state"] else None
        self.scope = set(row["scope"]) if row.get("scope") is not None else set()
        self.stems = {_stem(t) for t in row["tokens"] if t not in SPEAKERS and t not in named}
        self.upper, self.acronyms = set(row["upper"]), set(row["acronyms"])

    def like(self, other: _Figure) -> bool:
        if self.kind or other.kind:
            apart = self.scope and other.scope and not self.scope & other.scope
            return self.kind == other.kind and not apart
        if not (self.stems and other.stems):
            return True
        return bool(self.stems & other.stems or self.upper & other.acronyms or other.upper & self.acronyms)


def linked(figures_: DataFrame) -> DataFrame:
    """figure_subjects(...) with scope and named (arrays, or absent) -> story, unit, pos, fig, part.

    Figures of one story and unit are parted in order of pos and fig: one joins the first part all of whose figures it is
    like. Counts of people in one state are alike if both or neither are running totals and their places don't differ;
    others if a word of their subjects has one stem, or an acronym is the other's initials, or one has no subject. A
    story's figures of one unit are one task's work. Figures without a unit take no part.
    """
    columns = [c for c in ("scope", "named") if c in figures_.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "fig"], kind="stable").reset_index(drop=True)
        rows = [_Figure({k: (None if k == "state" and pd.isna(v) else v) for k, v in r.items()}) for r in pdf.to_dict("records")]
        part = [0] * len(rows)
        for k, group in enumerate(complete_linkage(len(rows), lambda i, j: rows[i].like(rows[j]))):
            for i in group:
                part[i] = k
        return pdf[["story", "unit", "pos", "fig"]].assign(part=part)

    types = dict(figures_.dtypes)
    held = figures_.where("unit is not null").select("story", "unit", "pos", "fig", "state", "cumulative", "tokens", "acronyms", "upper", *columns)
    return held.groupBy("story", "unit").applyInPandas(run, f"story {types['story']}, unit string, pos {types['pos']}, fig int, part int")


#: What parts a title into phrases: function words, and what is no letter, digit, space, hyphen or apostrophe.
PARTS = r"(?i)(?<![\p{L}\p{N}'’-])(?:" + "|".join(FUNCTION_WORDS) + r"|says?|said)(?![\p{L}\p{N}'’-])|[^\p{L}\p{N}'’ -]+"


def phrases(title: Column) -> Column:
    """The phrases of a title, in order, as arrays of words."""
    pieces = F.split(F.regexp_replace(F.coalesce(title, F.lit("")), PARTS, "|"), r"\|")
    worded = F.transform(pieces, lambda p: F.filter(F.split(p, " +"), lambda w: w != ""))
    return F.filter(worded, lambda p: F.size(p) > 0)


def story_subjects(titles: DataFrame) -> DataFrame:
    """titles(story, pos, title) -> story, head, titles, widest, subject: the phrase that names each story.

    The head is the last word of a phrase. Heads that two titles share go before others; of those the one of most titles
    times words in its widest phrase (MOST_WORDS at most; 1 if all are wider), then the first in the alphabet. The
    subject is its widest phrase, the first in order of pos; the head itself, if all are wider. Heads of fewer than three letters or
    that every story has are none; a story without heads has no row.
    """
    each = titles.select("story", "pos", F.posexplode(phrases(F.col("title"))).alias("at", "words"))
    last = F.lower(F.element_at("words", -1))
    head = _singular_column(last)
    each = each.withColumn("head", head).where((F.length("head") >= 3) & ~F.col("head").isin(*NO_HEADS, *UNIVERSAL)).withColumn("n", F.size("words"))
    fits = F.col("n") <= MOST_WORDS
    best = F.min_by(F.array_join("words", " "), F.when(fits, F.struct((-F.col("n")).alias("n"), "pos", "at")))
    heads = each.groupBy("story", "head").agg(F.countDistinct("pos").alias("titles"), F.coalesce(F.max(F.when(fits, F.col("n"))), F.lit(1)).alias("widest"), best.alias("phrase"))
    place = Window.partitionBy("story").orderBy(F.desc(F.col("titles") >= 2), F.desc(F.col("titles") * F.col("widest")), "head")
    return heads.withColumn("rn", F.row_number().over(place)).where("rn = 1").select("story", "head", "titles", "widest", F.coalesce("phrase", "head").alias("subject"))


def _singular_column(w: Column) -> Column:
    """extract.singular as an expression."""
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return F.when(w.rlike("ies$") & (F.length(w) > 4), F.concat(cut(3), F.lit("y"))).when(w.rlike("(ses|xes|zes|ches|shes)$"), cut(2)).when(w.rlike("[^s]s$") & (F.length(w) > 3), cut(1)).otherwise(w)
