"""Who is quoted and portrayed, and how: remarks over outlets, entities folded to one name, portrayal by outlet."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import true_case, worth_framing
from . import names
from .grouping import speaker_components, unit_rows
from .models import relation
from .snapshots import cut


#: How a version relates to the first, by what a model of entailment says of the two.
RELATIONS = {"same": "same", "first_more": "says less", "second_more": "says more", "different": "worded differently"}


def _versions(x: np.ndarray, source: np.ndarray, floor: float) -> Iterator[list[int]]:
    """Remarks of one speaker's quotes in order, each its versions in order, the first leading: a lead takes the first near enough quote of every other outlet."""
    free, left = np.ones(len(x), bool), np.bincount(source, minlength=1)
    live = np.arange(len(x))
    while len(live):
        # What is taken is left out from time to time, so that a lead looks at what is free.
        for lead in live[:256].tolist():
            if not free[lead]:
                continue
            taken = {int(source[lead]): lead}
            most = np.count_nonzero(left) + (0 if left[source[lead]] else 1)
            for a in range(0, len(live), 512):
                if len(taken) == most:
                    break
                at = live[a : a + 512]
                at = at[free[at]]
                near = at[(x[at] @ x[lead] >= floor) & ~np.isin(source[at], list(taken))]
                for s, i in zip(*np.unique(source[near], return_index=True), strict=True):
                    taken[int(s)] = int(near[i])
            group = [lead, *sorted(i for i in taken.values() if i != lead)]
            free[group] = False
            np.subtract.at(left, source[group], 1)
            yield group
        live = live[free[live]]


def remarks(quotes: DataFrame, floor: float = 0.7, same: float = 0.9) -> DataFrame:
    """quotes(story, pos, source, speaker, wording, lang, vector) -> story, remark (its first place), pos, version (from 0), outlets, shared, relation.

    Speakers that two outlets credit with nearly the same words are one; a speaker's attributed quotes lead. One remark
    has one version of each outlet; a quote that none shares is a remark of its own. relation says of a version whether it
    says the same as the first, more, less, or is worded differently; only English ones are compared. One speaker of a
    story is one task's work, which holds the quotes, not their pairs; places are unique in a story, and rows with a null
    story or place take no part."""

    def run(table: pa.Table) -> pa.Table:
        pos, known = table.column("pos").to_numpy(), table.column("speaker").is_valid().to_numpy()
        table = table.take(np.lexsort((pos, ~known)))
        pos, wording, lang = table.column("pos").to_pylist(), table.column("wording").to_pylist(), table.column("lang").to_pylist()
        source = pd.factorize(table.column("source").to_numpy(), use_na_sentinel=False)[0]
        out = []
        for group in _versions(unit_rows(table.column("vector")), source, floor):
            lead = group[0]
            for v, i in enumerate(group):
                both = v and lang[lead] == lang[i] == "en"
                how = "first" if not v else RELATIONS[relation(wording[lead] or "", wording[i] or "")] if both else "not compared"
                out.append((pos[lead], pos[i], v, len(group), len(group) > 1, how))
        remark, place, version, outlets, shared, how = zip(*out, strict=True)
        return pa.table([pa.array([table.column("story")[0].as_py()] * len(out), pa.int64()), remark, place, version, outlets, shared, how], names=["story", "remark", "pos", "version", "outlets", "shared", "relation"])

    rows = cut(quotes.select(F.col("story").cast("long").alias("story"), F.col("pos").cast("long").alias("pos"), "source", "speaker", "wording", "lang", "vector"))
    of = speaker_components(rows.select("story", "pos", "speaker", "source", "vector"), same)
    return rows.join(of, ["story", "pos"]).groupBy("story", "component").applyInArrow(run, "story long, remark long, pos long, version long, outlets long, shared boolean, relation string")


def remark_split(versions: DataFrame) -> DataFrame:
    """Of remarks(...) with speaker and wording: by story, how many remarks several outlets have, of which all worded alike, and how many speakers only one outlet quotes."""
    per = versions.groupBy("story", "remark").agg(F.max("outlets").alias("outlets"), F.min_by("speaker", "version").alias("speaker"), F.countDistinct("wording").alias("wordings"))
    several = F.col("outlets") > 1
    return per.groupBy("story").agg(
        F.count_if(several).alias("shared"), F.count_if(several & (F.col("wordings") == 1)).alias("all_same"), F.count_if(~several).alias("single"), F.countDistinct(F.when(~several, F.col("speaker"))).alias("single_speakers")
    )


def folded_names(mentions: DataFrame) -> DataFrame:
    """mentions(story, key) -> story, key, canonical: of the keys of its story that have all its words, itself included, the one of most words, then the commonest, then the first in the alphabet.

    A key meets only those that have its rarest word of the story, so that a common word does not pair all keys. A key
    without words is its own; null keys are left out."""
    keys = mentions.where("key is not null").groupBy("story", "key").agg(F.count("*").alias("n")).withColumn("words", F.filter(F.split("key", r"\s+"), lambda w: w != ""))
    each = keys.select("story", "key", F.explode(F.array_distinct("words")).alias("word"))
    rarest = each.join(each.groupBy("story", "word").agg(F.count("*").alias("k")), ["story", "word"]).groupBy("story", "key").agg(F.min_by("word", F.struct("k", "word")).alias("word"))
    place = F.struct((-F.size("words")).alias("l"), (-F.col("n")).alias("n"), F.col("key").alias("longer"))
    longer = keys.select("story", place.alias("place"), F.col("words").alias("having"), F.explode(F.array_distinct("words")).alias("word"))
    met = keys.join(rarest, ["story", "key"]).join(longer, ["story", "word"]).where(F.size(F.array_except("words", "having")) == 0)
    best = met.groupBy("story", "key").agg(F.min("place").alias("best"))
    return keys.join(best, ["story", "key"], "left").select("story", "key", F.coalesce("best.longer", "key").alias("canonical"))


def true_cased(titles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """titles(id, title) -> id, cased: Title Case headlines as lexicon(word, form), of unique words, writes them. A title is sent its own words' forms only."""
    words = titles.select("id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("title", F.lit(r"[\p{L}']+"), F.lit(0)), F.lower))).alias("word"))
    forms = words.distinct().join(lexicon.select("word", "form"), "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "form"))).alias("forms"))
    none = F.create_map().cast("map<string,string>")
    return titles.join(forms, "id", "left").select("id", true_case(F.col("title"), F.coalesce("forms", none)).alias("cased"))


def framed_mentions(mentions: DataFrame) -> DataFrame:
    """mentions(text_id, start, kind, name, has_verb, key, share): the first mention of each key of a text that a tone can be about."""
    held = mentions.where(worth_framing(F.col("kind"), F.col("name"), F.col("has_verb"), F.col("key"), F.col("share")))
    first = Window.partitionBy("text_id", "key").orderBy("start")
    return held.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def portrayal(mentions: DataFrame, positive: float = 0.15) -> DataFrame:
    """mentions(person, outlet, role, verb, by, tone) -> per person and outlet: mentions, speaks, acts, acted_on, named, warm, cold, mean_tone, and what was done to the person by whom, commonest first."""
    role = lambda r: F.count_if(F.col("role") == r)
    by = ["person", "outlet"]
    pairs = mentions.where("verb is not null").groupBy(*by, "verb", "by").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "verb", F.coalesce("by", F.lit("")).alias("who")))), lambda x: F.concat_ws(":", x["verb"], x["who"], -x["k"]))
    done = pairs.groupBy(*by).agg(F.array_join(listed, ",").alias("actions"))
    counts = mentions.groupBy(*by).agg(
        F.count("*").alias("mentions"), role("speaks").alias("speaks"), role("acts").alias("acts"), role("acted_on").alias("acted_on"), role("named").alias("named"),
        F.count_if(F.col("tone") > positive).alias("warm"), F.count_if(F.col("tone") < -positive).alias("cold"), F.round(F.avg("tone"), 6).alias("mean_tone"),
    )
    return counts.join(done, by, "left")


def framing_view(scores: DataFrame, most: int = 3) -> DataFrame:
    """scores(story, entity, outlet, score, targeted) -> the `most` entities of a story with the widest spread, their outlets by score, and whether all were scored by target."""
    means = scores.groupBy("story", "entity", "outlet").agg(F.avg("score").alias("score"), F.min("targeted").alias("targeted"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.round("score", 6)).alias("k"), "outlet"))), lambda x: x["outlet"])
    per = means.groupBy("story", "entity").agg(F.round(F.max("score") - F.min("score"), 6).alias("spread"), F.array_join(listed, ",").alias("outlets"), F.min("targeted").alias("targeted"), F.count("*").alias("n")).where("n > 1")
    place = Window.partitionBy("story").orderBy(F.desc("spread"), "entity")
    return per.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).drop("n")


def person_mentions(articles: DataFrame, gazetteer: DataFrame, listed_only: bool = False) -> DataFrame:
    """articles(article, outlet, text) -> article, outlet, person, name, start, sentence, role, verb, title, tone: every person named in whole texts, and how the sentence presents them.

    person is the listed id, else the lower-cased name; title what stands before the name. Roles are extract.role's.
    Null texts name nobody."""
    from .extract import role, sentences
    from .models import tone

    found = names.mentions(articles, "text", ["article", "outlet"], gazetteer, model=None, titles=not listed_only).where("label = 'PERSON'")
    spans = found.groupBy("article", "outlet").agg(F.collect_list(F.struct("start", "end", F.coalesce("id", F.lower("text")).alias("person"))).alias("spans"))
    rows = articles.join(spans, ["article", "outlet"])
    kind = dict(articles.dtypes)["article"]

    def run(parts):
        for pdf in parts:
            out = []
            for article, outlet, text, held in pdf[["article", "outlet", "text", "spans"]].itertuples(index=False, name=None):
                view = sentences(text)
                starts = np.array([a for a, _ in view])
                for s in held:
                    at, sentence = view[max(0, int(np.searchsorted(starts, s["start"], "right")) - 1)]
                    name = text[s["start"] : s["end"]]
                    told = role(sentence, name) or {"role": "mentioned", "verb": None}
                    before = re.search(r"((?:\b(?:" + "|".join(sorted(names.TITLES + names.CASED_TITLES, key=len, reverse=True)) + r")\b\.?\s*)+)$", text[max(0, s["start"] - 60) : s["start"]], re.I)
                    out.append((article, outlet, s["person"], name, s["start"], sentence, told["role"], told["verb"], before[1].strip() if before else None, tone(sentence)))
            yield pd.DataFrame(out, columns=["article", "outlet", "person", "name", "start", "sentence", "role", "verb", "title", "tone"])

    return rows.select("article", "outlet", "text", "spans").mapInPandas(run, f"article {kind}, outlet string, person string, name string, start long, sentence string, role string, verb string, title string, tone double")


ROLES = ["speaks", "acts", "acted on", "spoken about", "described", "mentioned"]


def portrayal_of(mentions: DataFrame, least_articles: int = 6, examples: int = 3, positive: float = 0.15) -> DataFrame:
    """person_mentions(...) -> by person and outlet: articles, mentions, one counter a role, warm, cold, mean_tone, title (the commonest, then the first in the alphabet), examples (the first sentences of each role by article and place).

    Persons whom fewer than `least_articles` articles of all outlets name are left out."""
    by = ["person", "outlet"]
    known = mentions.groupBy("person").agg(F.countDistinct("article").alias("k")).where(F.col("k") >= least_articles).select("person")
    rows = mentions.join(known, "person", "left_semi")
    counters = [F.count_if(F.col("role") == r).alias(r.replace(" ", "_")) for r in ROLES]
    counts = rows.groupBy(*by).agg(F.countDistinct("article").alias("articles"), F.count("*").alias("mentions"), *counters, F.count_if(F.col("tone") > positive).alias("warm"), F.count_if(F.col("tone") < -positive).alias("cold"), F.round(F.avg("tone"), 6).alias("mean_tone"))
    titles = rows.where("title is not null").groupBy(*by, "title").agg(F.count("*").alias("n")).groupBy(*by).agg(F.min_by("title", F.struct(-F.col("n"), "title")).alias("title"))
    first = Window.partitionBy(*by, "role").orderBy("article", "start")
    shown = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= examples).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("role", "rn", "sentence"))).alias("x"))
    shown = shown.select(*by, F.transform("x", lambda e: F.struct(e["role"].alias("role"), e["sentence"].alias("sentence"))).alias("examples"))
    return counts.join(titles, by, "left").join(shown, by, "left")
