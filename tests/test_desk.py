"""Wording and extraction against plain Python and hand-written answers."""

import math
import random

from pyspark.sql import functions as F

from storyweft.functions import text as T
import byrows
from storyweft.operators import evalstats, extract, models, people


def values(spark, fn, items):
    rows = spark.createDataFrame(list(enumerate(items)), "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_excerpt(spark):
    rnd = random.Random(1)
    texts = [" ".join("w" * rnd.randint(1, 9) for _ in range(n)) for n in (0, 1, 5, 30, 60)]
    rows = [(t, p) for t in texts for p in (0, 20, 100, max(0, len(t) - 1))]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p int").orderBy("i").select(T.excerpt(F.col("t"), F.col("p"), 40)).collect()]
    for (t, p), g in zip(rows, got):
        first = max(0, p - 20)
        part, more = t[first : first + 40], first + 40 < len(t)
        if first and " " in part:
            part = part.split(" ", 1)[1]
        if more and " " in part:
            part = part.rsplit(" ", 1)[0]
        assert g == ("... " if first else "") + part + (" ..." if more else "")


def test_all_number_words():
    found = extract.figures("Fifteen people were killed and nineteen hurt; five were missing.")
    assert [f["value"] for f in found] == [15, 19, 5]
    assert [f["value"] for f in extract.figures("It cost 3k, then 4 mn, then 2 tn.")] == [3e3, 4e6, 2e12]


def test_families_and_disputes(spark):
    assert values(spark, T.verb_family, ["deny", "hit back", "call for calm", "Say", "sing"]) == ["denied or defended", "criticised", "urged or warned", "said", None]
    assert values(spark, T.disputed, ["MP hits back at critics", "Milk output hits record", "Probe into land deal", None]) == [True, False, True, False]


def test_tone_reads_whole_texts():
    good = sorted(models.GOOD)[0]
    assert models.tone("x " * 600 + good) == 1.0


def test_thresholds(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(evalstats.CLASSES), rnd.randint(-100, 100) / 100) for _ in range(300)]
    got = {r.step: r.f1 for r in evalstats.threshold_scores(spark.createDataFrame(rows, "gold string, score double")).collect()}
    for step in range(81):
        guess = ["pos" if s > step / 100 else "neg" if s < -step / 100 else "neu" for _, s in rows]
        assert math.isclose(got[step], byrows.f1([g for g, _ in rows], guess))


def test_folded_names(spark):
    rows = [(1, "a b"), (1, "b"), (1, "b"), (1, "c b"), (2, "b"), (2, None), (3, "a b c"), (3, "c a"), (3, "b"), (3, "x b"), (3, "x b"), (3, "")]
    got = sorted(map(tuple, people.folded_names(spark.createDataFrame(rows, "story long, key string")).collect()))
    assert got == [(1, "a b", "a b"), (1, "b", "a b"), (1, "c b", "c b"), (2, "b", "b"), (3, "", ""), (3, "a b c", "a b c"), (3, "b", "a b c"), (3, "c a", "a b c"), (3, "x b", "x b")]


def test_folded_names_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(rnd.randint(1, 3), " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 4)))) for _ in range(300)]
    got = sorted(map(tuple, people.folded_names(spark.createDataFrame(rows, "story long, key string")).collect()))
    want = []
    for story, key in sorted(set(rows)):
        over = [(-len(k.split()), -rows.count((s, k)), k) for s, k in set(rows) if s == story and set(key.split()) <= set(k.split())]
        want.append((story, key, min(over)[2]))
    assert got == want


def test_remarks_by_speaker_and_relation(spark):
    quotes = [
        (1, 1, "a", "otieno", "we will win today in all counties", "en", [1.0, 0.0, 0.0]), (1, 2, "b", "otieno", "we will win", "en", [1.0, 0.0, 0.0]), (1, 3, "c", None, "we will win today in all counties", "en", [0.99, 0.1, 0.0]),
        (1, 4, "a", "wanjiku", "prices fall", "en", [0.0, 1.0, 0.0]), (1, 5, "b", "achieng", "no deal", "en", [0.0, 0.0, 1.0]), (2, 6, "a", "otieno", "we will win", "en", [1.0, 0.0, 0.0]),
        (2, 7, "a", "otieno", "we will win", "en", [1.0, 0.0, 0.0]), (2, 8, "b", None, "rain", "sw", [0.0, 1.0, 0.0]), (3, 9, "a", "cheptumo", "a b c", "en", [1.0, 0.0, 0.0]), (3, 10, "b", "wendot", "a b d", "fr", [1.0, 0.0, 0.0]),
        (3, 11, "c", "other", "a b d", "en", [0.8, 0.6, 0.0]),
    ]
    df = spark.createDataFrame(quotes, "story long, pos long, source string, speaker string, wording string, lang string, vector array<double>")
    got = sorted(map(tuple, people.remarks(df).select("story", "remark", "pos", "version", "outlets", "relation").collect()))
    assert got == [
        (1, 1, 1, 0, 3, "first"), (1, 1, 2, 1, 3, "says less"), (1, 1, 3, 2, 3, "same"), (1, 4, 4, 0, 1, "first"), (1, 5, 5, 0, 1, "first"), (2, 6, 6, 0, 1, "first"), (2, 7, 7, 0, 1, "first"),
        (2, 8, 8, 0, 1, "first"), (3, 9, 9, 0, 2, "first"), (3, 9, 10, 1, 2, "not compared"), (3, 11, 11, 0, 1, "first"),
    ]


def test_doubled_consonants_and_ages_and_money(spark):
    titles = ["governor slammed by mps", "mp hitting back at critics", "MP hits back at critics", "milk output hits record", "hitting the road"]
    assert values(spark, T.disputed, titles) == [True, True, True, False, False]
    assert values(spark, T.is_title_case, ["Talks After Raid", "Talks after Raid in Nyeri"]) == [True, False]
    assert extract.figures("He died at 34") == [] and extract.figures("The pastor, aged 61, said") == []
    units = lambda t: [(f["value"], f["unit"], f["currency"], f["state"]) for f in extract.figures(t)]
    assert units("300 kes and EUR 20 and USD 40 million") == [(300, "currency", "KES", None), (20, "currency", "EUR", None), (4e7, "currency", "USD", None)]
    assert units("five voters and 3 delegates") == [(5, "people", None, None), (3, "people", None, None)]
    assert units("The death toll rose to 47") == [(47, "people", None, "dead")] and units("1,500 people are missing") == [(1500, "people", None, "missing")]
    assert units("90 days to identify the dead") == [(90, "days", None, None)] and units("1,000 paid internship opportunities") == [(1000, "opportunity", None, None)]
    assert units("2.8 billion was lost") == [(2.8e9, "currency", None, None)] and units("20 hospitals") == [(20, "hospital", None, None)]
    about = extract.subject("Foreign direct investment rose; FDI in 20 hospitals", "hospitals")
    assert about["tokens"] == ["direct", "fdi", "foreign", "investment"] and "fdi" in about["acronyms"] and about["upper"] == ["fdi"]


def test_tone_and_topic_as_expressions(spark):
    rnd = random.Random(12)
    vocabulary = [*sorted(models.GOOD), *sorted(models.BAD), "President", "bank", "goodé", "bad_", "hospital", "goal", "x"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))) for _ in range(80)] + [None, ""]
    rows = spark.createDataFrame([(i, t, rnd.randint(-2, 20), rnd.randint(-2, 40)) for i, t in enumerate(texts)], "i int, t string, a int, b int")
    got = rows.select("i", "t", "a", "b", models.tone_of(F.col("t")).alias("tone"), models.topic_of(F.col("t")).alias("topic"), models.target_tone_of(F.col("t"), F.col("a"), F.col("b"), 5).alias("at")).collect()
    for r in got:
        assert (r.tone, r.topic, r["at"]) == (models.tone(r.t), models.topic(r.t), models.target_tone(r.t, r.a, r.b, 5))


def test_relation_as_an_expression(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["ten", "People", "died", "in", "the", "flood"]) for _ in range(rnd.randint(0, 6))) for _ in range(30)]
    pairs = [(a, b) for a in texts[:15] for b in texts[15:]]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", models.relation_of(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == models.relation(r.a, r.b) for r in got) and len({r.r for r in got}) == 4


def test_batched_model(spark):
    from pyspark.sql.types import DoubleType

    def load():
        return lambda texts: [float(len(texts)) * 0 + len(t) for t in texts] if len(texts) <= 2 else None

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "a", None, "abc", "abcdef", ""])], "i int, t string").repartition(1)
    got = {r.i: r.s for r in rows.select("i", models.batched(load, DoubleType(), 2)(F.col("t")).alias("s")).collect()}
    assert got == {0: 3.0, 1: 1.0, 2: None, 3: 3.0, 4: 6.0, 5: 0.0}
