"""Subjects of figures and stories: hand-written cases."""

from pyspark.sql import functions as F

from storyweft.operators import subjects

CLAIMS = [
    (1, 1, "a", "The death toll in the Nairobi floods rose to 47 on Monday."),
    (1, 2, "b", "Officials confirmed 52 people dead in Nairobi after the floods."),
    (1, 3, "c", "Some 3,200 people have died on roads since January."),
    (1, 4, "d", "At least 12 people were killed in Kisumu."),
    (1, 5, "a", "Foreign direct investment reached $40 million."),
    (1, 6, "b", "FDI was worth $42 million, the treasury said."),
    (1, 7, "c", "The bridge collapsed at a cost of $9 million."),
    (1, 8, "d", "A collapse of the bridge may cost $8 million."),
    (1, 9, "d", None),
]


def test_figures_about_one_thing(spark):
    claims = spark.createDataFrame(CLAIMS, "story long, pos long, source string, text string")
    found = subjects.figure_subjects(claims, common=0.9)
    places = spark.createDataFrame([(1, "Nairobi", "GPE"), (2, "Nairobi", "GPE"), (4, "Kisumu", "GPE"), (2, "Officials", "ORG")], "pos long, text string, label string")
    rows = found.join(subjects.scopes(places, ["pos"]), "pos", "left")
    got = {}
    for r in subjects.linked(rows).collect():
        got.setdefault((r.unit, r.part), []).append(r.pos)
    assert sorted(got[("people", 0)]) == [1, 2] and got[("people", 1)] == [3] and got[("people", 2)] == [4]
    assert sorted(got[("currency", 0)]) == [5, 6] and sorted(got[("currency", 1)]) == [7, 8] and len(got) == 5


def test_common_words_and_speakers_are_no_subject(spark):
    claims = spark.createDataFrame([(1, i, "a", f"Ruto opened {i + 20} {w} hospitals") for i, w in enumerate(["new", "county", "mission", "village", "private", "public"])] + [(2, 0, "a", "Ruto opened 7 mission hospitals")], "story long, pos long, source string, text string")
    rows = {(r.story, r.pos): r for r in subjects.figure_subjects(claims).collect()}
    assert rows[(1, 2)].tokens == ["mission"] and sorted(rows[(2, 0)].tokens) == ["mission", "opened", "ruto"] and rows[(1, 2)].unit == "hospital"


def test_subject_of_a_story(spark):
    titles = [
        (1, 1, "Ruto's foreign trader directive in court"), (1, 2, "Traders defy the new directive"), (1, 3, "Ruto and the foreign traders"), (1, 4, "Ruto"), (1, 5, None), (1, 6, "Directives by Ruto"),
        (2, 1, "Kenya"), (3, 1, "one two three four five six seven floods"), (3, 2, "floods"), (4, 1, "of"),
    ]
    got = {r.story: (r.head, r.titles, r.widest, r.subject) for r in subjects.story_subjects(spark.createDataFrame(titles, "story long, pos long, title string")).collect()}
    assert got[1] == ("directive", 3, 4, "Ruto's foreign trader directive") and 2 not in got and 4 not in got
    assert got[3] == ("flood", 2, 1, "floods")


def test_empty(spark):
    assert subjects.linked(subjects.figure_subjects(spark.createDataFrame([], "story long, pos long, source string, text string")).withColumn("scope", F.array().cast("array<string>"))).collect() == []
