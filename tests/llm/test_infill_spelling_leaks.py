"""Fill-in-middle, spelling variants and decontamination against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storyweft.llm.infill import infill, restored
from storyweft.llm.leaks import decontaminate, phrases, postings, proximity, windows
from storyweft.llm.spelling import edits, run_counts, variants

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _cut(doc_id, text, rate=100, spm=50, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


AWKWARD = ["", "\n", "\n\n\n", "a", "a\n", "a\r\nb\rc", "\u0001\u0002e\u0001c\n\u0002\u0002\n\u0001", "x\u0001e\ny\u0001c\n\u0001", "<P", "a<\nS>b\n<M", "one <M> two", "é\U0001f600\n\u2028ü\u0085\n", "l\n" * 3000, "$0 \\1\n$1", "\x00\n\x00"]


def test_infill_equals_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(100 + i, "".join(rng.choice("ab\n\u0001\u0002ec<PSM>") for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "a\nb\nc\n"), (7, None), (3, "again\ntwice\n"), (3, "again\ntwice\n")]
    for rate, spm in ((100, 50), (60, 0), (0, 100)):
        got = infill(_docs(spark, rows), rate=rate, spm=spm).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(rows)
        want = sorted((str(i), t or "", *_cut(i, t or "", rate, spm)) for i, t in rows)
        assert sorted((str(r.doc_id), r.back, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in got) == want


def test_infill_long_text_other_units_and_clashing_columns(spark):
    long = "".join(f"line {i}\n" for i in range(200_000))
    docs = _docs(spark, [(1, long), (2, "one two  three")]).withColumn("n", F.lit("mine")).withColumn("_text", F.lit(1)).withColumn("Form", F.lit(0)).withColumn("_prefix", F.lit(2))
    rows = {r.doc_id: r for r in infill(docs).collect()}
    assert rows[1].output == _cut(1, long)[5] and rows[1].n == 200_000 and rows[1]._text == 1 and rows[1]._prefix == 2
    words = {r.doc_id: r for r in infill(docs.where("doc_id = 2"), unit=r"\S+\s*|\s+").collect()}
    assert words[2].n == 3 and words[2].prefix + words[2].middle + words[2].suffix == "one two  three"
    assert infill(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        infill(docs, markers=("<a", "a<", "<M>"))


def _variants(counts, ratio=10):
    near, gaps = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            u = w[:k] + w[k + 1 :]
            if u in counts:
                near[w].add(u)
                near[u].add(w)
            gaps[k, u].add(w)
    for g in gaps.values():
        for a in g:
            near[a] |= g - {a}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= ratio * counts[w] and counts[b] > counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), counts[form[w]] if w in form else -1) for w, n in counts.items())


def _rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("seed, letters, size", [(1, "ab", 400), (2, "abcé", 900), (3, "ab", 60)])
def test_variants_equal_brute_force_over_any_ranges(spark, monkeypatch, seed, letters, size):
    """Dense words over few letters: nearly all nodes branch, ranges share many, runs of one letter have several ways to be one edit apart."""
    from storyweft.llm import spelling

    rng = random.Random(seed)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.choice([1, 1, 2, 10, 30, 500, 6000]) for _ in range(size)}
    counts |= {"": 4, "a" * 3000: 1, "a" * 2999 + "b": 20, "a" * 3001: 300}
    for held in (20_000, 37):
        monkeypatch.setattr(spelling, "RANGE", held)
        assert _rows(variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == _variants(counts)


def test_variants_ties_nulls_repeats_and_chains(spark):
    rows = [("wordone", 1), ("wordane", 20), ("wordbne", 20), (None, 9), ("solitary", None), ("aaaaaaa", 1), ("aaaaaab", 5), ("aaaaaab", 5), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaabbbb", 10_000)]
    got = {r.word: r for r in variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["wordone"].form == "wordane" and got["wordone"].n_near == 2 and got["wordane"].form is None and got["wordane"].root == "wordane"
    assert got["solitary"].n == 0 and got["solitary"].n_near == 0 and got["solitary"].root == "solitary" and None not in got
    assert got["aaaaaab"].n == 10 and got["aaaaaaa"].root == "aaabbbb" and got["aaaaaaa"].form == "aaaaaab"
    assert variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert edits(spark.createDataFrame([("x", 1)], "word string, n long")).collect() == []


def test_run_counts_slip_by_rule(spark):
    import zlib

    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(rng.choice(["Example", "exÄmple", "sample", "naïvely-put", "x" * 40]) for _ in range(30))) for _ in range(40)] + [(5, None), (6, ""), (7, "Example")]
    want = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 3 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            want[r] += len(r) >= 6
    got = run_counts(_docs(spark, rows).withColumn("run", F.lit("x")).withColumn("h", F.lit(1)), least=6, least_n=2, slip=3).collect()
    assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if n >= 2}


def _leaks(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    own, sizes = defaultdict(set), set()
    for i, t in items:
        w = word.findall((t or "").translate(AZ))
        k = min(size, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            own[tuple(w[a : a + k])].add(i)
            sizes.add(k)
    out = []
    for i, t in docs:
        w, hit, named = word.findall((t or "").translate(AZ)), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in own:
                    hit |= set(range(a, a + k))
                    named |= own[tuple(w[a : a + k])]
        out.append((str(i), len(w), len(hit), sorted(str(x) for x in named if x is not None), bool(hit)))
    return sorted(out)


def test_decontaminate_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "zwölf", "été", "x1", "Y2", "rare", "word", "a", "b"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n", "!"]) for _ in range(n))
    items = [(i, say(rng.randint(1, 9))) for i in range(30)] + [(1, "the the the the the the the the the the the"), (40, None), (41, "..."), (None, "rare word a b"), (42, "never-seen term"), (43, "The, of! a")]
    docs = [(i, say(rng.choice([0, 3, 30, 300]))) for i in range(60)] + [(5, "the of a"), (5, "the of a"), (None, "rare; WORD a-b"), (90, None), (91, ""), (92, "the " * 9000), (93, items[3][1]), (94, " ".join(str(i) for i in range(5000)) + " the of a")]
    extra = _docs(spark, docs).withColumn("base", F.lit(1)).withColumn("item_id", F.lit("x")).repartition(3)
    for size in (4, 10):
        got = decontaminate(extra, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)), size=size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.items, r.contaminated) for r in got) == _leaks(docs, items, size)


def test_decontaminate_empty_tables(spark):
    none, some = _docs(spark, []), _docs(spark, [(1, "a b c")])
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(none, items).collect() == []
    row = decontaminate(some, items.limit(0)).collect()[0]
    assert (row.doc_id, row.n_words, row.n_hit, row.items, row.near_items, row.contaminated) == (1, 3, 0, [], [], False)
    assert decontaminate(some, items).collect()[0]["items"] == ["1"]


def test_phrases_of_a_passage_in_every_text(spark):
    """A hot passage, a window that repeats a word, and matches that must not cross texts."""
    docs = _docs(spark, [(i, f"w{i} alpha beta alpha gamma end{i}") for i in range(300)] + [(900, "alpha beta"), (901, "alpha gamma")]).repartition(5)
    index = postings(docs)
    tests = windows(spark.createDataFrame([(1, "alpha beta alpha gamma"), (2, "beta alpha")], "item_id long, text string"), 4)
    found = phrases(index, tests).groupBy("size").count().collect()
    assert {r["size"]: r["count"] for r in found} == {4: 300, 2: 300}


def test_proximity_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    items = {1: ["t1", "t2", "t3", "t4", "t5"], 2: ["t0"], 3: ["t7", "t8"], 4: ["t9", "absent"]}
    index = postings(_docs(spark, docs).repartition(3))
    bag = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = proximity(index, windows(bag, 10), terms=3, span=6)
    home = index.where("term is null and at = base").select("base", F.col("id").alias("doc_id"))
    found = sorted((r.item, r.doc_id, r.start - r.base) for r in got.join(home, "base").collect())
    freq = Counter(w for _, t in docs for w in t.split())
    want = []
    for i, terms in items.items():
        rare = sorted(terms, key=lambda t: freq[t])[:3]
        if not all(freq[t] for t in rare):
            continue
        for d, t in docs:
            w = t.split()
            want += [(i, d, a) for a in range(len(w)) if w[a] in rare and set(rare) <= set(w[a : a + 6])]
    assert found == sorted(want) and found
