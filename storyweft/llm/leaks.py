"""Benchmark decontamination over a positional inverted index.

The index holds one posting a word of the training texts: the word's hash and its place, sorted by word within a portion
of texts. Places number all words of all texts: a text begins at a multiple of SLOT, so that a place's text is found by
an equal key, and texts lie apart, so that no match crosses them. Test windows are intersected with it from their rarest
word: its places less its offset are the possible starts, the second rarest word's list keeps those that it has too,
and the rest of the words confirm what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut
from .tokens import portions, words

#: Words of a window of test text.
WINDOW = 10
#: Places are dealt to texts in slots of so many; places of a partition, and partitions, that numbers suffice for.
SLOT, PER_PARTITION = 1 << 12, 1 << 40
#: Texts lie at least so many places apart, which bounds the length of windows and spans.
APART = 1 << 10
#: Copies of the test side of the first join, so that a frequent word's postings meet it in as many tasks.
SALTS = 16
#: Bytes that are part of words: digits, letters and all beyond ASCII; others part them.
_PARTING = bytes(b if b >= 0x80 or chr(b).isalnum() else 10 for b in range(256))


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = words([t.translate(_PARTING) for t in texts])
    return hashes.view(np.int64), first


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written to the shared folder: rows (term, at) for each word, and for each row of `docs` a row without term for every slot it has: (at, base, id, n_words), base being where the text begins.

    Every row is a text of its own, whatever its id; null texts have no words but a slot. Memory is bound by a portion of
    texts, or one longer text.
    """
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * PER_PARTITION
        for batch, texts in portions(batches, "text"):
            hashes, first = _hashed(texts)
            sizes = np.diff(first)
            slots = (sizes + APART + SLOT - 1) // SLOT
            base = at + SLOT * np.concatenate(([0], np.cumsum(slots)))
            place = np.arange(len(hashes)) + np.repeat(base[:-1] - first[:-1], sizes)
            by = np.argsort(hashes, kind="stable")
            row = np.repeat(np.arange(len(texts)), slots)
            at = int(base[-1])
            n, empty = len(hashes), np.zeros(len(row), np.int64)
            where = base[0] + SLOT * np.arange(len(row))
            absent = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hashes[by]), pa.array(place[by]), absent, pa.nulls(n, batch.column("id").type), absent], ["term", "at", "base", "id", "n_words"])
            yield pa.RecordBatch.from_arrays([pa.array(empty, mask=np.ones(len(row), bool)), pa.array(where), pa.array(base[row]), batch.column("id").take(pa.array(row)), pa.array(sizes[row])], ["term", "at", "base", "id", "n_words"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut(rows.mapInArrow(run, f"term long, at long, base long, id {kind}, n_words long"))


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, terms, item, place): every run of `size` words of an item, from its word `place` on, or all its words where it has fewer; window is one number for equal words."""
    if size > APART:
        raise ValueError(f"windows of {APART} words at most")
    kind = items.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            hashes, first = _hashed(texts)
            for i in range(len(texts)):
                own = hashes[first[i] : first[i + 1]]
                k = min(size, len(own))
                if k:
                    runs = np.lib.stride_tricks.sliding_window_view(own, k)
                    ends = np.arange(0, runs.size + 1, k, dtype=np.int32)
                    terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(runs.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([terms, batch.column("id").take(pa.array([i] * len(runs))), pa.array(np.arange(len(runs)))], ["terms", "item", "place"])

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"terms array<long>, item {kind}, place long").distinct()
    return cut(found.select(F.xxhash64("terms").alias("window"), "terms", "item", "place"))


def frequencies(index: DataFrame, tests: DataFrame) -> DataFrame:
    """(term, f) of the words of windows(...) that the index has."""
    return cut(_salted(index, cut(tests.select(F.explode("terms").alias("term")).distinct())).groupBy("term").agg(F.count("*").alias("f")))


def _salted(index: DataFrame, tests: DataFrame) -> DataFrame:
    """Postings joined with tests(term, ...) on the term; postings of one term are dealt over SALTS keys. Spark broadcasts the tests if their file is small, by its own limit."""
    left = index.where("term is not null").select("term", "at", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int").alias("salt"))
    right = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["term", "salt"])


def phrases(index: DataFrame, tests: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Exact matches of windows(...): (window, start, size), start being the place of the first word. Every occurrence is found. `found` are frequencies(...), if known."""
    found = frequencies(index, tests) if found is None else found
    distinct = tests.groupBy("window").agg(F.first("terms").alias("terms")).where(F.size("terms") > 0)
    lists = cut(distinct.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")))
    ranked = lists.join(found, "term").withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy("f", "term", "offset")))
    # A window with a word that the index lacks cannot occur.
    whole = Window.partitionBy("window")
    ranked = cut(ranked.withColumn("held", F.count("*").over(whole)).where("held = size").select("window", "size", "term", "offset", "rank"))

    def confirmed(needed: DataFrame, few: bool) -> DataFrame:
        """Rows of needed(at, wanted, ...) whose place has the word wanted. With `few`, they are in few texts, and only the postings in their slots are moved."""
        held = index.where("term is not null").join(cut(needed.select(F.col("wanted").alias("term")).distinct()), "term", "left_semi")
        if few:
            near = cut(needed.select(F.expr(f"at div {SLOT}").alias("slot")).distinct())
            held = held.select("term", "at", F.expr(f"at div {SLOT}").alias("slot")).join(near, "slot", "left_semi")
        held = held.select("term", F.col("at").alias("place"))
        return needed.join(held, (needed["at"] == held["place"]) & (needed["wanted"] == held["term"]), "left_semi")

    single = _salted(index, ranked.where("size = 1")).select("window", "size", F.col("at").alias("start"))
    # Windows that overlap mostly have the same two rarest words as far apart: those two lists are intersected once.
    two = ranked.groupBy("window", "size").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(c[0] + str(r)) for r in (1, 2) for c in ("term", "offset")]).where("size > 1")
    two = cut(two.withColumn("apart", F.col("o2") - F.col("o1")).withColumn("pair", F.xxhash64("t1", "t2", "apart")))
    rarest = two.select(F.col("t1").alias("term"), "pair", F.col("t2").alias("wanted"), "apart").distinct()
    candidates = cut(_salted(index, rarest).select("pair", "wanted", (F.col("at") + F.col("apart")).alias("at")))
    both = cut(confirmed(candidates, False).select("pair", "at").join(two, "pair").select("window", "size", (F.col("at") - F.col("o2")).alias("start")))
    others = ranked.where("rank > 2").select("window", F.col("term").alias("wanted"), "offset")
    needed = cut(both.join(others, "window").select("window", "size", "start", "wanted", (F.col("start") + F.col("offset")).alias("at")))
    out = confirmed(needed, True).groupBy("window", "size", "start").agg(F.count("*").alias("met")).where("met = size - 2").drop("met")
    return cut(out.unionByName(both.where("size = 2")).unionByName(single))


def proximity(index: DataFrame, items: DataFrame, terms: int = 4, span: int = 20, found: DataFrame | None = None, home: DataFrame | None = None) -> DataFrame:
    """(item, base, start): where an item's `terms` rarest distinct words (all, if it has fewer; of words as rare, those first in the item) stand within `span` words of one text, in any order; start is the first of them.

    items is windows(...), `found` are their frequencies(...) and `home` slots(...), if known. Words that the index lacks make an item unfindable. Every place is found.
    """
    found = frequencies(index, items) if found is None else found
    if span > APART:
        raise ValueError(f"spans of {APART} words at most")
    words_ = items.where("item is not null").select("item", "place", F.posexplode("terms").alias("offset", "term"))
    own = cut(words_.groupBy("item", "term").agg(F.min(F.col("place") + F.col("offset")).alias("place")))
    place = Window.partitionBy("item").orderBy(F.coalesce("f", F.lit(0)), "place", "term")
    rarest = own.join(found, "term", "left").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= terms)
    whole = Window.partitionBy("item")
    rarest = cut(rarest.withColumn("n", F.count("*").over(whole)).withColumn("held", F.count("f").over(whole)).where("held = n").select("item", "term", "rank", "n"))
    # A posting is in its slot and, near the slot's beginning, in the one before, so that a span from any place of a slot is whole there.
    slot = F.expr(f"at div {SLOT}")
    places = F.when(F.col("at") % SLOT < span - 1, F.array(slot, slot - 1)).otherwise(F.array(slot))
    rows = cut(_salted(index, rarest).select("item", "at", "rank", "n", F.explode(places).alias("slot")))
    rows = rows.join(cut(rows.where("rank = 1").select("item", "slot").distinct()), ["item", "slot"], "left_semi")
    ahead = Window.partitionBy("item", "slot").orderBy("at").rangeBetween(0, span - 1)
    met = rows.withColumn("met", F.size(F.collect_set("rank").over(ahead))).where((F.col("met") == F.col("n")) & (slot == F.col("slot")))
    return met.select("item", "slot", F.col("at").alias("start")).join(home if home is not None else slots(index), "slot").select("item", "base", "start")


def slots(index: DataFrame) -> DataFrame:
    """(slot, base) of the index's texts."""
    return index.where("term is null").select(F.expr(f"at div {SLOT}").alias("slot"), "base")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", near_terms: int = 4, near_span: int = 20) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit (words inside an occurrence of an item's window), items (sorted as strings), near_items (those with a proximity match), contaminated.

    Null and empty texts have no words and no hits; null ids and repeated rows are rows of their own. Items of one id are
    one item, rows of items without words match nothing; an item without an id marks words but is not named. Words are
    told apart by 64-bit hashes. Columns but id and text are ignored. Either table may be empty.
    """
    index = postings(docs, id_col, text_col)
    tests = windows(items, size, item_col, text_col)
    known = frequencies(index, tests)
    found = phrases(index, tests, known)
    texts = cut(index.where("term is null"))
    home = slots(texts)
    # Starts whose windows overlap mark a word once.
    marked = found.select(F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct()
    hits = marked.join(home, F.expr(f"at div {SLOT}") == F.col("slot")).groupBy("base").agg(F.count("*").alias("n_hit"))
    named = found.join(tests.select("window", "item").distinct(), "window").join(home, F.expr(f"start div {SLOT}") == F.col("slot")).where("item is not null")
    named = named.select("base", F.col("item").cast("string").alias("item"), F.lit(True).alias("exact"))
    around = proximity(index, tests, near_terms, near_span, known, home).select("base", F.col("item").cast("string").alias("item"), F.lit(False).alias("exact"))
    listed = named.unionByName(around).distinct().groupBy("base").agg(
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.sort_array(F.collect_set(F.when(~F.col("exact"), F.col("item")))).alias("near_items")
    )
    rows = texts.where("at = base").select("base", "id", "n_words")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.join(hits, "base", "left").join(listed, "base", "left").select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), (n_hit > 0).alias("contaminated"),
    )
