"""Spelling variants: one-edit pairs by errata-trie merging, and the common form each rare word may stand for.

The words make a trie. At every node the child with most words is heavy, the others are light, so that a word's path
has at most log2(words) light edges. The light subtrees of a node are merged, with one character skipped or replaced,
into each other and into the heavy one; terminals that coincide are words one edit apart. Two words meet at the node
where they part, and there only, so that each pair is found once.

The trie is never built whole: words are range-partitioned in order, a task has one range, where nodes are runs of
words with a common prefix, and the children of nodes that may go on beyond a range are counted over all ranges first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Words of a range, which one task holds.
RANGE = 20_000
#: A maximal run of letters.
RUN = "[A-Za-zÀ-ÿ]+"
_EMITS = pa.schema([("kind", pa.string()), ("depth", pa.int32()), ("key", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_EDGES = pa.schema([("node", pa.int64()), ("char", pa.string()), ("n", pa.int64())])


def _common(a: str, b: str) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def prefix_keys(word: str) -> list[int]:
    """A 64-bit number for each prefix of a word, the empty one first."""
    rolled = accumulate((ord(c) + 1 for c in word), lambda h, x: ((h ^ x) * 0x9E3779B97F4A7C15 + (h >> 29)) & (2**64 - 1), initial=0x2545F4914F6CDD1D)
    return [(h ^ d * 0xD6E8FEB86659FD93) % 2**64 - 2**63 for d, h in enumerate(rolled)]


def _nodes(words: list[str], shared: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
    """(depth, first, end, where children part) of the nodes at which words of a sorted list part, by a stack over their common prefixes."""
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]
    for i in range(1, len(words) + 1):
        depth, left = (int(shared[i]) if i < len(words) else -1), i - 1
        while stack and stack[-1][0] > depth:
            d, left, parts = stack.pop()
            if parts:
                yield d, left, i, parts
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(i)
        elif depth >= 0:
            stack.append((depth, left, [i]))


def _edge(words: list[str], shared: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
    """The same of all prefixes of the first and the last word, parting or not: the nodes that other ranges may share."""
    first, last, m = words[0], words[-1], len(words)
    both = _common(first, last)
    for d in range(len(first) + 1):
        end = m if d <= both else 1 + int(np.argmax(np.append(shared[1:] < d, True)))
        yield d, 0, end, [int(i) for i in np.flatnonzero(shared[1:end] == d) + 1]
    for d in range(both + 1, len(last) + 1):
        start = m - 1 - int(np.argmax(np.append((shared[1:] < d)[::-1], True)))
        yield d, start, m, [int(i) for i in np.flatnonzero(shared[start + 1 : m] == d) + start + 1]


def _children(words: list[str], node: tuple[int, int, int, list[int]]) -> list[tuple[str, int, int]]:
    """(character, first, end) of a node's children; the empty character is the word that ends there."""
    d, left, right, parts = node
    bounds = [left, *parts, right]
    return [(words[a][d : d + 1], a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _sorted(table: pa.Table) -> tuple[list[str], list[int], np.ndarray]:
    rows = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    words = [w for w, _ in rows]
    return words, [n for _, n in rows], np.array([0] + [_common(a, b) for a, b in zip(words, words[1:])])


def _edge_counts(table: pa.Table) -> pa.Table:
    words, _, shared = _sorted(table)
    keys = {0: prefix_keys(words[0]), len(words) - 1: prefix_keys(words[-1])}
    out = []
    for node in _edge(words, shared):
        key = keys[0 if node[1] == 0 else len(words) - 1][node[0]]
        out += [(key, c, b - a) for c, a, b in _children(words, node)]
    return pa.table([list(x) for x in zip(*out, strict=True)] if out else [[], [], []], schema=_EDGES)


def _merged(table: pa.Table, heavy: pa.Table) -> pa.Table:
    """What each word of a light subtree becomes in the trees it is merged into."""
    if not table.num_rows:
        return _EMITS.empty_table()
    words, counts, shared = _sorted(table)
    outer = dict(zip(heavy.column("node").to_pylist(), heavy.column("heavy").to_pylist(), strict=True))
    ends = {0: prefix_keys(words[0]), len(words) - 1: prefix_keys(words[-1])}
    edge, out, done = list(_edge(words, shared)), [], set()
    todo = [(node, outer.get(ends[0 if node[1] == 0 else len(words) - 1][node[0]], "")) for node in edge]
    done = {(d, left) for (d, left, _, _), _ in todo}
    todo += [(node, None) for node in _nodes(words, shared) if (node[0], node[1]) not in done]
    for node, most in todo:
        d, children = node[0], _children(words, node)
        if most is None:
            most = max(((b - a, -ord(c), c) for c, a, b in children if c), default=(0, 0, ""))[2]
        for c, a, b in children:
            if c == most:
                continue
            for i in range(a, b):
                w, n = words[i], counts[i]
                if most:
                    out.append(("look", d, w[:d] + most + w[d:], w, n))  # the heavy tree's character skipped
                if c:
                    if most:
                        out.append(("look", d, w[:d] + most + w[d + 1 :], w, n))  # replaced by the heavy one
                    if w[d + 1 : d + 2] != c:
                        out.append(("look", d, w[:d] + w[d + 1 :], w, n))  # its own skipped
                    out.append(("meet", d, w[:d] + w[d + 1 :], w, n))  # any other light one in its place
    return pa.table([list(x) for x in zip(*out, strict=True)], schema=_EMITS) if out else _EMITS.empty_table()


def edits(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word(word, n) that has one at one inserted, deleted or replaced code point: how many, and of those the one of largest n (ties: least in code-point order) with its n. Words must be distinct."""
    spark = words.sparkSession
    held = cut(words.select("word", "n"))
    ranges = max(1, -(-held.count() // RANGE))
    held = cut(held.repartitionByRange(ranges, "word").withColumn("range", F.spark_partition_id()))
    counts = held.groupBy("range").applyInArrow(_edge_counts, "node long, char string, n long").groupBy("node", "char").agg(F.sum("n").alias("n"))
    # The most words, then the least character; a word's end is no child to merge into.
    heavy = cut(counts.where("char <> ''").groupBy("node").agg(F.min_by("char", F.struct(-F.col("n"), "char")).alias("heavy")))
    ends = held.groupBy("range").agg(F.min("word").alias("a"), F.max("word").alias("b"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sorted({*prefix_keys(a), *prefix_keys(b)})
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(own), pa.int32()), pa.array(own, pa.int64())], ["range", "node"])

    outer = ends.mapInArrow(keys, "range int, node long").join(heavy, "node")
    emits = cut(held.groupBy("range").cogroup(outer.groupBy("range")).applyInArrow(_merged, "kind string, depth int, key string, word string, n long"))
    found = emits.where("kind = 'look'").select("key", F.col("word").alias("w"), F.col("n").alias("wn")).join(held.select("word", "n"), F.col("key") == F.col("word"))
    ends_ = [F.struct("w", "wn", F.col("word").alias("o"), F.col("n").alias("on")), F.struct(F.col("word").alias("w"), F.col("n").alias("wn"), F.col("w").alias("o"), F.col("wn").alias("on"))]
    looked = found.select(F.explode(F.array(*ends_)).alias("x")).select(F.col("x.w").alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col("x.on")).alias("k"), F.col("x.o").alias("o")).alias("best"))
    # Words that meet differ in one character each: as many as there are characters. The best of the others is the first, or for the first the second.
    ordered = emits.where("kind = 'meet'").groupBy("depth", "key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("word").alias("o")))).alias("all")).where(F.size("all") > 1)
    met = ordered.select("all", F.posexplode("all").alias("i", "x")).select(F.col("x.o").alias("word"), (F.size("all") - 1).cast("long").alias("near"), F.element_at("all", F.when(F.col("i") == 0, 2).otherwise(1)).alias("best"))
    return looked.unionByName(met).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("b")).select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.o").alias("best"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """words(word, n) -> word, form, root, n, n_near, form_n: a word's form is its near word of largest n (ties: least in code-point order) if that is `ratio` times its own at least; root follows forms to the last.

    Repeated words are added up, a null n counts as 0, null words are left out; every other word comes back, with n_near
    0 if none is near. Letters that differ in case or accent are different characters. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be commoner than their variants")
    held = cut(words.where("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))
    near = edits(held)
    good = (F.col("best_n") >= F.col("n") * ratio) & (F.col("best_n") > F.col("n"))
    out = cut(held.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    # n grows tenfold with each step, so that few rounds of doubling reach the end.
    hops = cut(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = cut(hops.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not hops.where("moved").take(1):
            break
        hops = hops.drop("moved")
    return out.join(hops.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def run_counts(docs: DataFrame, least: int = 7, least_n: int = 2, slip: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the letter runs of all whole texts, A-Z lower-cased, of `least` code points and `least_n` occurrences at least.

    With `slip`, a run whose crc32 of `id:run` is divided by it first loses the code point at that number modulo its
    length: misspellings by a rule. Null texts have no runs, a null id counts as empty; every row counts.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(RUN), F.lit(0))).alias("run"))
    if slip:
        h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
        runs = runs.withColumn("h", h).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
        lost = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
        runs = runs.select(F.when(F.col("h") % slip == 0, lost).otherwise(F.col("run")).alias("run"))
    return runs.where(F.length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_n)
