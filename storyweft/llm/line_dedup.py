"""Line dedup: a suffix array over line-id sequences, by distributed prefix doubling.

Lines become 64-bit ids. Suffixes start at lines whose id occurs again somewhere and are ranked by doubling: a class's
rank is where it starts in the array, and a round splits it by the rank that stands one step further on, until classes
have one member or reach the end of their repeated stretch. Common prefixes with the suffix before are computed where
the lines before differ and follow in text order elsewhere. A stack scan over common-prefix intervals then finds for
each suffix the longest run that an earlier place has too; lines of such runs are deleted. The array is scanned in
chunks of ranks, however common a line is; the few suffixes of a chunk that may share more with one outside it are
scanned once more over all chunks of their class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, fanout, unused
from .tokens import portions

#: A repeated run is deleted when it has this many words or more: with one, all but runs of blank lines.
MIN_WORDS = 1
_DOC = ["id", "h"]
_PLACE = ["id", "h", "ln"]


def _sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, v: line ids, w: words by line), one row per distinct (id, text)."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.transform(lines, lambda x: F.xxhash64(x)).alias("v"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))).alias("w"),
    ).dropDuplicates(_DOC)


def _ranked(lines: DataFrame) -> DataFrame:
    """(id, h, ln, left, first, end, r, s): suffixes at repeated lines; first is the rank of the first line, end where the repeated stretch ends, r the rank so far."""
    same = lines.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    # A class starts after all smaller ids: whole shards of the id space before its own (4096 sums), then its own shard's.
    same = cut(same.withColumn("shard", F.shiftrightunsigned("v", 52)))
    sums = same.groupBy("shard").agg(F.sum("n").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sums.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    classes = same.join(F.broadcast(shards), "shard").select("v", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"))
    along = lines.join(classes, "v").withColumn("island", F.col("ln") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("ln")))
    end = F.max("ln").over(Window.partitionBy(*_DOC, "island"))
    return cut(along.select(*_PLACE, "left", "first", end.alias("end"), F.col("first").alias("r"), F.lit(0).alias("s")))


def suffix_ranks(lines: DataFrame) -> DataFrame:
    """Prefix doubling; s is 0 while a suffix is open, then the step that settled it."""
    state, step = _ranked(lines), 1
    along = Window.partitionBy(*_DOC).orderBy("ln")
    while state.where("s = 0").head(1):
        there = F.lead("ln", step).over(along) == F.col("ln") + step
        next_ = state.withColumn("r2", F.when(there, F.lead("r", step).over(along)).otherwise(F.lit(-1)))
        next_ = cut(next_)
        keys = next_.where("s = 0").groupBy("r", "r2").agg(F.count("*").alias("n"))
        smaller = Window.partitionBy("r").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
        keys = keys.select("r", "r2", "n", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("by"))
        moved = next_.where("s = 0").join(keys, ["r", "r2"]).select(
            *_PLACE, "left", "first", "end", (F.col("r") + F.col("by")).alias("r"), F.when((F.col("n") == 1) | (F.col("r2") < 0), step).otherwise(0).alias("s")
        )
        state = cut(next_.where("s > 0").drop("r2").unionByName(moved))
        step *= 2
    return state


def _chunked(ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One suffix of each final rank, that of the least place, with its chunk of the array, and the others.

    Suffixes of one rank are equal to the end of their repeated stretch, so that the others have the whole stretch from
    an earlier place. Chunks are ranges of ranks, as many as suit the cluster; a class of any size is cut by them."""
    spark = ranks.sparkSession
    # Written first: the join with it is then a plain one, whose common ranks can be split.
    one = cut(ranks.groupBy("r").agg(F.min(F.struct(*_PLACE)).alias("p")))
    marked = cut(ranks.join(one, "r").withColumn("least", F.struct(*_PLACE) == F.col("p")).drop("p"))
    top = marked.agg(F.max("r")).first()[0]
    width = max(1, -(-(int(top or 0) + 1) // (fanout(spark) * 4)))
    return marked.where("least").drop("least").withColumn("chunk", F.expr(f"r div {width}")), marked.where("not least")


def common_prefixes(heads: DataFrame, seqs: DataFrame) -> DataFrame:
    """`heads` with lcp, the lines shared with the suffix before it in the array."""
    seen = ["id", "h", "ln", "left", "first"]
    order = Window.partitionBy("chunk").orderBy("r")
    inside = heads.select("*", *[F.lag(c).over(order).alias(f"p_{c}") for c in seen], F.row_number().over(order).alias("k"))
    # The suffix before a chunk's first is the last of the chunk before: one row a chunk.
    ends = heads.groupBy("chunk").agg(F.max_by(F.struct(*seen), "r").alias("e"))
    before = ends.select("chunk", F.lag("e").over(Window.orderBy("chunk")).alias("e"))
    rows = inside.join(F.broadcast(before), "chunk")
    rows = rows.withColumns({f"p_{c}": F.when(F.col("k") == 1, F.col(f"e.{c}")).otherwise(F.col(f"p_{c}")) for c in seen}).drop("e", "k")
    same_class = F.coalesce(F.col("p_first") == F.col("first"), F.lit(False))
    rows = cut(rows.withColumns({f"p_{c}": F.when(same_class, F.col(f"p_{c}")) for c in seen}))
    # Where the lines before are equal, the common prefix is one less than theirs.
    own = rows.where("p_id is not null and (left is null or p_left is null or left <> p_left)")
    a = own.join(seqs.select("id", "h", "v"), _DOC).select(*_PLACE, "s", "p_id", "p_h", "p_ln", F.slice("v", F.col("ln") + 1, F.col("s") * 2).alias("va"))
    there = seqs.select(F.col("id").alias("p_id"), F.col("h").alias("p_h"), F.col("v"))
    same = F.zip_with("va", F.slice("v", F.col("p_ln") + 1, F.col("s") * 2), lambda x, y: F.coalesce(x == y, F.lit(False)))
    b = a.join(there, ["p_id", "p_h"]).select(*_PLACE, same.alias("same"))
    b = b.select(*_PLACE, F.when(F.array_contains("same", False), F.array_position("same", False) - 1).otherwise(F.size("same")).alias("lcp"))
    rows = rows.join(b, _PLACE, "left").withColumn("lcp", F.when(F.col("p_id").isNull(), F.lit(0)).otherwise(F.col("lcp")))
    back = Window.partitionBy(*_DOC).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*_PLACE, "first", "chunk", "r", (F.last(F.col("lcp") + F.col("ln"), ignorenulls=True).over(back) - F.col("ln")).alias("lcp"))


def longest_earlier(pos: list[int], lcp: list[int]) -> list[int]:
    """For each suffix in array order, the longest common prefix with one of a smaller position. One pass; the stack holds an interval's length and least position so far, so memory is bounded by depth."""
    out = dict.fromkeys(pos, 0)
    stack: list[tuple[int, int]] = []
    now = pos[0] if pos else 0
    for t in range(1, len(pos) + 1):
        v = lcp[t] if t < len(pos) else 0
        while stack and stack[-1][0] > v:
            length, least = stack.pop()
            out[max(now, least)] = length
            now = min(now, least)
        if v and stack and stack[-1][0] == v:
            least = stack.pop()[1]
            out[max(now, least)] = v
            now = min(now, least)
        if v:
            stack.append((v, now))
            now = pos[t]
        elif t < len(pos):
            now = pos[t]
    return [out[p] for p in pos]


def _places(table: pa.Table) -> np.ndarray:
    """The order of the rows' places."""
    ids, h, ln = (table.column(c).to_numpy() for c in _PLACE)
    pos = np.empty(len(ids), np.int64)
    pos[np.lexsort((ln, h, ids))] = np.arange(len(ids))
    return pos


def _scan(table: pa.Table) -> pa.Table:
    """The longest earlier run inside one chunk; `gap` where a suffix may have a longer one outside it.

    Only one that is before all to its left, or before all to its right, in the chunk can: any other has a neighbour
    on that side that is earlier and has more in common with it. `gap` is the least common prefix since the last such one."""
    table = table.sort_by([("r", "ascending")])
    pos, first, lcp = _places(table), table.column("first").to_numpy(), table.column("lcp").to_numpy()
    run = np.array(longest_earlier(pos.tolist(), np.concatenate(([0], lcp[1:])).tolist()), np.int64)
    # A class that ends in the chunk has no neighbours beyond: only the chunk's first and last class do.
    outer = np.zeros(len(pos), bool)
    for of, at in ((pos, np.arange(len(pos))), (pos[::-1], np.arange(len(pos))[::-1])):
        low = np.minimum.accumulate(of)
        edge = at[of == low]
        outer[edge[first[edge] == first[at[0]]]] = True
    held = np.flatnonzero(outer)
    gap = np.full(len(pos), -1, np.int64)
    gap[held] = [lcp[a : b + 1].min() for a, b in zip([0, *(held[:-1] + 1)], held, strict=True)]
    return pa.table({**{c: table.column(c) for c in (*_PLACE, "first", "r")}, "run": run, "gap": gap})


def _across(table: pa.Table) -> pa.Table:
    """The longest earlier runs over the marked suffixes of classes that lie in several chunks."""
    table = table.sort_by([("first", "ascending"), ("r", "ascending")])
    first, gap = table.column("first").to_numpy(), table.column("gap").to_numpy()
    start = np.concatenate(([True], first[1:] != first[:-1])) if len(first) else np.zeros(0, bool)
    run = np.array(longest_earlier(_places(table).tolist(), np.where(start, 0, gap).tolist()), np.int64)
    return pa.table({**{c: table.column(c) for c in _PLACE}, "run": run})


def _removed(total: np.ndarray, at: np.ndarray, run: np.ndarray, min_words: int) -> np.ndarray:
    """Which lines go: those of runs with words enough. `total`: words before each line, and all."""
    held = total[at + run] - total[at] >= min_words
    change = np.zeros(len(total), np.int64)
    np.add.at(change, at[held], 1)
    np.add.at(change, at[held] + run[held], -1)
    return np.cumsum(change[:-1]) > 0


def _parts(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list of a column begins (null as empty), and all values."""
    n = np.array([x or 0 for x in pc.list_value_length(column).to_pylist()], np.int64)
    return np.concatenate(([0], np.cumsum(n))), column.flatten()


def _strip(min_words: int, names: list[str], text_col: str, w_col: str, runs_col: str):
    def run(batches):
        for whole, _ in portions(batches, text_col):
            texts = whole.column(text_col).to_pylist()
            first, w = _parts(whole.column(w_col))
            of, runs = _parts(whole.column(runs_col))
            at = runs.field("ln").to_numpy() + np.repeat(first[:-1], np.diff(of))
            total = np.concatenate(([0], np.cumsum(w.to_numpy())))
            gone = _removed(total, at, runs.field("run").to_numpy(), min_words)
            kept, n, cut_ = [], [], []
            for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
                x = int(gone[a:b].sum())
                n.append(0 if t is None else b - a if b > a else t.count("\n") + 1)
                cut_.append(x)
                kept.append(t if not x else "\n".join(line for line, g in zip(t.split("\n"), gone[a:b].tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays([*[whole.column(c) for c in names], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(cut_, pa.int64())], names=[*names, "kept_text", "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with kept_text, n_lines, n_removed: a line is deleted if it is in a run of lines, of `min_words` words or more in all, that also stands at an earlier place (smaller id, or earlier in the text; the two may overlap).

    Null texts have no lines and stay null; rows with a null id neither lose lines nor count as a source. Repeated rows
    count once, and each comes back. Texts with one id are ordered by their hash. Empty tables give no rows. Columns
    of docs named like the three new ones are replaced, all others come back as they are.
    """
    docs = docs.drop("kept_text", "n_lines", "n_removed")
    seqs = cut(_sequences(docs, id_col, text_col))
    lines = seqs.select("id", "h", "v", F.posexplode("v").alias("ln", "x")).select("id", "h", "ln", F.when(F.col("ln") > 0, F.element_at("v", F.col("ln"))).alias("left"), F.col("x").alias("v"))
    heads, rest = _chunked(suffix_ranks(lines))
    marked = cut(common_prefixes(heads, seqs).groupBy("chunk").applyInArrow(_scan, "id long, h long, ln int, first long, r long, run long, gap long"))
    across = marked.where("gap >= 0").withColumn("g", F.pmod(F.xxhash64("first"), F.lit(fanout(docs.sparkSession))))
    runs = marked.select(*_PLACE, "run").unionByName(across.groupBy("g").applyInArrow(_across, "id long, h long, ln int, run long")).where("run > 0")
    runs = runs.unionByName(rest.select(*_PLACE, (F.col("end") - F.col("ln") + 1).cast("long").alias("run")))
    by_doc = runs.groupBy(*_DOC).agg(F.collect_list(F.struct("ln", "run")).alias("runs"))
    own = unused(docs.columns, "id", "h", "w", "runs")
    found = cut(seqs.select("id", "h", "w").join(by_doc, _DOC).toDF(*own))
    joined = docs.join(found, (F.col(id_col).cast("long") == F.col(own[0])) & (F.xxhash64(text_col) == F.col(own[1])), "left")
    kind = docs.withColumns({"kept_text": F.lit(""), "n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    for f in kind:
        f.nullable = True
    return joined.mapInArrow(_strip(min_words, docs.columns, text_col, *own[2:]), kind)
