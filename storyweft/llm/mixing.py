"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies, target over source size. Pairs of
documents then trade mass along the direction that leaves their words' sum alone, up or down at random so that each
expectation stays, until one of them is a whole number. A bucket of documents leaves one fractional document per
source; those residuals are paired again in a reduction tree, until one per source is left. That one, often a large
document, is rounded to the nearest, and the words that the source is then short of or over are made up by whole
documents that are smaller, taken once more or once less.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: A document is taken this many times at most.
MOST_COPIES = 3
#: Documents of a first bucket, of all sources.
BUCKET = 20_000
#: Residuals of a source that one task of the tree pairs.
TREE = 256
#: Documents drawn of a source, and as many of its smallest, that may make up for its last one.
TRADED = 2048
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """From (source, source_size), adds target: sources by code point, null last, get `weights` in turn and share the total; what is above `most` times a source's size is shared anew by weight until none is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    # One row per source, not per document.
    state = cut(sizes.withColumn("w", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * most))
    total = float(state.agg(F.sum("source_size")).first()[0] or 0)
    level, above = None, F.lit(False)
    while True:
        fixed, weight, n = state.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w"))), F.count(F.when(above, 1))).first()
        left, weight = total - (fixed or 0.0), weight or 0.0
        if level == (n,) or not weight:
            break
        level = (n,)
        share = F.lit(left) * F.col("w") / F.lit(weight)
        above = above | (share > F.col("cap"))
    target = F.when(above, F.col("cap")).otherwise(F.lit(left) * F.col("w") / F.lit(weight)) if weight else F.col("cap")
    return state.select("source", "source_size", target.alias("target"))


def _coin(seed: int, *parts) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivotal(keys: list, size: list[int], p: list[float], seed: int) -> list[float]:
    """Rounds p to whole numbers, all but one; the sum of size * p stays, and so does each expectation. Of a pair the smaller is mostly settled, so that the one left is often large."""
    out, held = list(p), None
    for i in sorted(range(len(p)), key=lambda i: (-size[i], str(keys[i]))):
        if out[i] in (0.0, 1.0):
            continue
        if held is None:
            held = i
            continue
        a, b, sa, sb = out[held], out[i], float(size[held]), float(size[i])
        up = min((1 - a) * sa, b * sb)  # words that may go from i to held
        down = min(a * sa, (1 - b) * sb)
        if _coin(seed, keys[held], keys[i]) * (up + down) < down:
            a, b, full = a + up / sa, b - up / sb, (1 - a) * sa <= b * sb
            a, b = (1.0, b) if full else (a, 0.0)
        else:
            full = a * sa <= (1 - b) * sb
            a, b = (0.0, b + down / sb) if full else (a - down / sa, 1.0)
        out[held], out[i] = a, b
        done = [x for x in (held, i) if out[x] <= 1e-12 or out[x] >= 1 - 1e-12]
        for x in done:
            out[x] = float(round(out[x]))
        open_ = [x for x in (held, i) if x not in done]
        held = open_[0] if open_ else None
    return out


def _round(seed: int):
    def run(table: pa.Table) -> pa.Table:
        keys, size, p, src = (table.column(c).to_pylist() for c in ("key", "size", "p", "source"))
        own: dict[str | None, list[int]] = {}
        for i, s in enumerate(src):
            own.setdefault(s, []).append(i)
        p = list(p)
        for at in own.values():
            for i, x in zip(at, pivotal([keys[i] for i in at], [size[i] for i in at], [p[i] for i in at], seed), strict=True):
                p[i] = x
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).select(["key", "source", "size", "p"])

    return run


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with a running number, from 0, of those that share a key. Which of them gets which number is left open; a key's rows are counted by partition, so that no task needs them all. `rows` must be read from files."""
    several = cut(rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1"))
    if not several.head(1):
        return rows.withColumn(name, F.lit(0).cast("long"))
    marked = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).join(several, F.col(key) == F.col("_key"), "left")
    # Written, so that partitions and places are the same in both uses.
    some = cut(marked.where("_n is not null").drop("_key", "_n"))
    before = some.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_m"))
    before = before.withColumn("_before", F.coalesce(F.sum("_m").over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_at")) - 1
    some = some.withColumn("_place", place).join(before, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")))
    some = some.withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).select(*rows.columns, name)
    return marked.where("_n is null").select(*rows.columns, F.lit(0).cast("long").alias(name)).unionByName(some)


def row_key(id_column: Column, source: Column, text_hash: Column) -> Column:
    """One string for an id, source and text; null ids and sources have their own."""
    return F.concat_ws(":", F.coalesce(id_column.cast("string"), F.lit("-")), text_hash.cast("string"), F.coalesce(F.concat(F.lit("s"), source), F.lit("-")))


def _made_up(table: pa.Table) -> pa.Table:
    """Which of a source's candidates are taken once more or less: the largest first, as long as they fit into what is missing."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("size", "key", "short")), strict=True), key=lambda r: (-r[0], r[1]))
    left, out = abs(rows[0][2]) if rows else 0.0, []
    for size, key, short in rows:
        if size <= left + 0.5:
            left -= size
            out.append((key, 1 if short > 0 else -1))
    return pa.table({"key": pa.array([k for k, _ in out], pa.string()), "step": pa.array([d for _, d in out], pa.int64())})


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size, source_size, target, copies, taken (= copies * size), its source, text_hash (xxhash64 of the text) and repeat (its number among equal rows); no row is taken more than three times.

    Null text has size 0 and is never taken; null sources form one source, the last. Repeated ids are told apart by
    their text's hash; rows that are repeated with id, source and text are rounded one by one, so that they get the same
    copies in some order on every run. All choices come from hashes, so reruns agree. A source's taken words miss its
    target by less than its smallest documents, if TRADED of them are enough to make up for one document. An empty table
    gives no rows.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("h"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
    )
    base = cut(base)
    targets = cut(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(0.0))
    told = numbered(base.withColumn("key", row_key(F.col("id"), F.col("source"), F.col("h"))), "key", "repeat").withColumn("key", F.concat_ws("#", "key", "repeat"))
    rows = told.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target", rate.alias("rate"))
    own = rows.select("key", "source", "size", (F.col("rate") - F.floor("rate")).alias("p")).where("size > 0 and p > 0")
    kind = "key string, source string, size long, p double"
    done, turn = [], 0
    parts = math.ceil(max(1, base.count()) / BUCKET)
    level = cut(own.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("g").applyInArrow(_round(seed), kind))
    while True:
        done.append(level.where("p in (0, 1)"))
        rest = level.where("p not in (0, 1)")
        most = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        turn += 1
        if most <= 1:
            break
        part = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(math.ceil(most / TREE)))
        level = cut(rest.withColumn("g", F.xxhash64("source", part)).groupBy("g").applyInArrow(_round(seed + turn), kind))
    nearest = F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)
    rounded = rest.withColumn("p", nearest)
    for d in done:
        rounded = rounded.unionByName(d)
    copies = F.when(F.col("size") > 0, F.floor("rate") + F.coalesce(F.col("p"), F.lit(0.0)).cast("long")).otherwise(F.lit(0)).cast("long")
    out = cut(rows.join(rounded.select(F.col("key").alias("of"), "p"), F.col("key") == F.col("of"), "left").select("id", "key", "repeat", "source", "h", "size", "source_size", "target", copies.alias("copies")))
    # What each source is short of (above 0) or over, after its last document was rounded.
    short = cut(rest.select("source", F.col("key").alias("last"), ((F.col("p") - nearest) * F.col("size")).alias("short")).where("abs(short) >= 1"))
    able = F.when(F.col("short") > 0, F.col("copies") < MOST_COPIES).otherwise(F.col("copies") > 0)
    small = out.alias("o").join(short.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).where(able & (F.col("key") != F.col("last")) & (F.col("size") > 0) & (F.col("size") <= F.abs("short")))
    small = small.select("o.key", "o.size", "o.source", "short")
    drawn = small.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("key", F.lit(seed)), "key"))).where(F.col("rn") <= TRADED).drop("rn")
    least = small.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("size", F.xxhash64("key", F.lit(seed)), "key"))).where(F.col("rn") <= TRADED).drop("rn")
    traded = drawn.unionByName(least).distinct().groupBy("source").applyInArrow(_made_up, "key string, step long")
    final = out.join(traded.select(F.col("key").alias("of"), "step"), F.col("key") == F.col("of"), "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0)))
    return final.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("source").alias(source_col), F.col("h").alias("text_hash"), "repeat")
