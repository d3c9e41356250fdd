"""Near-dedup by a chosen-path set similarity join (Christiani, Pagh, Sivertsen).

A document's set is its distinct word shingles. In each of several independent trees a document walks down by the minwise
token of its set under a hash that depends on the path so far; similar sets choose the same tokens. A node that is
small enough is compared there, a large one is branched further; one that is large at the last level is a candidate
as a whole. Comparing in a node joins documents whose sketches may pass into candidate components; within each
candidate component links are confirmed on full sets, in one task, or by a distributed prefix-filter join if it is large.
"""

from __future__ import annotations

import hashlib
import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, fanout
from .tokens import mix, octets, portions, shingles, words

#: Depths of nodes, and how likely all trees may miss a pair of just the similarity sought, however large its nodes are.
LEVELS, MISS = (3, 6), 1e-4
#: Sets in a node that are compared there; larger nodes are branched, at the last level all their sets are candidates.
NODE = 1024
#: Hashes of a bottom-k sketch. A set whose estimate with a leader is SLACK below the similarity sought or better is no leader itself; SLACK is 5 standard errors.
SKETCH, SLACK = 64, 0.25
#: Candidate components of more sets are confirmed by a join, not in one task.
GATHER = 4096
#: Classes of tokens whose counts order the prefixes of that join. Any order is exact; rare tokens first make short lists.
CLASSES = 1 << 18
#: Pairs a listed token that are compared at once; while there are more, sets are compared with one of each list first, which leaves fewer pairs that are not connected yet.
PAIRS = 16
#: Sets of a block; pairs are compared block against block.
BLOCK = 512
_NONE = np.uint32(0xFFFFFFFF)


def trees(percent: int) -> int:
    """Trees that meet MISS at the last level, where a pair of similarity s shares a node with s^depth: 20 for 85, 31 for 80."""
    together = min((percent / 100) ** LEVELS[-1], 0.999)
    return max(1, math.ceil(math.log(MISS) / math.log1p(-together)))


def paths(tokens: np.ndarray, n_trees: int) -> np.ndarray:
    """Node keys, levels x trees, of a set of tokens."""
    state, out = mix(np.arange(1, n_trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), []
    for depth in range(1, LEVELS[-1] + 1):
        ranks = (tokens[None, :] + state[:, None]) * (mix(state) | np.uint64(1))[:, None]
        state = mix(state * np.uint64(0xA0761D6478BD642F) + tokens[ranks.argmin(axis=1)])
        if depth in LEVELS:
            out.append(state)
    return np.array(out)


def sketch(tokens: np.ndarray) -> np.ndarray:
    low = np.unique((mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    return np.concatenate([low, np.full(SKETCH - len(low), _NONE, np.uint32)])


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one sketch and each row of many, from the hashes that both sketches are complete for."""
    last = np.minimum(one[-1], many[:, -1])[:, None]
    own = one[one != _NONE]
    at = np.minimum(np.searchsorted(own, many), len(own) - 1)
    below = (many <= last) & (many != _NONE)
    both = ((own[at] == many) & below).sum(axis=1)
    union = below.sum(axis=1) + np.searchsorted(own, last[:, 0], "right") - both
    return both / np.maximum(union, 1)


def star_edges(ids: np.ndarray, sk: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects all pairs whose sketches may pass: every set joins each leader that it may share a partner with, or becomes one; an edge inside a tree is left out."""
    a, b, root, rest = [], [], np.arange(len(ids)), np.arange(len(ids))
    lead = percent / 100 - SLACK
    # A partner of one that joined the leader may be as far from it as both distances together, and 0.1 for the estimate.
    least = lead + percent / 100 - 1.1 if len(ids) > 2 else lead
    while len(rest) > 1:
        at = rest[0]
        est = estimates(sk[at], sk)
        near = root[est >= least - 1e-9]
        near = np.unique(near[near != root[at]])
        a.append(np.full(len(near), ids[at]))
        b.append(ids[near])
        root[np.isin(root, near)] = root[at]
        rest = rest[1:][est[rest[1:]] < lead - 1e-9]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Components under 100 * intersection >= percent * union, as each set's root: exact, by prefix filter over rare tokens; pairs that are connected already are not looked at."""
    n = len(sets)
    root = np.arange(n)
    if n < 2:
        return root
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    common = np.sort(count) > 1
    ranked, at = rank[at], np.concatenate(([0], np.cumsum(sizes)))
    own = [np.sort(ranked[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    index: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable"):
        x = own[i]
        keep = len(x) - -(-percent * len(x) // 100) + 1
        lists = []
        for t in x[:keep].tolist():
            if common[t]:
                have = index.setdefault(t, [])
                if have:
                    lists.append(have[:])
                have.append(i)
        if not lists:
            continue
        cand = np.unique(np.concatenate([np.asarray(y) for y in lists]))
        cand = cand[sizes[cand] * 100 >= percent * len(x)]
        for j in cand[root[cand] != root[i]].tolist():
            if root[j] == root[i]:
                continue
            both = int(np.isin(x, own[j], assume_unique=True).sum())
            if 100 * both >= percent * (len(x) + len(own[j]) - both):
                lo, hi = min(root[i], root[j]), max(root[i], root[j])
                root[root == hi] = lo
    return root


def _profiles(n_words: int, n_trees: int):
    def run(batches):
        for batch, texts in portions(batches, "text"):
            h, at = words(texts)
            size, fp, keys, sk = [], [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                s = shingles(h[a:b], n_words)
                size.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(paths(s, n_trees).tobytes() if len(s) else None)
                sk.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.binary()), pa.array(sk, pa.binary())], names=["id", "n", "fp", "keys", "sk"])

    return run


def _node_keys(level: int, n_trees: int):
    """(key, rep) rows of one level from profiles (rep, keys)."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64).reshape(len(batch), len(LEVELS), n_trees)[:, level]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), n_trees)), pa.array(keys.reshape(-1))], names=["rep", "key"])

    return run


def _stars(percent: int):
    """Star edges of the nodes of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("rep", "ascending")])
        ids, key = (table.column(c).to_numpy() for c in ("rep", "key"))
        sk = np.frombuffer(b"".join(table.column("sk").to_pylist()), np.uint32).reshape(-1, SKETCH)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        out = [star_edges(ids[a:b], sk[a:b], percent) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1]
        a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).group_by(["a", "b"]).aggregate([])

    return run


def _sets(n_words: int):
    def run(batches):
        for batch, texts in portions(batches, "text"):
            h, at = words(texts)
            blobs = [shingles(h[a:b], n_words).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(blobs, pa.large_binary()).cast(pa.binary())], names=["rep", "tokens"])

    return run


def _links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("rep", "ascending")])
        ids, grp, blobs = table.column("rep").to_numpy(), table.column("grp").to_numpy(), table.column("tokens")
        edge = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1], [True])))
        a, b = [], []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            own = ids[x:y]
            root = link_sets([np.frombuffer(v, np.uint64) for v in blobs.slice(x, y - x).to_pylist()], percent)
            far = root != np.arange(len(own))
            a.append(own[root[far]])
            b.append(own[far])
        return pa.table({"a": pa.array(np.concatenate(a) if a else [], pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})

    return run


def _nodes(reps: DataFrame, n_trees: int) -> tuple[DataFrame, DataFrame]:
    """(rep, key) of nodes with two sets or more that are compared, and edges (a, b) of those that are candidates as a whole. Level by level: a node of more than NODE sets is left to the next level."""
    out, open_ = None, None
    for level in range(len(LEVELS)):
        rows = reps.select("rep", "keys").mapInArrow(_node_keys(level, n_trees), "rep long, key long")
        if open_ is not None:
            rows = rows.join(open_, "rep", "left_semi")
        rows = cut(rows)
        count = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
        held = cut(rows.join(count, "key"))
        small = held.where(F.col("n") <= NODE).select("rep", "key")
        out = small if out is None else out.unionByName(small)
        large = held.where(F.col("n") > NODE)
        if level == len(LEVELS) - 1 or not (open_ := cut(large.select("rep").distinct())).head(1):
            return out, large.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    raise AssertionError


def _classes(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) >> np.uint64(20)).astype(np.int64) % CLASSES


def _counts(batches):
    """How many tokens of each class a batch has."""
    for batch in batches:
        if not len(batch):
            continue
        flat = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint64)
        of, n = np.unique(_classes(flat), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(n.astype(np.int64))], names=["of", "n"])


def _listed(percent: int, weight: np.ndarray):
    """(token, rep, size): the tokens of each set's prefix. Two sets that pass have one in common."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            own, size = [], []
            for blob in batch.column("tokens").to_pylist():
                x = np.frombuffer(blob, np.uint64)
                keep = len(x) - -(-percent * len(x) // 100) + 1
                own.append(x[np.lexsort((x, weight[_classes(x)]))[:keep]].view(np.int64))
                size.append(len(x))
            many = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(batch.column("rep").to_numpy(), many)), pa.array(np.repeat(np.array(size, np.int64), many))], names=["token", "rep", "size"])

    return run


def _compared(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for i, t in zip(right.column("rep").to_pylist(), right.column("tokens").to_pylist(), strict=True):
            sets.setdefault(i, []).append(np.frombuffer(t, np.uint64))
        a, b = [], []
        for i, j in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            for x, y in product(sets[i], sets[j]):
                both = int(np.isin(x, y, assume_unique=True).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(i)
                    b.append(j)
                    break
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _passing(pairs: DataFrame, sets: DataFrame, percent: int, n_sets: int) -> DataFrame:
    """Those of `pairs(a, b)` that pass on full sets, compared block against block."""
    blocks = -(-n_sets // BLOCK)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("g", block("a") * blocks + block("b")))
    wanted = pairs.select(F.col("g").alias("h"), F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets, "rep")
    return cut(pairs.groupBy("g").cogroup(wanted.groupBy("h")).applyInArrow(_compared(percent), "a long, b long"))


def join_links(sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """`links(a, b)` and as many more as connect all of `sets(rep, tokens)` that pass: exact, by lists of prefix tokens; pairs that are connected already are not compared."""
    weight = np.zeros(CLASSES, np.int64)
    for r in sets.mapInArrow(_counts, "of long, n long").groupBy("of").agg(F.sum("n").alias("n")).toLocalIterator():
        weight[r["of"]] = r["n"]
    n_sets = sets.count()
    lists = cut(sets.mapInArrow(_listed(percent, weight), "token long, rep long, size long"))
    room, turn, last = PAIRS * lists.count(), 0, False
    while True:
        label = cut(components(links))
        held = cut(lists.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component"))
        per = held.groupBy("token", "c").agg(F.count("*").alias("k"), F.min("rep").alias("one"))
        hub = F.min_by("one", F.xxhash64("c", F.lit(turn)))
        tokens = cut(per.groupBy("token").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("own"), F.count("*").alias("labels"), hub.alias("hub")).where("labels > 1"))
        many = tokens.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0]
        if not many:
            return links
        rows = held.join(tokens.select("token", "n", "hub"), "token")
        if last or many <= room:
            # All that is left; long lists are dealt to parts, each against the whole list.
            rows = cut(rows.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")))
            one = rows.select("token", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("size").alias("sa"))
            two = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("size").alias("sb"))
            fits = F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent
            pairs = one.join(two, ["token", "part"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b")
            return links.unionByName(_passing(pairs, sets, percent, n_sets))
        there = label.select(F.col("id").alias("hub"), F.col("component").alias("ch"))
        pairs = rows.join(there, "hub", "left").where(F.col("c") != F.coalesce("ch", "hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        more = _passing(pairs, sets, percent, n_sets)
        last = not more.head(1)
        links, turn = links.unionByName(more), turn + 1


def near_dups(docs: DataFrame, percent: int = 85, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable over links of percent / 100 similarity or more), kept (id = component_id).

    A text without words, or null, has an empty set and is linked with nothing. Shorter texts than a shingle are one
    shingle. Equal sets are one class, compared once. Rows with a null id are out of this relation: they come back
    with a null component and kept. Rows of one id share its component; if they have several texts,
    candidates are sought by the one of least fingerprint.
    """
    spark = docs.sparkSession
    n, n_trees = fanout(spark), trees(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiles = cut(texts.mapInArrow(_profiles(n_words, n_trees), "id long, n long, fp binary, keys binary, sk binary"))
    real = profiles.where("id is not null and n > 0")
    classes = cut(real.groupBy("fp").agg(F.min("id").alias("rep")))
    one = cut(real.join(classes, "fp").where("id = rep").groupBy("rep").agg(F.min_by("keys", "fp").alias("keys"), F.min_by("sk", "fp").alias("sk")))
    nodes, whole = _nodes(one, n_trees)
    held = nodes.join(one.select("rep", "sk"), "rep").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(n * 4)))
    edges = cut(held.groupBy("g").applyInArrow(_stars(percent), "a long, b long").unionByName(whole))
    groups = cut(components(edges))
    size = groups.groupBy("component").count()
    member = cut(groups.join(size, "component").select(F.col("id").alias("rep"), F.col("component").alias("grp"), F.col("count").alias("m")))
    few = member.where(F.col("m") <= GATHER).select("rep", "grp")
    many = member.where(F.col("m") > GATHER)
    big = bool(many.head(1))
    if big:
        # Linked in parts first, so that the join has little left to connect.
        few = few.unionByName(many.select("rep", F.xxhash64("grp", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / GATHER))).alias("grp")))
    wanted = member.select("rep")
    sets = texts.where("id is not null").withColumnRenamed("id", "rep").join(wanted, "rep").mapInArrow(_sets(n_words), "rep long, tokens binary")
    sets = cut(sets) if big else sets
    packed = sets.join(few, "rep").withColumn("g", F.pmod(F.xxhash64("grp"), F.lit(n * 4)))
    links = cut(packed.groupBy("g").applyInArrow(_links(percent), "a long, b long"))
    if big:
        links = join_links(cut(sets.join(many, "rep", "left_semi").distinct()), links, percent)
    final = components(links) if big else links.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component")
    # Written, so that what follows is a plain join, whose hot classes can be split.
    label = classes.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    label = cut(label)
    found = profiles.join(label, "fp", "left").select("id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
