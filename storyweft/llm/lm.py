"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, memory-mapped by the workers that score.

Counting goes down the orders. Portions of texts send their distinct n-grams, with counts, to shards by context; a
shard adds them up, writes its part of the model (sorted 64-bit hashes and their counts) to the shared folder, and sends
on what the next lower order needs: how many different words precede each shorter gram, and what follows each context.
Contexts of frequent words alone are spread over all shards by the whole gram, so that none holds more than its part.
Scoring reads texts where they stand: workers map the files and look up the distinct grams of a portion in hash order.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, fanout, shared_dir
from .tokens import mix, portions, words

_END, _START = np.uint64(0x656E64), np.uint64(0x7374617274)
_C = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose grams are counted, and looked up, at once.
COUNTED, SCORED = 12 << 20, 6 << 20
#: What is kept of a gram: its (adjusted) count, its raw count (words only), and as a context all that follows it: sum, followers counted once, twice, oftener.
_FIELDS = ("a", "c", "s0", "s1", "s2", "s3")
_MSG = "shard int, level int, blob binary, t array<long>"


def _key(cols: list[np.ndarray]) -> np.ndarray:
    h = cols[0]
    for w in cols[1:]:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + mix(w * _C))
    return h


def _shard(cols: list[np.ndarray], n: int, hot: np.ndarray) -> np.ndarray:
    """By context; by the whole gram if all words of the context are frequent."""
    whole = _key(cols)
    if len(cols) > 1:
        spread = np.ones(len(whole), bool)
        for w in cols[:-1]:
            spread &= np.isin(w, hot)
        whole = np.where(spread, whole, _key(cols[:-1]))
    return (mix(whole ^ _C) >> np.uint64(33)).astype(np.int64) % n


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _dump(parts: list[np.ndarray]) -> bytes:
    """Arrays in one blob: their number, widths and lengths, padded to 8 bytes each."""
    head = np.array([len(parts), *(v for p in parts for v in (p.dtype.itemsize, len(p)))], np.int64).tobytes()
    return head + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)


def _load(raw) -> list[np.ndarray]:
    """The arrays of a blob, without a copy."""
    flat = np.frombuffer(raw, np.uint8)
    many = int(flat[:8].view(np.int64)[0])
    shape = flat[8 : 8 + 16 * many].view(np.int64).reshape(-1, 2).tolist()
    out, at = [], 8 + 16 * many
    for width, n in shape:
        out.append(flat[at : at + width * n].view(f"u{width}"))
        at += width * n + -(width * n) % 8
    return out


def _packed(level: int, cols: list[np.ndarray], values: dict[str, np.ndarray], n: int, hot: np.ndarray) -> list[tuple]:
    """Rows for the shards: words as places in a message's own list of hashes, compressed."""
    to = _shard(cols, n, hot)
    order = np.lexsort((*cols[::-1], to))
    edge = np.searchsorted(to[order], np.arange(n + 1))
    out = []
    for s in np.flatnonzero(np.diff(edge)).tolist():
        o = order[edge[s] : edge[s + 1]]
        known, at = np.unique(np.concatenate([c[o] for c in cols]), return_inverse=True)
        at = at.reshape(len(cols), -1)
        head = np.array([_FIELDS.index(f) for f in values], np.uint8)
        raw = _dump([head, known, _narrow(np.diff(at[0], prepend=0)), *(_narrow(x) for x in at[1:]), *(_narrow(v[o]) for v in values.values())])
        out.append((s, level, len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True), None))
    return out


def _unpacked(level: int, blobs: list[bytes]) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    cols, values = [[] for _ in range(level)], {f: [] for f in _FIELDS}
    for b in blobs:
        head, known, first, *rest = _load(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True))
        for c, at in zip(cols, [np.cumsum(first, dtype=np.int64), *rest[: level - 1]], strict=True):
            c.append(known[at])
        own = dict(zip((_FIELDS[i] for i in head.tolist()), rest[level - 1 :], strict=True))
        for f in _FIELDS:
            values[f].append(own[f].astype(np.int64) if f in own else np.zeros(len(first), np.int64))
    return [np.concatenate(c) for c in cols], {f: np.concatenate(v) for f, v in values.items()}


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["shard", "level", "blob", "t"])


class _Tokens:
    """All tokens of some texts, each document behind order - 1 starts and with its end: word places, and for each order the distinct grams."""

    def __init__(self, texts: list[bytes], order: int):
        h, at = words(texts)
        size = np.diff(at) + 1
        self.size, pad = size, order - 1
        ends = np.cumsum(size + pad)
        seq = np.full(int(ends[-1]) if len(ends) else 0, _START, np.uint64)
        own = np.ones(len(seq), bool)
        for k in range(pad):
            own[ends - size - pad + k] = False
        self.at = np.flatnonzero(own)
        last = np.zeros(len(seq), bool)
        last[ends - 1] = True
        seq[own & ~last] = h
        seq[last] = _END
        self.vocabulary, self.seq = np.unique(seq, return_inverse=True)
        self.order = order

    def grams(self):
        """By order, from one up: where each distinct gram ends first, how often it stands, and which one ends at each token."""
        n, ids = len(self.vocabulary), self.seq
        for k in range(1, self.order + 1):
            if k > 1:
                code = np.zeros(len(self.seq), np.int64)
                code[1:] = ids[:-1] * n + self.seq[1:]
                ids = code if k == self.order else np.unique(code, return_inverse=True)[1]
            _, first, of, many = np.unique(ids[self.at], return_index=True, return_inverse=True, return_counts=True)
            yield k, self.at[first], of, many

    def words(self, ends: np.ndarray, k: int) -> list[np.ndarray]:
        return [self.vocabulary[self.seq[ends - j]] for j in range(k - 1, -1, -1)]


def _count_texts(order: int, n: int, hot: np.ndarray):
    def run(batches):
        for _, texts in portions(batches, "text", COUNTED):
            t = _Tokens(texts, order)
            for k, ends, _, many in t.grams():
                if k in (1, order):
                    yield _rows(_packed(k, t.words(ends, k), {"c" if k == 1 else "a": many}, n, hot))

    return run


def _frequent(n: int):
    """(word, n): words that are one in 4 n tokens of a portion or more; the null word has all tokens."""

    def run(batches):
        for _, texts in portions(batches, "text", COUNTED):
            h, at = words(texts)
            known, many = np.unique(h, return_counts=True)
            held = many * 4 * n >= len(h)
            yield pa.RecordBatch.from_arrays([pa.array([*known[held].view(np.int64).tolist(), None], pa.int64()), pa.array([*many[held].tolist(), len(h)], pa.int64())], names=["word", "n"])

    return run


def _write(folder: str, name: str, raw: bytes) -> None:
    """One file of the model, whole or not at all; a task that runs again writes the same."""
    where, base = fs.FileSystem.from_uri(folder)
    part = f"{base}/{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as f:
        f.write(raw)
    where.move(part, f"{base}/{name}")


@functools.lru_cache(maxsize=4096)
def _mapped(folder: str, name: str) -> list[np.ndarray] | None:
    """The arrays of one file, mapped; from stores that can't be mapped they are read."""
    where, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if isinstance(where, fs.LocalFileSystem):
        return _load(np.memmap(path, np.uint8, "r"))
    with where.open_input_file(path) as f:
        return _load(f.read())


def _level(k: int, n: int, hot: np.ndarray, folder: str):
    """One shard of order k: its file, what goes to order k - 1, and its part of the totals."""

    def run(table: pa.Table) -> pa.Table:
        shard, level = table.column("shard")[0].as_py(), table.column("level").to_numpy()
        blobs = table.column("blob").to_pylist()
        # Raw counts of words wait for their turn.
        out = [(shard, 1, b, None) for b, x in zip(blobs, level.tolist(), strict=True) if x != k]
        mine = [b for b, x in zip(blobs, level.tolist(), strict=True) if x == k]
        if mine:
            cols, values = _unpacked(k, sorted(mine))
            keys, first, of = np.unique(_key(cols), return_index=True, return_inverse=True)
            cols = [c[first] for c in cols]
            values = {f: np.bincount(of, weights=v, minlength=len(keys)).astype(np.int64) if v.any() else np.zeros(len(keys), np.int64) for f, v in values.items()}
            _write(folder, f"{k}-{shard}.bin", _dump([keys, *(_narrow(values[f]) for f in _FIELDS)]))
            a = values["a"]
            out.append((shard, 0, None, [*(int((a == j).sum()) for j in (1, 2, 3, 4)), int((a > 2).sum()), int(a.sum()), int(values["c"].sum()), int((values["c"] > 0).sum())]))
            if k > 1:
                cols, a = [c[a > 0] for c in cols], a[a > 0]
                for some, add in ((cols[1:], {"a": np.ones(len(a), np.int64)}), (cols[:-1], {"s0": a, "s1": a == 1, "s2": a == 2, "s3": a > 2})):
                    _, first, of = np.unique(_key(some), return_index=True, return_inverse=True)
                    out += _packed(k - 1, [c[first] for c in some], {f: np.bincount(of, weights=v, minlength=len(first)).astype(np.int64) for f, v in add.items()}, n, hot)
        return pa.Table.from_batches([_rows(out)])

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3 and more; where counts of counts are too few for the estimate, the usual fallback of 0.5, 1, 1.5."""
    plain = np.array([0.0, 0.5, 1.0, 1.5])
    if not (n1 and n2 and n3):
        return plain
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if (d[1:] > 0).all() and (d[1:] < (1, 2, 3)).all() else plain


@dataclass(frozen=True)
class Model:
    """A stored model: its folder, order, shards, frequent words, and the totals of each order (grams counted 1, 2, 3, 4 times and oftener than twice, their sum; of order one also all tokens and distinct words)."""

    folder: str
    order: int
    shards: int
    hot: np.ndarray
    totals: dict[int, list[int]]

    def find(self, cols: list[np.ndarray], fields: tuple[str, ...]) -> list[np.ndarray]:
        """Fields of grams, zero where the model has none."""
        k, keys, to = len(cols), _key(cols), _shard(cols, self.shards, self.hot)
        out = [np.zeros(len(keys), np.int64) for _ in fields]
        order = np.lexsort((keys, to))
        edge = np.searchsorted(to[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            held = _mapped(self.folder, f"{k}-{s}.bin")
            if held is not None:
                o = order[edge[s] : edge[s + 1]]
                at = np.minimum(np.searchsorted(held[0], keys[o]), len(held[0]) - 1)
                hit = held[0][at] == keys[o]
                for x, f in zip(out, fields, strict=True):
                    x[o[hit]] = held[1 + _FIELDS.index(f)][at[hit]]
        return out

    def log10(self, t: _Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: the log10 probabilities of the model and of the base, and whether the word is known."""
        n1, n2, _, _, more, pairs, n_train, vocabulary = self.totals[1]
        below = None
        for k, ends, of, _ in t.grams():
            cols, d = t.words(ends, k), _discounts(*self.totals[k][:4])
            if k == 1:
                a, c = self.find(cols, ("a", "c"))
                spare = (d[1] * n1 + d[2] * n2 + d[3] * more) / pairs if pairs else 1.0
                p = (a - d[np.minimum(a, 3)]) / max(pairs, 1) + spare / (vocabulary + 1)
                base, known = np.log10((c + 1) / (n_train + vocabulary + 1))[of], (c > 0)[of]
            else:
                (a,), (s0, *s) = self.find(cols, ("a",)), self.find(cols[:-1], ("s0", "s1", "s2", "s3"))
                low = np.empty(len(a))
                low[of] = below  # all tokens of a gram have the same shorter one
                over = np.maximum(s0, 1)
                p = np.where(s0 > 0, (a - d[np.minimum(a, 3)]) / over + sum(x * y for x, y in zip(d[1:], s, strict=True)) / over * low, low)
            below = p[of]
        return np.log10(below), base, known


def train(docs: DataFrame, order: int = 2, text_col: str = "text") -> Model:
    """Counts all texts of `docs` (null: an empty one, which still has its end) and stores the model in the shared folder."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark, n = docs.sparkSession, fanout(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    many = cut(texts.mapInArrow(_frequent(n), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens = many.where("word is null").agg(F.sum("n")).first()[0] or 0
    # At most 4 n words, as each is one in 4 n tokens.
    hot = np.array([r["word"] for r in many.where(f"word is not null and n * {4 * n} >= {tokens}").select("word").collect()], np.int64).view(np.uint64)
    hot = np.unique(np.concatenate((hot, [_START])))
    folder = f"{shared_dir(spark).rstrip('/')}/kneser-ney-{uuid.uuid4().hex}"
    where, at = fs.FileSystem.from_uri(folder)
    where.create_dir(at)
    rows, totals = texts.mapInArrow(_count_texts(order, n, hot), _MSG), {}
    for k in range(order, 0, -1):
        rows = cut(rows.groupBy("shard").applyInArrow(_level(k, n, hot, folder), _MSG))
        sums = rows.where("t is not null").select(F.posexplode("t")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        totals[k] = [0] * 8
        for r in sums:
            totals[k][r["pos"]] = r["n"]
        rows = rows.where("blob is not null")
    return Model(folder, order, n, hot, totals)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs(id, text, held_out): id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = f"{id_col} {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        for batch, texts in portions(batches, text_col, SCORED):
            t = _Tokens(texts, model.order)
            own, base, known = model.log10(t)
            starts = np.cumsum(t.size) - t.size
            add = lambda x: pa.array(np.add.reduceat(x, starts))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array(t.size, pa.int64()), add(known.astype(np.int64)), pa.array(np.full(len(starts), model.totals[1][6]), pa.int64()), add(base), add(own)], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(id_col, "held_out", text_col).mapInArrow(run, kind)


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, n_tokens, perplexity, base_perplexity) of scored rows."""
    over = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), over("score").alias("perplexity"), over("base_score").alias("base_perplexity"))


def score_corpus(docs: DataFrame, held_out: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from rows where `held_out` is false and scores every row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability, its end included).

    Words are lower-cased (A-Z) and split at ASCII white space; null text is empty and has its end alone. A null
    `held_out` counts as false, a null id is kept; repeated rows count as often as they stand. With no training rows all
    probabilities are one. An empty table gives no rows. Columns besides id and text play no part, whatever their names.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias(text_col), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return score(rows, train(rows.where(~F.col("held_out")), order, text_col), id_col, text_col)
