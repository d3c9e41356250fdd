"""BPE encoding with reuse of content-defined chunks, and decoding.

Texts are cut where a rolling hash of the last bytes says so, so that documents that share passages share chunks. A
worker encodes each distinct chunk once and keeps it (bounded), and within chunks each pre-token. At a chunk join the tokens of the two sides needn't be
those of the whole: the stretch between the nearest places where a word certainly ends is encoded again and put in
between. Where a chunk's own token boundaries don't agree with it, the stretch is widened over that chunk to the next such place.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import portions, powers, prefix

#: Mean chunk (a power of two) and longest chunk in bytes, bytes the rolling hash sees, bytes of chunks a worker keeps.
MEAN, LONGEST, WINDOW, KEPT = 1024, 1 << 16, 16, 16 << 20
#: Pre-tokens a worker keeps.
KEPT_WORDS = 100_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRINT = np.zeros(256, bool)
_PRINT[33:127] = True


def _byte_names() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            names[chr(spare)] = b
            spare += 1
    return names


_LATIN = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L")
#: Texts of Latin letters and printable ASCII, where all versions of Unicode agree on what a letter, digit or space is; the byte-level pre-tokenizer's rule is spelled out for them.
_PLAIN = re.compile(f"[{_LATIN}\\t\\n\\r -~]*")
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\\t\\n\\r {_LATIN}0-9]+|[\\t\\n\\r ]+(?![^\\t\\n\\r ])|[\\t\\n\\r ]+")


class Codec:
    """A byte-level BPE tokenizer of the tokenizers library, with a chunk cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if said.get("normalizer") or said["pre_tokenizer"].get("type") != "ByteLevel" or said["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers without normalizer and prefix space can be cut into chunks")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in said["added_tokens"]):
            raise ValueError("added tokens must match as plain strings")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = sorted(((t["content"].encode(), t["id"]) for t in said["added_tokens"]), key=lambda x: -len(x[0]))
        names, special = _byte_names(), {i: c for c, i in self.special}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = special[i] if i in special else bytes(names[c] for c in token)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i).encode() for i in range(len(self.bytes))]
        self.now: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.held = 0
        #: Bytes of chunks and of joins' windows that were asked for, and those of them that had been encoded before.
        self.asked = self.reused = 0
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts. A plain text is taken apart to pre-tokens, which the library encodes once each; others go to it whole."""
        plain = [_PRETOKEN.findall(t) if _PLAIN.fullmatch(t) else None for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words, self.old_words = {}, self.words
        words, old = self.words, self.old_words
        missing = set()
        for w in set(chain.from_iterable(p for p in plain if p is not None)):
            if w not in words:
                if (got := old.get(w)) is not None:
                    words[w] = got
                else:
                    missing.add(w)
        new = sorted(missing)
        # Words after a space stay apart when strung together, so that one call encodes many; byte lengths part them again.
        spaced = [w for w in new if w[0] == " " and len(w) > 1 and w[1] not in "\t\n\r "]
        rows = [spaced[i : i + 512] for i in range(0, len(spaced), 512)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            at = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w.encode()) for w in row])) + 1
            raw, a = ids.tobytes(), 0
            for w, b in zip(row, at.tolist(), strict=True):
                words[w] = raw[4 * a : 4 * b]
                a = b
        other = [w for w in new if w not in words]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            words[w] = np.array(e.ids, np.int32).tobytes()
        whole = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if p is None], add_special_tokens=False))
        get = words.__getitem__
        return [np.array(next(whole).ids, np.int32) if p is None else np.frombuffer(b"".join(map(get, p)), np.int32) for p in plain]

    def cached(self, piece: bytes) -> np.ndarray | None:
        got = self.now.get(piece)
        if got is None and (got := self.old.get(piece)) is not None:
            self.keep(piece, got)
        return got

    def keep(self, piece: bytes, ids: np.ndarray) -> None:
        if self.held > KEPT:  # the older half of what is kept goes
            self.now, self.old, self.held = {}, self.now, 0
        self.now[piece] = ids
        self.held += len(piece) + ids.nbytes + 200

    def pieces(self, wanted: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of each piece, from the cache or encoded once."""
        out: dict[bytes, np.ndarray] = {}
        missing = []
        for p in wanted:
            self.asked += len(p)
            if p in out:
                self.reused += len(p)
                continue
            got = out[p] = self.cached(p)
            if got is None:
                missing.append(p)
            else:
                self.reused += len(p)
        if missing:
            for p, ids in zip(missing, self.encoded([m.decode() for m in missing]), strict=True):
                out[p] = ids
                if len(p) <= LONGEST:
                    self.keep(p, out[p])
        return out

    def split_special(self, text: bytes) -> Iterator[tuple[bytes, int | None]]:
        """Stretches between added tokens' strings, each with the id that follows it."""
        at = 0
        while True:
            hits = [(i, c, t) for c, t in self.special if (i := text.find(c, at)) >= 0]
            if not hits:
                yield text[at:], None
                return
            i, c, t = min(hits, key=lambda x: (x[0], -len(x[1])))
            yield text[at:i], t
            at = i + len(c)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        plans = [[(plan(t), follow) for t, follow in self.split_special(x)] for x in texts]
        known = self.pieces([p for x in plans for (t, cuts, joins), _ in x for p in _wanted(t, cuts, joins)])
        return [np.concatenate([part for (t, cuts, joins), follow in x for part in (self._join(t, cuts, joins, known), *([np.array([follow], np.int32)] if follow is not None else []))]) for x in plans]

    def _join(self, t: bytes, cuts: list[int], joins: list[tuple[int, int]], known: dict) -> np.ndarray:
        """Ids of a stretch: of each chunk what lies between the joins' windows, and the windows."""
        out, at, j = [], 0, 0
        n = len(joins)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            while j < n and joins[j][0] <= at and joins[j][1] > at:  # a window from here, over one or more joins
                out.append(known[t[joins[j][0] : joins[j][1]]])
                at, j = joins[j][1], j + 1
            stop = joins[j][0] if j < n and joins[j][0] < b else b
            if at >= b or stop <= at:
                continue
            ids = known[t[a:b]]
            ends = np.cumsum(self.size[ids])
            x = int(np.searchsorted(ends, at - a, "right")) if at > a else 0
            y = int(np.searchsorted(ends, stop - a)) + 1
            if (x and ends[x - 1] != at - a) or ends[y - 1] != stop - a:  # no agreement: both are certain places, so what lies between stands by itself
                ids = np.array(self.tokenizer.encode(t[at:stop].decode(), add_special_tokens=False).ids, np.int32)
                x, y = 0, len(ids)
            out.append(ids[x:y])
            at = stop
            if j < n and joins[j][0] == at:
                out.append(known[t[joins[j][0] : joins[j][1]]])
                at, j = joins[j][1], j + 1
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray, text: bytes) -> bytes:
        """The decoded text in UTF-8; `text` only saves the check of bytes that are known to be sound."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw if raw == text else raw.decode("utf-8", "replace").encode()

    def written(self, ids: np.ndarray) -> bytes:
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))


def plan(t: bytes) -> tuple[bytes, list[int], list[tuple[int, int]]]:
    """Chunk ends of a text (content-defined, on character starts), and the windows around joins: from where a word last ended for certain (a printable ASCII character, then ASCII space) to where one next does."""
    if len(t) <= 2 * WINDOW:
        return t, [0, len(t)] if t else [0], []
    data = np.frombuffer(t, np.uint8)
    cuts: list[np.ndarray] = []
    for at in range(0, len(data), 1 << 20):
        part = data[max(at - WINDOW, 0) : at + (1 << 20)]
        if len(part) <= WINDOW:
            continue
        sums = prefix(part)
        i = np.arange(WINDOW, len(part))
        h = (sums[i] - sums[i - WINDOW]) * powers(len(part))[1][i - WINDOW]
        cuts.append(i[(h >> np.uint64(64 - MEAN.bit_length() + 1)) == 0] + max(at - WINDOW, 0))
    at = np.concatenate(cuts)
    at = at[(data[at] & 0xC0) != 0x80]
    ends, last = [0], 0
    for c in [*at.tolist(), len(t)]:
        while c - last > LONGEST:
            last += LONGEST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if c > last:
            ends.append(c)
            last = c
    inner = np.array(ends[1:-1], np.int64)
    if not len(inner):
        return t, ends, []
    sure = np.flatnonzero(_PRINT[data[:-1]] & _SPACE[data[1:]]) + 1
    left = np.searchsorted(sure, inner, "right") - 1
    right = np.searchsorted(sure, inner, "left")
    a = np.where(left >= 0, sure[np.maximum(left, 0)], 0) if len(sure) else np.zeros(len(inner), np.int64)
    b = np.where(right < len(sure), sure[np.minimum(right, len(sure) - 1)], len(t)) if len(sure) else np.full(len(inner), len(t))
    joins: list[tuple[int, int]] = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if x == y:
            continue  # the join itself is such a place
        if not joins or joins[-1] != (x, y):
            joins.append((x, y))
    return t, ends, joins


def _wanted(t: bytes, cuts: list[int], joins: list[tuple[int, int]]) -> Iterator[bytes]:
    j = 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        while j < len(joins) and joins[j][1] <= a:
            j += 1
        if not (j < len(joins) and joins[j][0] <= a and joins[j][1] >= b):  # else a window holds all of the chunk
            yield t[a:b]
    for a, b in joins:
        yield t[a:b]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and file; workers live on between tasks."""
    if path not in _codecs:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` with ids (array of int), n_tokens, ids_sha256 and decoded_sha256; null counts as empty. Columns so named are replaced. `path` must be readable on every worker."""
    new = {"ids": F.array(F.lit(0)), "n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}
    docs, added = docs.drop(*new), list(new)

    def run(batches):
        c = codec(path)
        for batch, texts in portions(batches, text_col, 1 << 20):
            ids = c.encode(texts)
            at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            sha = [hashlib.sha256(c.written(x)).hexdigest() for x in ids]
            back = [hashlib.sha256(c.decode(x, t)).hexdigest() for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(np.diff(at), pa.int64()), pa.array(sha), pa.array(back)], names=[*batch.schema.names, *added])

    kind = docs.withColumns(new).schema
    for f in kind:
        f.nullable = True
    return docs.mapInArrow(run, kind)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 per row, in input order within a partition."""
    c_docs = docs.select(F.col(id_col), F.col(text_col).alias("_text"))

    def run(batches):
        c = codec(path)
        for batch, texts in portions(batches, "_text", 1 << 20):
            ids = c.encode(texts)
            sha = [hashlib.sha256(c.written(x)).hexdigest() for x in ids]
            back = [hashlib.sha256(c.decode(x, t)).hexdigest() for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha), pa.array(back)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return c_docs.mapInArrow(run, f"{id_col} {dict(c_docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
