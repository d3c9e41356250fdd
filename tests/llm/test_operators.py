"""Every corpus operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.llm import ann, bpe, common, exact_dedup, line_dedup, lm, mixing, near_dedup, substring_dedup, tokens, toxicity, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, spans string, kept_text string, ids string, p_toxic string, component_id string"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    line = lambda k=14: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = [line(25) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [line(rnd.randint(3, 30)) for _ in range(rnd.randint(1, 6))]
        for s in shared:
            if rnd.random() < 0.3:
                parts.insert(rnd.randrange(len(parts) + 1), s)
        rows.append([i, "\n".join(parts), f"s{i % 5}"])
    rows[7][1], rows[8][1], rows[9][1] = rows[3][1], rows[3][1].upper(), rows[3][1] + " tail"
    rows[20][1], rows[21][1], rows[22][1], rows[23][1] = None, "", "   \n\t ", "one two"
    rows[24][1] = "ab" * 400
    rows[25][1] = "ONE\x0btwo"
    rows[26][1] = "\n".join([shared[0], shared[1], shared[0], shared[1], "x"])
    rows[30][2] = None
    rows[40][1] = " ".join(rnd.choice(vocab) for _ in range(6000))
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def test_word_hashes_hold_over_pieces(monkeypatch):
    texts = [t.encode() for t in ["a b  a", "", "é A\x1cb", "x" * 300 + " y"]]
    h, at = tokens.words(texts)
    monkeypatch.setattr(tokens, "PIECE", 7)
    h2, at2 = tokens.words(texts)
    assert h.tolist() == h2.tolist() and at.tolist() == at2.tolist() == [0, 3, 3, 5, 7]
    assert h[0] == h[2] != h[1]


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_exact_dedup(spark, rows):
    more = [*rows, *[(100 + i, "Hot TEXT", "s") for i in range(40)], (3, rows[3][1], "s0"), (None, "Hot text", "s")]
    got = exact_dedup.exact_dedup(frame(spark, more), support=0.05).collect()
    assert len(got) == len(more)
    groups = {}
    for i, t, _ in more:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = Counter()
    for i, t, _ in more:
        key = (t or "").translate(LOWER)
        keep = max(x for x in groups[key] if x is not None)
        want[i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want


def test_substrings(spark, docs, rows):
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest())
        assert [(s.start, s.stop) for s in r.spans] == spans


def test_substrings_of_repeated_and_null_ids(spark):
    rnd = random.Random(11)
    x, y, z = ("".join(rnd.choice("abcdefgh ") for _ in range(k)) for k in (60, 320, 70))
    rows = [(1, x + z, "s"), (2, y, "s"), (2, x, "s"), (2, x, "s"), (3, y[100:] + x, "s"), (None, x, "s"), (4, None, "s")]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == Counter([(1, 130, 0, 0), (2, 320, 0, 0), (2, 60, 60, 1), (2, 60, 60, 1), (3, 280, 280, 1), (None, 60, 0, 0), (4, 0, 0, 0)])


def test_substrings_where_most_rows_are_whole_copies(spark, tmp_path, monkeypatch):
    rnd = random.Random(12)
    x, y, z = ("".join(rnd.choice("abcdefgh é") for _ in range(k)) for k in (60, 320, 70))
    one = [(2, x + z), (3, y), (3, y), (5, y[100:] + x), (6, "short"), (7, None), (8, y[:200])]
    rows = [(i + 10 * k, t, "s") for k in range(5) for i, t in one] + [(3, z + "more", "s"), (3, x + z, "s"), (1, z, "s"), (None, y, "s")]
    rnd.shuffle(rows)
    emit, at = substring_dedup._emit_runs, str(tmp_path)

    def told(width, n):
        def run(batches):
            import uuid

            def each():
                for b in batches:
                    with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
                        f.write(str(len(b)))
                    yield b

            yield from emit(width, n)(each())

        return run

    monkeypatch.setattr(substring_dedup, "_emit_runs", told)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, tuple((s.start, s.stop) for s in r.spans)) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        want[i, len(b), sum(gone), len(spans), hashlib.sha256(bytes(v for v, g in zip(b, gone) if not g)).hexdigest(), spans] += 1
    assert got == want
    # Whole copies deal out nothing: what is left are the texts too short to be told apart and the first of the others.
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == len([t for i, t, _ in rows if i is not None and len((t or "").encode()) < 50]) + 7


def test_suffix_array_and_intervals():
    rnd = random.Random(2)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(6, 40))) for _ in range(12)] + [b"a" * 30, b"a" * 30]
    text, pos, left, lcp, before = substring_dedup.suffix_array(texts, 6)
    suffix = [texts[t][p:] for t, p in zip(text, pos)]
    assert suffix == sorted(suffix)
    for k in range(1, len(suffix)):
        n = 0
        while n < min(len(suffix[k]), len(suffix[k - 1])) and suffix[k][n] == suffix[k - 1][n]:
            n += 1
        assert lcp[k] == n
    found = {suffix[a][:n]: sorted(zip(text[a:b].tolist(), pos[a:b].tolist())) for n, a, b in substring_dedup.interval_groups(lcp, before, 6)}
    places = {}
    for t, x in enumerate(texts):
        for p in range(len(x)):
            for n in range(6, len(x) - p + 1):
                places.setdefault(x[p : p + n], []).append((t, p))
    for s, at in places.items():
        if len(at) > 1:
            lefts = {texts[t][p - 1] if p else (-1, t) for t, p in at}
            rights = {texts[t][p + len(s)] if p + len(s) < len(texts[t]) else (-1, t) for t, p in at}
            if len(lefts) > 1 and len(rights) > 1:
                assert found[s] == sorted(at)


def test_warc(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(1, 2600, 3)] + [(None, "u", "lost"), (7, "http://x/7", "twin"), (5000, None, None)]
    kind = "page_id long, url string, html string"
    other = [(i, u, (h or "") + ("!" if i in (4, 1501) else "")) for i, u, h in pages if i not in (10, 2002)] + [(9999, "new", "new")]
    got = warc.audit(spark.createDataFrame(pages, kind), spark.createDataFrame(other, kind)).collect()
    bad = {(r.page_id, r.status) for r in got if r.status != "ok"}
    assert bad == {(4, "corrupt"), (1501, "corrupt"), (10, "missing"), (2002, "missing"), (9999, "extra")}
    assert len(got) == len(pages) + 1
    one = next(r for r in got if r.page_id == 1)
    assert one.record_sha256 == hashlib.sha256(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/1\r\nContent-Length: 8\r\n\r\n<p>1</p>\r\n\r\n").hexdigest()
    assert warc.audit(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0


def test_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 900, 20))
    hits = 0
    for q, out in by.items():
        score = x @ x[q]
        want = [i for i in sorted(range(900), key=lambda i: (-score[i], i)) if i != q][:20]
        assert [r.rank for r in out] == list(range(1, 21)) and all(math.isclose(r.score, score[r.vec_id]) for r in out)
        assert [(-r.score, r.vec_id) for r in out] == sorted((-r.score, r.vec_id) for r in out)
        hits += len({r.vec_id for r in out} & set(want))
    assert hits >= 0.95 * 20 * len(by)


def test_search_in_several_shards(spark, monkeypatch):
    """Shards are searched by the graph, not read whole, and fewer candidates than asked for all come back."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 4000)] + 0.7 * rng.normal(size=(4000, 16))
    monkeypatch.setattr(ann, "LEAST_SHARD", 1000)
    monkeypatch.setattr(ann, "BLOCK", 64)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(docs, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {i for i in np.argsort(-(x @ x[q]), kind="stable")[:21].tolist() if i != q}) for q in range(0, 4000, 20)]
    assert set(got) == set(range(0, 4000, 20)) and sum(hits) >= 0.9 * 20 * len(hits)
    near = ann._augmented(x)
    graph, start = ann.build(near)
    q = np.concatenate((x[::20], np.zeros((200, 1))), axis=1).astype(np.float32)
    opened = ann.beam_search(near, graph, start, q, 40, want_visited=True)[1]
    assert np.mean([len(np.unique(graph[v])) for v in opened]) < 0.25 * len(x)
    few = ann.search(docs.where("vec_id < 5"), F.col("vec_id") == 0, k=20).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4] and {r.vec_id for r in few} == {1, 2, 3, 4}


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, rows, order, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 5000)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = [*rows, rows[3], (None, "one two", "s")]
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_corpus(frame(spark, rows), held, order).collect())
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    texts = [[*words(t), "</s>"] for _, t, _ in rows]
    counts = {order: Counter(), 0: Counter()}
    for t, o in zip(texts, out):
        if not o:
            line = ["<s>"] * (order - 1) + t
            counts[order].update(tuple(line[k : k + order]) for k in range(len(t)))
            counts[0].update(t)
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    uni = counts[0]
    n, v = sum(uni.values()), len(uni)
    disc, after = {}, {}
    for k in range(1, order + 1):
        disc[k] = lm._discounts(*[sum(x == j for x in counts[k].values()) for j in (1, 2, 3, 4)])
        for g, x in counts[k].items():
            s = after.setdefault(g[:-1], [0] * 4)
            s[0] += x
            s[min(x, 3)] += 1

    def p(g):
        k, low = len(g), 1 / (v + 1) if len(g) == 1 else p(g[1:])
        s = after.get(g[:-1])
        if not s:
            return low
        x = counts[k][g]
        return (x - disc[k][min(x, 3)]) / s[0] + sum(disc[k][j] * s[j] for j in (1, 2, 3)) / s[0] * low

    first = ("<s>",) * (order - 1)
    assert math.isclose(sum(p((*first, w)) for w in uni) + p((*first, "never seen")), 1)
    want = Counter()
    for (i, *_), t, o in zip(rows, texts, out):
        line = [*first, *t]
        want[i, o, len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), 6), round(sum(math.log10(p(tuple(line[k : k + order]))) for k in range(len(t))), 6)] += 1
    assert got == want


def test_kneser_ney_perplexity_and_no_training_rows(spark, docs):
    scored = lm.score_corpus(docs, F.col("doc_id") % 3 == 0).cache()
    by = {r.held_out: r for r in lm.perplexity(scored).collect()}
    assert all(1 < by[o].perplexity < by[o].base_perplexity for o in (False, True))
    assert all(r.score == r.base_score == 0 and r.train_tokens == 0 for r in lm.score_corpus(docs, F.lit(True)).collect())


def test_bpe(spark, docs, rows, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode(docs, path).collect()}
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    monkeypatch.setattr(bpe, "MEAN", 32)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    c, rnd = bpe.Codec(path), random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", " \n", "'s", "'ll", "é", "中", "🙂", "<|endoftext|>", "<|endof", "text|>", "1", "²", "...", "\t", "　", "x" * 50, "\x1c", "\u0085", "'", "ß"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 3, 20, 300]))) for _ in range(800)] + ["z" * 200_000]
    for x, ids in zip(texts, c.encode([x.encode() for x in texts])):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want and c.decode(ids, x.encode()).decode() == t.decode(want, skip_special_tokens=False)


def test_chunks_are_reused():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rnd = random.Random(3)
    line = lambda: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(900))
    passage = line()
    texts = [f"{line()} {passage} {line()}".encode() for _ in range(8)]
    c = bpe.Codec(path)
    got = [x.tolist() for t in texts for x in c.encode([t])]
    assert got == [c.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert 0.15 < c.reused / c.asked < 0.34  # seven of eight times, the passage, less its ends


def _without_lines(rows, least):
    """(id, lines, removed, kept text) by looking for every line run among all earlier ones."""
    lines = {i: t.split("\n") if t is not None else [] for i, t, *_ in rows}
    before, out = [], []
    for i, own in lines.items():
        gone = [False] * len(own)
        for p in range(len(own)):
            best = 0
            for j, q in [*before, *((i, q) for q in range(p))]:
                n = 0
                while p + n < len(own) and q + n < len(lines[j]) and own[p + n] == lines[j][q + n]:
                    n += 1
                best = max(best, n)
            if sum(len(words(x)) for x in own[p : p + best]) >= least:
                gone[p : p + best] = [True] * best
        before += [(i, q) for q in range(len(own))]
        text = {a: b for a, b, *_ in rows}[i]
        out.append((i, len(own), sum(gone), text if not any(gone) else "\n".join(x for x, g in zip(own, gone) if not g)))
    return out


def test_lines(spark, docs, rows):
    got = [(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(docs, min_words=20).collect()]
    assert sorted(got) == sorted(_without_lines(rows, 20), key=lambda r: r[0])


def test_short_lines_go_too(spark):
    texts = ["menu\n\none a b", "two\n\nmenu\n\n  \nlast", "menu", "menu\n\n  \nall rights reserved\nx", "all rights reserved\n\n\ny\nmenu"]
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(5)] == [texts[0], "two\n\n  \nlast", "", "all rights reserved\nx", "\n\ny"]


def test_lines_beside_odd_columns_nulls_and_repeats(spark):
    rows = [(1, "a b\nc", "x", "y", 1), (2, "a b\nd", None, None, None), (2, "a b\nd", None, None, None), (2, "e\na b", "x", "y", 1), (None, "a b", "x", "y", 1), (3, None, "x", "y", 1), (4, "", "x", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _id string, n_removed int")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs).select("doc_id", "_text", "_id", "kept_text", "n_lines", "n_removed").collect()), key=str)
    want = [(1, "x", "y", "a b\nc", 2, 0), (2, None, None, "d", 2, 1), (2, None, None, "d", 2, 1), (2, "x", "y", "e", 2, 1), (None, "x", "y", "a b", 1, 0), (3, "x", "y", None, 0, 0), (4, "x", "y", "", 1, 0)]
    assert got == sorted(want, key=str)


def test_a_common_line_over_many_chunks(spark, monkeypatch):
    """One line in every document, before lines that other documents have: a class of the array that all chunks share."""
    rnd = random.Random(7)
    rows = [(i, "\n".join(["same"] + [f"l{rnd.randrange(12)}" for _ in range(rnd.randint(0, 4))] + ["same", f"u{i}"]), "s") for i in range(150)]
    monkeypatch.setattr(line_dedup, "fanout", lambda _: 13)
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    seen = set()
    for i, t, _ in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if x not in seen and x not in t.split("\n")[:k]]
        seen |= set(t.split("\n"))
        assert got[i] == "\n".join(kept)


def test_longest_earlier():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randint(1, 12)
        pos, lcp = rnd.sample(range(n), n), [0] + [rnd.randint(0, 3) for _ in range(n - 1)]
        want = []
        for a in range(n):
            best = 0
            for b in range(n):
                if pos[b] < pos[a]:
                    best = max(best, min(lcp[min(a, b) + 1 : max(a, b) + 1]))
            want.append(best)
        assert line_dedup.longest_earlier(pos, lcp) == want


def test_mix(spark, docs, rows):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    again = {r.doc_id: r for r in mixing.mix(frame(spark, rows[::-1])).collect()}
    assert got == again and len(got) == len(rows)
    size = {i: len(words(t)) for i, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    own = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    full, left = {}, float(sum(own.values()))
    while True:
        share = {s: left * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in names if s not in full}
        over = [s for s, t in share.items() if t > 3 * own[s]]
        if not over:
            break
        full |= {s: 3.0 * own[s] for s in over}
        left = sum(own.values()) - sum(full.values())
    taken = Counter()
    for i, _, s in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], own[s]) and math.isclose(r.target, (full | share)[s], abs_tol=1e-6)
        assert r.taken % max(size[i], 1) == 0 and r.taken <= 3 * size[i]
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - (full | share)[s]) <= max(size[i] for i, _, x in rows if x == s)


def _missed(spark, docs):
    """By source: how far the taken words are from the target, its median document, and the mix."""
    out = {}
    for r in mixing.mix(docs).collect():
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        out.setdefault(r.source, []).append(r)
    return {s: (abs(sum(r.taken for r in own) - own[0].target), sorted(r.size for r in own if r.size)[sum(r.size > 0 for r in own) // 2]) for s, own in out.items() if any(r.size for r in own)}


def test_mix_is_within_a_median_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for source, (missed, median) in _missed(spark, docs).items():
        assert missed <= median, source


def test_mix_rounds_repeated_rows_one_by_one(spark):
    """Forty equal rows of a source do not share a coin; their copies are the same in some order on every run, over any partitions."""
    rows = [(1, "w " * 10, "a")] * 40 + [(10 + i, "v " * (i + 1), "a") for i in range(19)] + [(100 + i, "u " * 7, "b") for i in range(60)] + [(200 + i, "t " * 30, None) for i in range(20)] + [(None, "s " * 9, "b")] * 30
    schema = "doc_id long, text string, source string"
    parts = [spark.createDataFrame(r, schema).repartition(n) for r, n in ((rows, 1), (rows[::-1], 5))]
    for missed, median in _missed(spark, parts[0]).values():
        assert missed <= median
    one, two = (Counter(map(tuple, mixing.mix(p).drop("repeat").collect())) for p in parts)
    assert one == two and len({r[4] for r in one if r[0] == 1}) > 1


def test_numbered_counts_within_a_key(spark, tmp_path):
    spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [("c",)], "key string").repartition(7).write.parquet(str(tmp_path / "rows"))
    got = mixing.numbered(spark.read.parquet(str(tmp_path / "rows")), "key", "n").collect()
    assert sorted((r.key, r.n) for r in got) == [("a", i) for i in range(50)] + [("b", i) for i in range(3)] + [("c", 0)]


def test_pivotal_keeps_expectations():
    size, p = [50, 40, 30, 20, 10, 5], [0.3, 0.6, 0.5, 0.2, 0.9, 0.4]
    runs = np.array([mixing.pivotal(list(range(6)), size, p, seed) for seed in range(4000)])
    assert np.allclose(runs @ size, np.dot(size, p))
    assert np.abs(runs.mean(axis=0) - p).max() < 0.04
    assert ((runs > 0) & (runs < 1)).sum(axis=1).max() <= 1


def _components(rows, percent):
    sets, root = {}, {}
    for i, t, _ in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        root[i] = i
    for _ in rows:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[x]] == root[x] for x in root):
            break
    return sets, root


@pytest.mark.parametrize(("node", "gather"), [(1024, 4096), (4, 3)])
def test_near_dups(spark, node, gather, monkeypatch):
    rows, rnd = list(corpus(9, 50)), random.Random(6)
    base = [f"w{k}" for k in range(120)]
    for i in range(50, 75):
        w = base[:]
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(120)] = f"z{rnd.randrange(1000)}"
        rows.append((i, " ".join(w), "s"))
    monkeypatch.setattr(near_dedup, "NODE", node)
    monkeypatch.setattr(near_dedup, "GATHER", gather)
    sets, root = _components(rows, 85)
    got = near_dedup.near_dups(frame(spark, [*rows, (None, "a b", "s"), rows[50]])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_near_dups_in_large_nodes(spark, monkeypatch):
    """Pairs of near copies in one family of sets that are similar, but not near copies: nothing chains what a node or a component loses."""
    rnd, rows = random.Random(12), []
    for i in range(200):
        one = [f"w{k}" for k in range(400)]
        for k in rnd.sample(range(0, 400, 8), 5):
            one[k] = f"p{i}.{k}"
        other = one[:]
        for k in rnd.sample(range(4, 400, 8), 2):
            other[k] = f"q{i}.{k}"
        rows += [(2 * i, " ".join(one), "s"), (2 * i + 1, " ".join(other), "s")]
    for name, value in {"NODE": 8, "GATHER": 64, "BLOCK": 32, "PAIRS": 1}.items():
        monkeypatch.setattr(near_dedup, name, value, raising=False)
    h, at = tokens.words([t.encode() for _, t, _ in rows])
    root = near_dedup.link_sets([tokens.shingles(h[a:b], 5) for a, b in zip(at[:-1], at[1:])], 85)
    assert len(set(root.tolist())) > 150
    got = {r.doc_id: r.component_id for r in near_dedup.near_dups(frame(spark, rows)).collect()}
    assert got == dict(enumerate(root.tolist()))


def test_trees_hold_their_recall():
    """Of 3,000 pairs of similarity 0.80, those that share no node of the last level in any tree."""
    rng = np.random.default_rng(3)
    n, missed = near_dedup.trees(80), 0
    for _ in range(3000):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        one, other = np.sort(x[:90]), np.sort(x[10:])
        assert len(set(one.tolist()) & set(other.tolist())) == 80
        missed += not (near_dedup.paths(one, n)[-1] == near_dedup.paths(other, n)[-1]).any()
    assert (n, near_dedup.trees(85)) == (31, 20) and missed <= 3


def test_near_dups_of_80_in_a_group_of_thousands(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 256)
    rnd, rows = random.Random(5), []
    for i in range(2100):
        one = [f"w{k}" for k in range(140)]
        for k in rnd.sample(range(6, 134, 8), 4):
            one[k] = f"p{i}.{k}"
        other = one[:]
        for k in rnd.sample(range(10, 134, 8), 3):
            other[k] = f"q{i}.{k}"
        rows += [(2 * i, " ".join(one), "s"), (2 * i + 1, " ".join(other), "s")]
    h, at = tokens.words([t.encode() for _, t, _ in rows])
    root = near_dedup.link_sets([tokens.shingles(h[a:b], 5) for a, b in zip(at[:-1], at[1:])], 80)
    assert len(set(root.tolist())) < len(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dups(frame(spark, rows), percent=80).collect()}
    assert sum(got[i] != r for i, r in enumerate(root.tolist())) <= 2


def test_link_sets_is_exact():
    rnd = random.Random(8)
    sets = []
    for _ in range(120):
        s = set(rnd.sample(range(200), rnd.randint(1, 40))) if rnd.random() < 0.4 or not sets else set(rnd.choice(sets)) ^ set(rnd.sample(range(200), rnd.randint(0, 4)))
        sets.append(s or {1})
    root = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.link_sets([np.array(sorted(s), np.uint64) for s in sets], 85).tolist()
    assert all((got[a] == got[b]) == (root[a] == root[b]) for a in range(len(sets)) for b in range(a))


def test_toxicity(spark):
    rnd = random.Random(2)
    plain = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 200))]
        toxic, low = i % 7 == 0, i % 5 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["vile", "scum", "FOUL"])
        if low:
            w[rnd.randrange(len(w))] = "$$$"
        rows.append((i, " ".join(w), "s"))
        if i < 400:
            labels.append((i, 0 if low else 1, int(toxic), "x"))
    rows += [(600, None, "s"), (601, "", "s"), (None, "scum", "s")]
    labels += [(0, 0, 1, "twice"), (None, 1, 1, "x"), (3, None, 1, "x")]
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    targets = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
    chain = toxicity.train(docs, lab, targets)
    assert chain[1]["u"].shape == (1,)
    got = {r.doc_id: r for r in toxicity.classify(docs, chain, list(targets)).collect()}
    assert len(got) == len(rows)
    for i in range(400, 600):
        assert (got[i].p_toxic > 0.5) == (i % 7 == 0) and (got[i].p_low_quality > 0.5) == (i % 5 == 0)
    assert got[600].p_toxic == got[601].p_toxic < 0.5
    nothing = toxicity.train(docs, lab.limit(0), targets)
    assert all(r.p_toxic < 0.5 for r in toxicity.classify(docs, nothing, list(targets)).collect())


def test_toxicity_chain_step_by_step():
    """The second model learns from the first one's predictions on rows that this one was not fitted on; scores are those of a plain sum."""
    rnd = np.random.default_rng(3)
    n = 120
    own = [np.unique(rnd.integers(1, 40, 8).astype(np.uint64)) for _ in range(n)]
    first = np.array([float(3 in x) for x in own])
    y = np.column_stack([first, np.array([float(3 in x or 5 in x) for x in own])])
    folds = np.arange(n) % toxicity.FOLDS
    chain = toxicity.fit_chain(own, y, folds)
    alone = lambda at: toxicity.fit_chain([own[i] for i in at], y[at, :1], folds[at])[0]

    def plain(model, x, before):
        weights = dict(zip(model["words"].tolist(), model["w"].tolist(), strict=True))
        z = model["b"] + sum(weights.get(int(w), 0.0) for w in x) + sum(a * b for a, b in zip(model["u"], before, strict=True))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    oof = np.zeros(n)
    vocabulary = {int(w) for x in own for w in x if sum(w in z for z in own) >= toxicity.LEAST}
    for f in range(toxicity.FOLDS):
        model = alone(np.flatnonzero(folds != f))
        assert set(model["words"].tolist()) <= vocabulary
        for i in np.flatnonzero(folds == f):
            oof[i] = plain(model, own[i], [])
    rows_ = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in own])
    flat = np.concatenate(own)
    known = np.array(sorted(vocabulary), np.uint64)
    inside = np.isin(flat, known)
    second = toxicity._fit_linear(rows_[inside], np.searchsorted(known, flat[inside]).astype(np.int32), len(known), n, oof[:, None], y[:, 1])
    assert np.allclose(second["u"], chain[1]["u"], atol=1e-6) and np.allclose(second["b"], chain[1]["b"], atol=1e-6)
    got = toxicity.run_chain(chain, rows_, flat, n)
    for i, x in enumerate(own):
        p = plain(chain[0], x, [])
        assert got[i] == pytest.approx([p, plain(chain[1], x, [p])])


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, against plain Python on the same rows."""
    import corpus_pipeline

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    rows = [(i, (t or "") + (" vile scum" if i % 6 == 0 and t else ""), "en", s, len(t or "")) for i, t, s in corpus(8, 70)]
    base = [f"n{k}" for k in range(90)]
    for i in range(70, 84):
        rows.append((i, " ".join(w if rnd.random() > 0.01 else f"z{rnd.randrange(99)}" for w in base), "en", f"s{i % 5}", 0))
    labels = [(i, int(i % 5 > 0), int(i % 6 == 0)) for i in range(0, 60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = common.cut(stage(spark, docs, str(tmp_path)))
        docs = out[name]
    held = {k: sorted((tuple(r) for r in v.collect()), key=lambda r: (r[0], str(r[1]))) for k, v in out.items()}
    targets = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
    start = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    chain = toxicity.train(start, spark.read.parquet(str(tmp_path / "labels.parquet")), targets)

    def toxic(t):
        h, _ = tokens.words([t.encode()], toxicity.HEADS)
        p = []
        for m in chain:
            weights = dict(zip(m["words"].tolist(), m["w"].tolist(), strict=True))
            z = m["b"] + sum(weights.get(int(x), 0.0) for x in np.unique(h.reshape(-1))) + sum(a * b for a, b in zip(m["u"], p, strict=True))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        return p[1] >= 0.5

    assert held["toxicity"] == [r for r in rows if not toxic(r[1])] and 5 < len(rows) - len(held["toxicity"]) < 20
    want = [(i, t) for i, _, gone, t in _without_lines(held["toxicity"], line_dedup.MIN_WORDS) if not gone or words(t)]
    assert [r[:2] for r in held["line_dedup"]] == want
    _, root = _components([r[:3] for r in held["line_dedup"]], 80)
    assert held["near_dedup"] == [r for r in held["line_dedup"] if root[r[0]] == r[0]] and len(held["near_dedup"]) < len(held["line_dedup"])
    taken = Counter(r[0] for r in held["mixing"])
    assert set(map(tuple, held["mixing"])) <= set(held["near_dedup"]) and max(taken.values()) <= 3
    for source, (missed, median) in _missed(spark, out["near_dedup"]).items():
        have = sum(len(words(r[1])) for r in held["mixing"] if r[3] == source)
        target = next(r.target for r in mixing.mix(out["near_dedup"]).collect() if r.source == source)
        # A source of a dozen documents may have one that the others can't make up for.
        assert abs(have - target) == pytest.approx(missed) and missed <= max(median, max(len(words(r[1])) for r in held["near_dedup"] if r[3] == source) / 2 + 1)
    t = Tokenizer.from_file(path)
    ids = sorted((r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in held["mixing"])
    assert sorted((r.doc_id, r.ids) for r in out["bpe"].collect()) == ids


def test_empty_tables(spark):
    none = frame(spark, [])
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert lm.score_corpus(none, F.lit(False)).count() == 0
    assert bpe.encode(none, path).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert near_dedup.near_dups(none).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    import storyweft.llm.queries as queries

    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus(5, 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
            docs = common.cut(out)
    assert queries.QUERIES["pipeline"](spark, str(tmp_path)).count() == out.count() == docs.count() > 0


def test_pipeline_stages_with_nulls_and_repeats(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    line = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    rows = [(1, line(k), "en", "a", 0) for k in range(6)] + [(2, line(9), "en", "b", 0)] * 2 + [(3, line(9) + " end", "en", "b", 0), (None, line(9), None, None, None), (4, None, None, "a", None), (5, "", "en", None, 0), (6, line(20), "en", None, 0)]
    stages = dict(corpus_pipeline.STAGES)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, kind)
    run = lambda name, d=docs: [tuple(r) for r in stages[name](spark, d, str(tmp_path)).collect()]
    assert Counter(run("toxicity")) == Counter(rows)
    assert sorted((r[0] or 0 for r in run("near_dedup"))) == [0, 1, 2, 4, 5, 6]
    got = Counter((r[0], r[1]) for r in run("line_dedup"))
    assert got == Counter((a, b) for a, b, *_ in rows)
    # Every row of a repeated id is taken as often as the mix says for its own text.
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    have = Counter((a, s, len(words(t))) for a, t, _, s, _ in run("mixing"))
    assert have == +want and sum(have.values()) < 40
    for name in stages:
        assert run(name, spark.createDataFrame([], kind)) == []
