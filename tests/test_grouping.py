"""Groups of one story read in chunks against the rules over all its pairs, and what is held for them."""

import numpy as np
import pytest

from storyweft.operators import grouping, people


def _vectors(n, seed, width=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 6, width))[rng.integers(0, n // 6, n)] + rng.normal(size=(n, width)) * rng.choice([0.1, 0.6], size=(n, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _frame(spark, x, story=1):
    rng = np.random.default_rng(8)
    rows = [(story, 10 * i, f"s{i % 40}" if i % 3 else None, f"o{i % 5}" if i % 7 else None, f"w{i}", "en", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "story long, pos long, speaker string, source string, wording string, lang string, vector array<double>").repartition(3)


def _old_versions(known, source, sim, floor, same):
    n = len(known)
    alike = [(i, j) for i in range(n) for j in range(i) if sim[i, j] >= same and source[i] != source[j]]
    first = {}
    speaker = grouping.unite(n, alike + [(first.setdefault(k, i), i) for i, k in enumerate(known) if k is not None])
    free, out = dict.fromkeys(sorted(range(n), key=lambda i: (speaker[i], known[i] is None, i))), []
    while free:
        lead = next(iter(free))
        near = [i for i in free if i != lead and speaker[i] == speaker[lead] and sim[lead, i] >= floor and source[i] != source[lead]]
        group = [lead, *{source[i]: i for i in reversed(near)}.values()]
        for i in group:
            free.pop(i)
        out.append([lead, *sorted(group[1:], key=near.index)])
    return speaker, out


@pytest.mark.parametrize("n", [700, 90])
def test_groups_in_chunks_are_those_of_all_pairs(spark, n):
    x = _vectors(n, 4)
    sim, rows = x @ x.T, _frame(spark, x).unionByName(_frame(spark, x[:50], 2))
    got = {(r.story, r.pos): r.leader for r in grouping.leader_groups(rows, 0.8).collect()}
    for story, m in ((1, n), (2, 50)):
        assert [got[story, 10 * i] for i in range(m)] == [10 * k if k >= 0 else -1 for k in grouping.leaders(sim[:m, :m], 0.8)]
    got = {(r.story, r.pos): r.part for r in grouping.linkage_partitions(rows, 0.7).collect()}
    for story, m in ((1, n), (2, 50)):
        want = {i: k for k, g in enumerate(grouping.complete_linkage(m, lambda i, j: sim[i, j] >= 0.7)) for i in g}
        assert [got[story, 10 * i] for i in range(m)] == [want[i] for i in range(m)] and len(set(want.values())) > 5


@pytest.mark.parametrize("n, same", [(700, 0.93), (90, 0.99)])
def test_speakers_and_remarks_are_those_of_all_pairs(spark, n, same):
    x = _vectors(n, 5)
    rows, sim = _frame(spark, x), x @ x.T
    # Speakers apart enough that there are several.
    from pyspark.sql import functions as F

    rows = rows.withColumn("speaker", F.when(F.col("pos") % 40 == 0, F.concat(F.lit("s"), (F.col("pos") / 10 % 35).cast("int"))))
    known = [f"s{i % 35}" if i % 4 == 0 else None for i in range(n)]
    source = [f"o{i % 5}" if i % 7 else None for i in range(n)]
    speaker, groups = _old_versions(known, source, sim, 0.5, same)
    got = {r.pos: r.component for r in grouping.speaker_components(rows, same, tile=64).collect()}
    assert [got[10 * i] for i in range(n)] == [10 * s for s in speaker] and len(set(speaker)) > 5
    got = sorted((r.remark, r.version, r.pos, r.outlets) for r in people.remarks(rows, 0.5, same).collect())
    assert got == sorted((10 * g[0], v, 10 * i, len(g)) for g in groups for v, i in enumerate(g))


def test_what_is_held_grows_with_the_rows():
    """Many rows around few directions: leaders keep those only; a chunk meets its matrix of at most CELLS cells."""
    rng = np.random.default_rng(1)
    x = np.eye(8)[rng.integers(0, 8, 40_000)] + rng.normal(size=(40_000, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    state = grouping.Leaders(0.6)
    out = [r for a in range(0, len(x), 256) for r in state.take(np.arange(a, min(len(x), a + 256)), x[a : a + 256])]
    assert state.kept.n == 8 and len(out) == len(x) - 8 and len(state.end()) == 8


def test_digest_is_dealt_once_over_more_tasks_for_more_input(spark):
    from storyweft.operators import comparison

    rows = [(i % 9, i, f"o{i % 3}", f"t{i % 2}", "kg", float(i % 5)) for i in range(200)]
    figures = spark.createDataFrame(rows, "story long, pos long, source string, sentence string, unit string, value double")
    plan = comparison.digest(figures.repartition(8))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(story" in plan and f", {8 * comparison.SHARE})" in plan and "ENSURE_REQUIREMENTS" not in plan
    got, want = (sorted(map(str, comparison.digest(f).collect())) for f in (figures.repartition(8), figures.coalesce(1)))
    assert got == want and len(got) == 9
