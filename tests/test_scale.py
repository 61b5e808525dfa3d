"""Operators that keep a key of any size from one task, against plain loops: matrix scores, breakers, prefix sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.effects import CircuitBreaker
from tessera.operators import analysis, breaker, context, mapping, prefix
from tessera.operators.dense import DenseScores

CHUNKS = "doc_id long, chunk_id int, embedding array<double>"
SECTIONS = "node_idx int, embedding array<double>"


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if 0 < size < math.inf else 0.0


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(1)
    draw = lambda n: [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0, 2.0]) for _ in range(n)]
    chunks = [(d, c, draw(4)) for d in range(6) for c in range(20)] + [(9, 0, None), (9, 1, []), (9, 2, [0.0] * 4), (9, 3, [1.0, None, 2.0, 0.0]), (9, 4, [1.0, 2.0]), (9, 5, [math.inf, 1.0, 0.0, 0.0])]
    sections = [(k, draw(4)) for k in range(11)] + [(11, None), (12, [0.0] * 4), (13, [2.0, 4.0]), (14, draw(4))]
    sections[7] = (7, sections[3][1])  # the same vector twice
    rng.shuffle(sections)
    return chunks, sections


@pytest.mark.parametrize("most", [1 << 20, 100, 1])
def test_best_sections(spark, vectors, most):
    chunks, sections = vectors
    scores = DenseScores(spark.createDataFrame(chunks, CHUNKS).repartition(5), spark.createDataFrame(sections, SECTIONS), most=most)
    got = {(r["doc_id"], r["chunk_id"]): r for r in scores.best().collect()}
    assert len(got) == len(chunks)
    for d, c, v in chunks:
        ranked = sorted((-round(cosine(v, s), 9), n) for n, s in sections)
        r = got[d, c]
        assert (r["node_idx"], r["score"]) == (ranked[0][1], pytest.approx(-ranked[0][0], abs=1e-8))
        assert r["second_score"] == pytest.approx(-ranked[1][0], abs=1e-8) and r["second_idx"] in {n for s, n in ranked[1:] if s == ranked[1][0]}
    pairs = [(d, c, n, "x") for d, c, _ in chunks for n in (0, 7, 11, 13, 99)]
    found = {(r["doc_id"], r["chunk_id"], r["node_idx"]): r["score"] for r in scores.of(spark.createDataFrame(pairs, "doc_id long, chunk_id int, node_idx int, more string")).collect()}
    by = dict(sections)
    assert found == {(d, c, n): pytest.approx(cosine(v, by[n]), abs=1e-12) for d, c, v in chunks for n in (0, 7, 11, 13)}


def test_best_without_sections(spark, vectors):
    chunks = spark.createDataFrame(vectors[0], CHUNKS)
    none = spark.createDataFrame([], SECTIONS)
    assert {(r["node_idx"], r["score"], r["second_idx"]) for r in DenseScores(chunks, none).best().collect()} == {(None, None, None)}
    assert {r["method"] for r in mapping.assign(chunks, DenseScores(chunks, none)).collect()} == {"orphan"}
    assert DenseScores(chunks.limit(0), spark.createDataFrame(vectors[1], SECTIONS)).best().count() == 0


def test_no_row_for_a_chunk_and_a_section(spark, vectors):
    scores = DenseScores(spark.createDataFrame(vectors[0], CHUNKS), spark.createDataFrame(vectors[1], SECTIONS))
    plan = scores.best()._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("dense", [True, False])
def test_sparse_boost_is_the_boost_of_all_pairs(spark, vectors, dense):
    chunks, sections = vectors
    rng = random.Random(2)
    edges = list({(d, c, rng.randrange(20)) for d, c, _ in chunks if d < 6 for _ in range(3)})
    frame, scores = spark.createDataFrame(chunks, CHUNKS), {(d, c, n): cosine(v, s) for d, c, v in chunks for n, s in sections}
    best = {}
    for (d, c, n), s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0][2])):
        best.setdefault((d, c), (n, s))
    sure = {k: n for k, (n, s) in best.items() if s >= 0.6}
    raised = dict(scores)
    for d, src, dst in edges:
        if (d, dst) in sure:
            raised[d, src, sure[d, dst]] += 0.5
    want = {}
    for (d, c, n), s in sorted(raised.items(), key=lambda x: (-round(min(1.0, x[1]) if x[1] != scores[x[0]] else x[1], 9), x[0][2])):
        want.setdefault((d, c), (n, min(1.0, s) if s != scores[d, c, n] else s))
    found = DenseScores(frame, spark.createDataFrame(sections, SECTIONS)) if dense else spark.createDataFrame([(*k, s) for k, s in scores.items()], "doc_id long, chunk_id int, node_idx int, score double")
    got = mapping.graph_boost(found, spark.createDataFrame([(*e, 0) for e in edges], "doc_id long, src int, dst int, ref_pos int"))
    for r in got.collect():
        n, s = want[r["doc_id"], r["chunk_id"]]
        assert r["score"] == pytest.approx(s, abs=1e-9)
        assert r["node_idx"] == n or raised[r["doc_id"], r["chunk_id"], r["node_idx"]] == pytest.approx(raised[r["doc_id"], r["chunk_id"], n], abs=1e-9) or s == 1.0
    assert got.count() == len(chunks)


def test_boost_of_pairs_that_are_not_listed(spark):
    """A pair without a score scores 0, and is raised from there."""
    scores = spark.createDataFrame([(1, 0, 0, 0.9)], "doc_id long, chunk_id int, node_idx int, score double")
    edges = spark.createDataFrame([(1, 1, 0, 0)], "doc_id long, src int, dst int, ref_pos int")
    assert {(r["chunk_id"], r["node_idx"], r["score"]) for r in mapping.graph_boost(scores, edges).collect()} == {(0, 0, 0.9), (1, 0, 0.5)}


# --- breakers ---------------------------------------------------------------------------------------------------------
def fold(calls, threshold, timeout, state=(0, False, None)):
    now = [0.0]
    b = CircuitBreaker(threshold, timeout, lambda: now[0], *state)
    out = []
    for at, what in calls:
        now[0] = at
        out.append((b.allow(), b.opened, b.failures))
        if out[-1][0] and what != "allow":
            b.failure() if what == "fail" else b.success()
    return out, (b.failures, b.opened, b.last)


def draw_calls(rng, n, rising):
    at, out = 0.0, []
    for _ in range(n):
        at = at + rng.choice([0, 1, 5, 30]) if rising else rng.uniform(0, 300)
        out.append((at if rng.random() > 0.02 else math.nan, rng.choices(["fail", "success", "allow"], [5, 1, 2])[0]))
    return out


@pytest.mark.parametrize("rising", [True, False])
def test_summary_is_the_fold(rising):
    rng = random.Random(3)
    same = lambda a, b: a[:2] == b[:2] and (a[2] == b[2] or a[2] is not None and b[2] is not None and math.isnan(a[2]) and math.isnan(b[2]))
    for _ in range(400):
        threshold, timeout = rng.randint(1, 4), rng.choice([1.0, 10.0, 60.0])
        calls = draw_calls(rng, rng.randint(0, 25), rising)
        run = breaker.summary(calls, threshold, timeout)
        starts = [(n, False, None) for n in range(threshold)] + [(threshold + k, True, rng.uniform(-50, 300)) for k in range(4)] + [(threshold, True, math.nan)]
        for s in starts:
            assert same(breaker.applied(s, run, timeout), fold(calls, threshold, timeout, s)[1]), (calls, s)


@pytest.mark.parametrize("rising", [True, False])
def test_decisions_of_a_hot_key(spark, rising):
    """A third of all calls have one key: the same as the fold, and its calls lie in several ranges."""
    rng = random.Random(4)
    keys = {None: 40, "hot": 3000, **{f"k{n}": rng.randint(1, 60) for n in range(150)}}
    rows, want = [], {}
    for k, n in keys.items():
        calls = draw_calls(rng, n, rising)
        calls = [(a if a == a else 0.0, w) for a, w in calls]
        for seq, ((at, what), seen) in enumerate(zip(calls, fold(calls, 3, 40.0)[0], strict=True)):
            rows.append((k, seq, at, what))
            want[k, seq] = seen
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "key string, seq long, at double, outcome string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = breaker.decisions(events, "key", ["seq"], "at", "outcome", 3, 40.0)
        got = {(r["key"], r["seq"]): (r["allowed"], r["open"], r["failures"]) for r in found.collect()}
        parts = found.where("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == want and parts > 1
    assert breaker.decisions(events.limit(0), "key", ["seq"], "at", "outcome").count() == 0


# --- prefix sums ------------------------------------------------------------------------------------------------------
def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if k % 3 else rng.choice([None, "a", "b"]), rng.randint(0, 40), rng.choice([None, rng.randint(0, 9)])) for k in range(4000)]
    got = prefix.running(spark.createDataFrame(rows, "g string, o int, v int").repartition(7), ["g"], [F.desc("o")], {"s": "v"}).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r)
    assert {g: len(x) for g, x in by.items()} == {g: sum(r[0] == g for r in rows) for g in by}
    for g, own in by.items():
        own.sort(key=lambda r: r["_n"])
        assert [r["_n"] for r in own] == list(range(1, len(own) + 1)) and [r["o"] for r in own] == sorted((r[1] for r in rows if r[0] == g), reverse=True)
        at = None
        for r in own:
            at = at if r["v"] is None else (at or 0) + r["v"]
            assert r["s"] == at


def test_running_mean_with_nulls(spark):
    rows = [("k", n, None if n % 4 == 0 else float(n)) for n in range(50)]
    got = {r["o"]: r["running_mean"] for r in analysis.running_mean(spark.createDataFrame(rows, "k string, o int, similarity double"), ["k"], "o").collect()}
    for n in range(50):
        there = [r[2] for r in rows[: n + 1] if r[2] is not None]
        assert got[n] == (pytest.approx(np.mean(there)) if there else None)


def plain_context(rows, limit):
    parts, size = [], 0
    for _, _, t in sorted(((-s, p, t) for s, p, t in rows if t and t.strip())):
        more = len(t) + (2 if parts else 0)
        if size + more <= limit:
            parts.append(t)
            size += more
            continue
        left = limit - size - (2 if parts else 0)
        if left > 50:
            parts.append(t[:left] + "...")
        break
    whole = "\n\n".join(parts)
    return whole[: limit - 3] + "..." if len(whole) > limit else whole


def test_context_of_one_key(spark):
    """All rows have one key; only the prefix that is kept has its texts fetched."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 30) / 10, k, rng.choice([None, "", " \n"]) if k % 9 == 0 else "x" * rng.randint(1, 90)) for k in range(3000)]
    frame = spark.createDataFrame([(1, *r) for r in rows], "q long, relevance double, position long, text string").repartition(6)
    for limit in (2000, 700, 60):
        assert context.build_context(frame, ["q"], max_length=limit).first()["context"] == plain_context(rows, limit)


def test_prune_of_one_key(spark):
    rng = random.Random(7)
    rows = [("k" if n % 3 else f"s{n % 40}", n, "y" * rng.randint(0, 30), rng.random(), rng.random(), rng.randint(0, 5)) for n in range(1500)] * 2
    frame = spark.createDataFrame(rows, "key string, position long, content string, importance_score double, relevance_score double, usage_count int").repartition(5)
    got = {}
    for r in context.prune(frame, ["key"], 300).collect():
        got.setdefault(r["key"], []).append((r["kept_rank"], r["position"]))
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        if sum(len(r[2]) for r in own) <= 300:
            want = [r[1] for r in sorted(own, key=lambda r: r[1])]
        else:
            want, size = [], 0
            for r in sorted(own, key=lambda r: (-(r[3] * 0.4 + r[4] * 0.4 + min(r[5] / 10, 0.2)), r[1])):
                size += len(r[2])
                if size > 300:
                    break
                want.append(r[1])
        assert [p for _, p in sorted(got.get(key, []))] == want
