"""Breakers, retries and guarded models, in batch and on streams."""

import pytest

from tessera.errors import ModelError
from tessera.functions import effects
from tessera.streaming import state

CALLS = [(1, 0, "fail"), (2, 1, "fail"), (3, 30, "allow"), (4, 61, "allow"), (5, 61, "fail"), (6, 100, "allow"), (7, 121, "allow"), (8, 122, "success"), (9, 123, "allow")]
ALLOWED = [True, True, False, True, True, False, True, True, True]


def test_breaker():
    now = [0.0]
    b = effects.CircuitBreaker(2, 60, lambda: now[0])
    got = []
    for _, at, outcome in CALLS:
        now[0] = at
        got.append(b.allow())
        if got[-1] and outcome != "allow":
            b.failure() if outcome == "fail" else b.success()
    assert got == ALLOWED and b.failures == 0


def test_breaker_fold(spark):
    events = spark.createDataFrame([("p", *c) for c in CALLS], "key string, seq long, at long, outcome string")
    got = effects.breaker_decisions(events, "key", ["seq"], "at", "outcome", 2, 60).orderBy("seq").collect()
    assert [r["allowed"] for r in got] == ALLOWED


def test_breaker_stream(spark, tmp_path):
    events = spark.createDataFrame([("p", *c) for c in CALLS], "key string, seq long, at long, outcome string").coalesce(1)
    for k, part in enumerate((events.where("seq <= 4"), events.where("seq > 4"))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = state.breaker_stream(stream, 2, 60).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n, k=k: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r["allowed"] for r in got] == ALLOWED


def test_context_stream(spark, tmp_path):
    from tessera.operators.context import add_context

    rows = spark.createDataFrame([("k", i, f"text number {i} " * 5, "s", 0.1 * (i % 7), "t") for i in range(20)], "key string, seq long, content string, section_name string, importance_score double, context_type string").coalesce(1)
    for part in (rows.where("seq < 9"), rows.where("seq >= 9")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = state.context_stream(stream, 300).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, add_context(rows, 300).collect()))


def test_store_stream_is_the_batch(spark, tmp_path):
    """Additions and queries of several keys in batches: usage counts, sections and contexts are those of one fold."""
    import random

    from tessera.operators.context import EVENTS, ContextStore, run_store

    rng = random.Random(8)
    words = "alpha beta gamma delta omega".split()
    rows = [(f"k{n % 3}", n, "ask" if n % 4 == 3 else None, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["s", "t", ""]), rng.random(), "note", 1000.0 * n) for n in range(90)]
    frame = spark.createDataFrame(rows, EVENTS)
    want = {(r["key"], r["seq"]): tuple(r) for r in run_store(frame, 200).collect()}
    store, seen = ContextStore(max_length=200), {}
    for key, seq, kind, text, section, importance, type_, at in rows:
        if key == "k0":
            store.ask(text, at) if kind else store.add(text, section, importance, type_, at)
            if not kind and section:
                seen[section] = seen.get(section, 0) + 1
            got = want[key, seq]
            assert got[5:8] == (len(store.items), store.size(), sum(i["usage_count"] for i in store.items)) and got[8] == (seen[section] if not kind and section else None)
    assert any(r[4] for r in want.values()) and max(r[7] for r in want.values()) > 3
    for part in (frame.where("seq < 40"), frame.where("seq >= 40")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        q = state.store_stream(stream, 200).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination(180)
    assert {(r["key"], r["seq"]): tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_retries():
    waits, calls = [], iter(["short", RuntimeError("x"), "a long enough answer"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert effects.with_retries(call, sleep=waits.append) == "a long enough answer"
    assert waits == [1.0, 2.0]
    with pytest.raises(ModelError, match="3 attempts"):
        effects.with_retries(lambda: "no", sleep=waits.append)


def test_guarded_model():
    class Broken:
        def call(self, *_):
            raise RuntimeError("down")

    m = effects.GuardedModel(Broken(), retries=0, breaker=effects.CircuitBreaker(2, 60))
    for _ in range(2):
        with pytest.raises(ModelError, match="down"):
            m.call([{"role": "user", "content": "x"}])
    with pytest.raises(ModelError, match="circuit open"):
        m.call([])
    assert m.breaker.failures == 2
    with pytest.raises(NotImplementedError):
        m.call([], stream=True)
    with pytest.raises(ModelError):
        effects.language_model("none")


def test_ask_and_embed(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("hello there",), (None,)], "t string")
    got = rows.select(effects.ask(F.col("t"), effects.EchoModel("> ")).alias("a")).collect()
    assert got[0]["a"]["text"] == "> hello there" and not got[1]["a"]["ok"]
    v = rows.select(effects.embed(F.col("t"), effects.HashingEmbedder(16)).alias("v")).collect()
    assert sum(x * x for x in v[0]["v"]) == pytest.approx(1) and set(v[1]["v"]) == {0.0}
