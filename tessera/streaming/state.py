"""Streaming forms of the operators with state: circuit breakers, context stores, running statistics.

Breakers and stores are processors of ``transformWithState``: a breaker's three numbers are a value, a store's items a list,
the numbers of items of each section a map, all in RocksDB.  A trigger's rows of a key are taken in the order of their
sequence number, so a key's rows of one trigger must fit in memory: limit them by ``maxFilesPerTrigger`` or
``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.effects import FAILURES, TIMEOUT, CircuitBreaker
from tessera.operators.context import ANSWERS, MAX_CONTEXT, ContextStore, answer, event_rows

DECISIONS = "key string, seq long, outcome string, allowed boolean, failures int"


def _with_rocksdb(spark: SparkSession) -> None:
    """States of several variables need this store; it counts for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BreakerProcessor(StatefulProcessor):
    """A key's breaker: failures, whether it is open, and since when."""

    def __init__(self, threshold: int, timeout: float):
        self.threshold, self.timeout = threshold, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failures int, opened boolean, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = [0.0]
        breaker = CircuitBreaker(self.threshold, self.timeout, lambda: now[0], *(self.state.get() or (0, False, None)))
        for r in sorted(rows, key=lambda r: r.seq):
            now[0] = r.at
            allowed = breaker.allow()
            yield Row(key=key[0], seq=r.seq, outcome=r.outcome, allowed=allowed, failures=breaker.failures)
            if allowed and r.outcome != "allow":
                breaker.failure() if r.outcome == "fail" else breaker.success()
        self.state.update((breaker.failures, breaker.opened, breaker.last))

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, threshold: int = FAILURES, timeout: float = TIMEOUT) -> DataFrame:
    """Decisions on events (key, seq, at, outcome) as ``operators.breaker.decisions`` makes them, on a stream."""
    _with_rocksdb(events.sparkSession)
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), "outcome")
    return rows.groupBy("key").transformWithState(BreakerProcessor(threshold, timeout), DECISIONS, "Update", "None")


class StoreProcessor(StatefulProcessor):
    """A key's context store: a list of its items with their uses, and a map of how many items each section has had."""

    FIELDS = ("content", "section_name", "importance_score", "context_type", "at", "usage_count", "relevance_score")

    def __init__(self, max_length: int):
        self.max_length = max_length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "content string, section_name string, importance_score double, context_type string, at double, usage_count int, relevance_score double")
        self.sections = handle.getMapState("sections", "name string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        store = ContextStore([dict(zip(self.FIELDS, i, strict=True)) for i in self.items.get()], self.max_length)
        names = [c.split()[0] for c in ANSWERS.split(", ")]
        for r in sorted(rows, key=lambda r: r.seq):
            yield Row(**dict(zip(names, (key[0], r.seq, *answer(store, self._count, r)), strict=True)))
        if store.items:
            self.items.put([tuple(i[f] for f in self.FIELDS) for i in store.items])
        else:
            self.items.clear()

    def _count(self, name: str) -> int:
        n = (self.sections.getValue((name,))[0] if self.sections.containsKey((name,)) else 0) + 1
        self.sections.updateValue((name,), (n,))
        return n

    def close(self) -> None:
        pass


def store_stream(events: DataFrame, max_length: int = MAX_CONTEXT) -> DataFrame:
    """Answers of each key's context store on a stream, as ``context.run_store`` gives them.

    Queries raise the usage counts of the items, which later prunings weigh.
    """
    _with_rocksdb(events.sparkSession)
    return event_rows(events).groupBy("key").transformWithState(StoreProcessor(max_length), ANSWERS, "Update", "None")


def context_stream(items: DataFrame, max_length: int = MAX_CONTEXT) -> DataFrame:
    """Additions to each key's context store on a stream, as ``context.add_context`` makes them."""
    return store_stream(items.drop("kind"), max_length).select("key", "seq", "relevance_score", "n_items", "total_chars")


def stats_stream(results: DataFrame) -> DataFrame:
    """Running validation statistics (A7): the aggregation is incremental by itself."""
    return results.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("passed"), F.avg("similarity").alias("average_similarity"))
