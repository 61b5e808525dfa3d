"""Circuit breakers over tables of calls, as a scan.

A run of calls is a function from the breaker's state before it to its state after it.  Closed with n failures, it is looked
up by n.  Open since a time, all that counts is the first call that the breaker lets through, which follows from that time by
binary search among the calls that are later than all before them; what happens then is known for each of these.  So calls are
dealt by ranges of key and order, each range sums up the runs at its two ends, these are applied one after the other to give
the state at the start of every range, and the ranges decide their calls.  A key with a third of all calls lies in as many
ranges as its calls need.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tessera.functions.effects import FAILURES, TIMEOUT, CircuitBreaker
from tessera.materialize import materialized

State = tuple[int, bool, float | None]  # failures, open, time of the last failure
CLOSED: State = (0, False, None)


def summary(calls: list[tuple[float, str]], threshold: int = FAILURES, timeout: float = TIMEOUT) -> dict:
    """What a run of calls (time, outcome) does: ``closed``, the state after it by the number of failures before it, and
    ``open``, pieces (time, state): an open breaker ends in the state of the first piece whose time is late enough for it.

    A state is (failures, open, last, added): with ``added``, failures are added to those before.  Worked out from the last
    call back; ``late`` holds the calls that a breaker can be let through at, from the last to the first: each later in time
    than those after it on the list.
    """
    closed: list = [(n, False, None, False) for n in range(threshold)]
    late: list[tuple[float, tuple]] = []  # falling times: the first call to come is the last entry

    def opened(at: float, failures: int, added: bool) -> tuple:
        """The end of a breaker that opened at a time, before the calls on the list."""
        # from the back of the list times rise: find the first that is late enough
        k = bisect_left(range(len(late)), True, key=lambda i: late[len(late) - 1 - i][0] - at >= timeout)
        if k == len(late):
            return (failures, True, at, added)
        n, is_open, last, more = late[len(late) - 1 - k][1]
        return (n + failures, is_open, last, added) if more else (n, is_open, last, False)

    for at, outcome in reversed(calls):
        if outcome == "allow":
            continue
        if outcome == "fail":
            trial = opened(at, 1, True)
            closed = [*closed[1:], opened(at, threshold, False)]
        else:
            trial = closed[0]
            closed = [closed[0]] * threshold
        if at == at:  # no breaker is let through at a time that isn't one
            while late and late[-1][0] <= at:
                late.pop()
            late.append((at, trial))
    pieces: list = []
    for at, end in reversed(late):  # neighbours with the same end are one piece, up to its latest call
        if pieces and pieces[-1][1] == end:
            pieces[-1] = (at, end)
        else:
            pieces.append((at, end))
    return {"closed": closed, "open": pieces}


def applied(state: State, run: dict, timeout: float = TIMEOUT) -> State:
    """The state after a run of calls."""
    failures, is_open, last = state
    if not is_open:
        n, now, since, _ = run["closed"][failures]
        return n, now, since
    pieces = run["open"]
    k = len(pieces) if last is None else bisect_left(range(len(pieces)), True, key=lambda i: pieces[i][0] - last >= timeout)
    if k == len(pieces):
        return state
    n, now, since, added = pieces[k][1]
    return (n + failures if added else n), now, since


def decisions(events: DataFrame, key: str, order: list[str], at: str, outcome: str, threshold: int = FAILURES, timeout: float = TIMEOUT) -> DataFrame:
    """Rows (key, order, outcome, allowed, open, failures): whether each call of a key was allowed, given the calls before it,
    with the state before it.

    ``outcome``: ``fail``, ``success`` or ``allow`` (a question that changes nothing); ``at``: seconds.  A refused call changes
    nothing either.  A null outcome counts as a success, like any other word.  Calls equal in key and order stand in the order
    of time and outcome; a null key is a key.
    """
    kept = events.select(key, *order, F.col(outcome).alias("outcome"), F.col(at).cast("double").alias("_at"))
    places = [key, *order, "_at", "outcome"]
    dealt = kept.repartitionByRange(*places).sortWithinPartitions(*places)
    dealt = materialized(dealt.withColumn("_range", F.spark_partition_id()))  # both passes must see the same ranges
    starts = _starts(_ends(dealt, key, threshold, timeout), threshold, timeout)
    shape = StructType([*kept.drop("_at").schema.fields, StructField("allowed", BooleanType()), StructField("open", BooleanType()), StructField("failures", IntegerType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, breaker = [0.0], None, None
        for batch in batches:
            allowed, is_open, failures = [], [], []
            for k, t, what, part in zip(batch[key].astype(object).where(batch[key].notna(), None), batch["_at"], batch["outcome"], batch["_range"], strict=True):
                if breaker is None or k != last:
                    begun = starts.get(part, CLOSED) if breaker is None else CLOSED
                    last, breaker = k, CircuitBreaker(threshold, timeout, lambda: now[0], *begun)
                now[0] = t
                allowed.append(breaker.allow()), is_open.append(breaker.opened), failures.append(breaker.failures)
                if allowed[-1] and what != "allow":
                    breaker.failure() if what == "fail" else breaker.success()
            yield batch.drop(columns=["_at", "_range"]).assign(allowed=allowed, open=is_open, failures=failures)

    return dealt.mapInPandas(decide, shape)


ENDS = "part int, first boolean, last boolean, name string, run string"


def _ends(dealt: DataFrame, key: str, threshold: int, timeout: float) -> DataFrame:
    """For every range the runs of its first and its last key, which may go on in its neighbours; one row if they are the same."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, run, last, part = [], None, None, 0

        def end(is_last: bool) -> None:
            if run is not None and (not out or is_last):
                name = None if last is None else str(last)
                out.append((part, not out, is_last, name, json.dumps(summary(run, threshold, timeout))))

        for batch in batches:
            for k, t, what, p in zip(batch[key].astype(object).where(batch[key].notna(), None), batch["_at"], batch["outcome"], batch["_range"], strict=True):
                if run is None or k != last:
                    end(False)
                    run, last, part = [], k, p
                run.append((t, what))
        end(True)
        yield pd.DataFrame(out, columns=["part", "first", "last", "name", "run"])

    return dealt.mapInPandas(find, ENDS)


def _starts(ends: DataFrame, threshold: int, timeout: float) -> dict[int, State]:
    """The state in which each range begins, for ranges whose first key began before: at most one for each range.

    A range has two rows here at most, however many calls it has.  They are folded in the order of the ranges; only the states
    come to the driver.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, state, name, open_end = [], CLOSED, None, False
        for batch in batches:
            for r in batch.itertuples(index=False):
                goes_on = r.first and open_end and r.name == name
                if goes_on and state != CLOSED:
                    out.append((r.part, json.dumps(state)))
                state = applied(state if goes_on else CLOSED, json.loads(r.run), timeout)
                name, open_end = r.name, r.last
        yield pd.DataFrame(out, columns=["part", "state"])

    rows = ends.repartition(1).sortWithinPartitions("part", F.desc("first"))
    return {r["part"]: tuple(json.loads(r["state"])) for r in rows.mapInPandas(fold, "part int, state string").collect()}
