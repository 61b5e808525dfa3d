"""Context budgets (C9, C12-C16, A8): ranked texts cut to a number of characters.

Budgets are running sums by rank, in two levels (``prefix``): lengths aren't negative, so what fits before the first that
doesn't is a prefix, and only for that are texts fetched.  ``add_context`` depends on what was added before and is a fold over one key's items, in the order of time.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import head
from tessera.functions.vector import combined_score, recency, retention_score
from tessera.operators.prefix import fetch, running

# The budget, the separator's length, the least part of a text, sizes of excerpts.
MAX_CONTEXT = 2000
SEPARATOR = "\n\n"
LEAST_PART = 50
EXCERPT = 300
SUMMARY = 200


def build_context(scored: DataFrame, by: list[str], text: str = "text", score: str = "relevance", position: str = "position", max_length: int | None = MAX_CONTEXT, literal: bool = False) -> DataFrame:
    """Rows (by, context): texts by falling score as far as they fit, the first that doesn't cut if much is left.

    Blank texts are left out; equal scores keep the order of ``position``.  A budget of None is the default; with ``literal``
    so is 0.
    """
    if max_length is None or literal and not max_length:
        max_length = MAX_CONTEXT
    there = scored.where(F.col(text).rlike(r"\S"))
    mark = F.xxhash64(text)
    sized = there.select(*by, F.col(score).alias("_score"), F.col(position).alias("_at"), mark.alias("_mark"), F.length(text).alias("_len"))
    rows = running(sized, by, [F.desc("_score"), F.col("_at"), F.col("_mark")], {"_sum": "_len"})
    end = F.col("_sum") + 2 * (F.col("_n") - 1)
    before = F.when(F.col("_n") > 1, end - F.col("_len") - 2).otherwise(0)
    left = max_length - (end - F.col("_len"))
    kept = rows.where((end <= max_length) | (before <= max_length) & (left > LEAST_PART)).select(*by, "_n", "_at", "_mark", F.when(end > max_length, left).alias("_left"))
    texts = there.select(*by, F.col(position).alias("_at"), mark.alias("_mark"), F.col(text).alias("_text"))
    found = fetch(kept, texts, [*by, "_at", "_mark"], ["_text"])
    part = F.when(F.col("_left").isNull(), F.col("_text")).otherwise(F.concat(F.left("_text", F.col("_left").cast("int")), F.lit("...")))
    whole = found.withColumn("_part", part).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_part"))), lambda x: x["_part"]), SEPARATOR).alias("context"))
    return whole.withColumn("context", F.when(F.length("context") > max_length, F.concat(F.left("context", F.lit(max_length - 3)), F.lit("..."))).otherwise(F.col("context")))


def prune(items: DataFrame, by: list[str], max_length: int = MAX_CONTEXT, position: str = "position") -> DataFrame:
    """Items that stay (C13, W4): all if they fit, else the best by retention before the first that doesn't fit.

    ``kept_rank`` orders them: by retention if something had to go, else as they came.  Only lengths and ranks are summed;
    the items themselves are fetched for those that stay.  A null content has no length.
    """
    items = items.drop("retention", "kept_rank")
    mark = F.xxhash64(*items.columns)
    sized = items.select(*by, F.col(position).alias("_at"), mark.alias("_mark"), F.coalesce(F.length("content"), F.lit(0)).alias("_len"), retention_score(F.col("importance_score"), F.col("relevance_score"), F.col("usage_count")).alias("retention"))
    total = sized.groupBy(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]).agg(F.sum("_len").alias("_total"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    sized = sized.join(total, same).withColumn("_fits", F.col("_total") <= max_length).select(*by, "_at", "_mark", "_len", "retention", "_fits")
    rows = running(sized, [*by, "_fits"], [F.desc(F.when(~F.col("_fits"), F.col("retention"))), F.col("_at"), F.col("_mark")], {"_sum": "_len"}, "kept_rank")
    kept = rows.where(F.col("_fits") | (F.col("_sum") <= max_length)).drop("_len", "_fits", "_sum")
    others = [c for c in items.columns if c not in (*by, position)]
    found = fetch(kept, items.select(*by, F.col(position).alias("_at"), mark.alias("_mark"), *others), [*by, "_at", "_mark"], others)
    return found.withColumnRenamed("_at", position).select(*items.columns, "retention", "kept_rank")


def document_context(items: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """Rows (by, context): excerpts by falling importance (C14)."""
    entry = F.struct((-F.col("importance_score")).alias("i"), F.col(position).alias("p"), head(F.col("content"), SUMMARY, dots=True).alias("t"))
    return items.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), SEPARATOR).alias("context"))


def relevant_context(items: DataFrame, by: list[str], now: Column, k: int = 5, position: str = "position") -> DataFrame:
    """Rows (by, context, n_items): the k best items for a query, formatted.

    Items carry ``relevance`` to the query.  Every item of a key counts as used once more: see ``used``.
    """
    score = combined_score(F.col("relevance"), F.col("importance_score"), recency(now, F.col("timestamp")))
    order = Window.partitionBy(*by).orderBy(F.desc("_score"), position)
    best = items.withColumn("_score", score).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    section = F.when(F.coalesce(F.col("section_name"), F.lit("")) != "", F.concat(F.lit(" ("), F.col("section_name"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("["), F.upper("context_type"), section, F.lit("]: "), F.left("content", F.lit(EXCERPT)))
    return best.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))), lambda x: x["t"]), SEPARATOR).alias("context"), F.count(F.lit(1)).alias("n_items"))


def used(items: DataFrame) -> DataFrame:
    return items.withColumn("usage_count", F.col("usage_count") + 1)


def context_stats(items: DataFrame, by: list[str]) -> DataFrame:
    """Average relevance, number and characters of each key's items, zeros where there are none."""
    return items.groupBy(*by).agg(F.coalesce(F.avg("relevance_score"), F.lit(0.0)).alias("avg_relevance"), F.count("content").alias("n_items"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("total_chars"))


def section_index(items: DataFrame, by: list[str]) -> DataFrame:
    """All items ever added to each section, never pruned."""
    return items.where("section_name <> ''").groupBy(*by, "section_name").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("items"))


# --- the sequential store ---------------------------------------------------------------------------------------------


def _terms(text: str) -> Counter:
    return Counter(t for t in re.split(r"[\W_]+", text.lower()) if t)


def text_cosine(a: str, b: str) -> float:
    x, y = _terms(a), _terms(b)
    size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[t] for t, v in x.items()) / size if size else 0.0


class ContextStore:
    """Items of one key; bounded by the budget after each addition (C12), scored by queries."""

    def __init__(self, items: list[dict] | None = None, max_length: int = MAX_CONTEXT):
        self.items, self.max_length = list(items or []), max_length

    def context(self) -> str:
        ordered = sorted(self.items, key=lambda i: -i["importance_score"])
        return SEPARATOR.join(i["content"][:SUMMARY] + "..." if len(i["content"]) > SUMMARY else i["content"] for i in ordered)

    def add(self, content: str, section_name: str, importance: float, context_type: str, at: float = 0.0) -> dict:
        before = self.context()
        item = {"content": content, "section_name": section_name, "importance_score": importance, "context_type": context_type, "at": at, "usage_count": 0, "relevance_score": text_cosine(content, before) if before else 0.0}
        self.items.append(item)
        if sum(len(i["content"]) for i in self.items) > self.max_length:
            ranked = sorted(self.items, key=lambda i: -(i["importance_score"] * 0.4 + i["relevance_score"] * 0.4 + min(i["usage_count"] / 10, 0.2)))
            self.items, size = [], 0
            for i in ranked:
                size += len(i["content"])
                if size > self.max_length:
                    break
                self.items.append(i)
        return item

    def ask(self, query: str, at: float, k: int = 5) -> str:
        """The k best items for a query at a time in seconds, formatted; every item counts as used once more."""
        scored = []
        for i in self.items:
            fresh = max(0.1, 1 - (at - i["at"]) / 3600 / 24)
            scored.append((text_cosine(query, i["content"]) * 0.6 + i["importance_score"] * 0.3 + fresh * 0.1, i))
            i["usage_count"] += 1
        scored.sort(key=lambda x: -x[0])
        parts = (f"[{i['context_type'].upper()}{' (' + i['section_name'] + ')' if i['section_name'] else ''}]: {i['content'][:EXCERPT]}" for _, i in scored[:k])
        return SEPARATOR.join(parts)

    def size(self) -> int:
        return sum(len(i["content"]) for i in self.items)


#: What a store is told: an addition, or with ``kind`` "ask" a query, whose text is the content.
EVENTS = "key string, seq long, kind string, content string, section_name string, importance_score double, context_type string, at double"
#: What it answers: to an addition its relevance, to a query the context; then items, characters and uses in the store, and
#: how many items the section of the addition has had.
ANSWERS = "key string, seq long, kind string, relevance_score double, context string, n_items long, total_chars long, uses long, in_section long"


def event_rows(events: DataFrame) -> DataFrame:
    """``events`` with the columns of ``EVENTS``; those that may be left out: kind (add) and at (0)."""
    there = set(events.columns)
    kind = F.coalesce("kind", F.lit("add")) if "kind" in there else F.lit("add")
    at = F.coalesce(F.col("at").cast("double"), F.lit(0.0)) if "at" in there else F.lit(0.0)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return events.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), kind.alias("kind"), text("content"), text("section_name"), F.coalesce(F.col("importance_score").cast("double"), F.lit(0.0)).alias("importance_score"), text("context_type"), at.alias("at"))


def answer(store: ContextStore, count_section, r) -> tuple:
    """A store's answer to an event, without key and seq; ``count_section(name)`` counts an addition to a section."""
    if r.kind == "ask":
        relevance, text, n = None, store.ask(r.content, r.at), None
    else:
        relevance, text = store.add(r.content, r.section_name, r.importance_score, r.context_type, r.at)["relevance_score"], None
        n = count_section(r.section_name) if r.section_name else None
    return r.kind, relevance, text, len(store.items), store.size(), sum(i["usage_count"] for i in store.items), n


def run_store(events: DataFrame, max_length: int = MAX_CONTEXT) -> DataFrame:
    """Rows of ``ANSWERS``: each key's events, told to its store in the order of ``seq``.

    What an item is worth depends on all that was kept before it, so a key is a fold: its events come sorted, batch by batch,
    and only the store, bounded by the budget, and a number for each section are held.  Nulls count as empty, zero or add.
    """
    names = [c.split()[0] for c in ANSWERS.split(", ")]

    def fold(batches):
        key, store, sections = None, None, Counter()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if store is None or r.key != key:
                    key, store, sections = r.key, ContextStore(max_length=max_length), Counter()

                def count(name, sections=sections):
                    sections[name] += 1
                    return sections[name]

                rows.append((r.key, r.seq, *answer(store, count, r)))
            made = pd.DataFrame(rows, columns=names)
            yield made.assign(in_section=made["in_section"].astype("Int64"), relevance_score=made["relevance_score"].astype("float64"))

    return event_rows(events).repartition("key").sortWithinPartitions("key", "seq").mapInPandas(fold, ANSWERS)


ADDED = "key string, seq long, relevance_score double, n_items long, total_chars long"


def add_context(items: DataFrame, max_length: int = MAX_CONTEXT) -> DataFrame:
    """Each addition (key, seq, content, section_name, importance_score, context_type) with its relevance to what was there
    and the state after it (C12); see ``run_store``."""
    return run_store(items.drop("kind"), max_length).select("key", "seq", "relevance_score", "n_items", "total_chars")
