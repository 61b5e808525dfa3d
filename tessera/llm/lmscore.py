"""Language-model scores from a probabilistic suffix tree over bytes, beside a word unigram base score.

A text is its words (A-Z lower-cased, UTF-8 bytes) joined by single spaces, then one end mark.  The tree's states are
contexts of up to ``DEPTH`` bytes.  A context is a state if the distribution of the next byte after it diverges enough from
what the tree predicts by the context's suffixes: its count times the Kullback-Leibler divergence is at least ``gain``.  The
next-byte distribution of a state is its counts, smoothed towards that of its longest suffix that is a state (Witten-Bell).
A byte is predicted by the state of the longest suffix of what precedes it.

The number of states is what the test leaves, at every size of the corpus.  The tree is never put together in one place: for
each length it is two tables, that of the strings context + byte with their log10 probability and that of the states' back-off
weights, made level by level with a join and a window over a context's at most 257 next bytes.  The strings and words that
occur most often are sent to the tasks as sorted arrays (``quick`` and ``max_words``: bounds on what is sent, not on what
counts); all others are scored by joins, so results don't depend on these bounds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, fold, table

DEPTH = 5
#: Marks the end of a text and fills what precedes its start; no UTF-8 text has this byte.
END = 0xFF
#: Bytes of text that are counted or scored at a time.
STEP = 1 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def symbols_of(words: list[bytes]) -> np.ndarray:
    """DEPTH end marks, the words joined by spaces, an end mark."""
    mark = bytes([END])
    return np.frombuffer(mark * DEPTH + b" ".join(words) + mark, dtype=np.uint8)


def codes_of(symbols: np.ndarray) -> np.ndarray:
    """For each place from DEPTH on, its byte in the low 8 bits and those before it above them, DEPTH + 1 bytes in all."""
    n = len(symbols) - DEPTH
    total = np.zeros(n, dtype=np.int64)
    for k in range(DEPTH + 1):
        total = (total << 8) | symbols[k : k + n]
    return total


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


COUNTS = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def count_training(batches):
    """Counts of (DEPTH + 1)-byte strings (kind 0) and of words (kind 1; the empty word is the end), summed over a task."""
    words, codes, held = Counter(), [], 0
    keys, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def merged():
        nonlocal keys, times, codes, held
        own, n = np.unique(np.concatenate(codes), return_counts=True)
        both, at = np.unique(np.concatenate((keys, own)), return_inverse=True)
        keys, times = both, np.bincount(at, weights=np.concatenate((times, n)), minlength=len(both)).astype(np.int64)
        codes, held = [], 0

    def strings():
        nonlocal keys, times
        for at in range(0, len(keys), 1 << 16):
            part = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), dtype=np.int32)), pa.array(part), pa.array([b""] * len(part), pa.binary()), pa.array(times[at : at + (1 << 16)])], schema=COUNTS)
        keys, times = keys[:0], times[:0]

    def all_words():
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(words), dtype=np.int32)), pa.array(np.zeros(len(words), dtype=np.int64)), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], schema=COUNTS)
        words.clear()

    for batch in batches:
        for text in _bytes(batch.column(0)):
            own = words_of(text)
            words.update(own)
            words[b""] += 1
            codes.append(codes_of(symbols_of(own)))
            held += len(codes[-1])
            if held > 2 * STEP:
                merged()
            if len(words) > 200_000:
                yield from all_words()
            if len(keys) > 4 * STEP:
                yield from strings()
    if codes:
        merged()
    yield from strings()
    if words:
        yield from all_words()


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Quick:
    """Codes with their log10, looked up in one step where their slot is their own, by a search where it isn't."""

    SHIFT = 43  # 2**21 slots
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        """``codes`` by descending frequency: the first of a slot gets it."""
        slots = self.slots(codes)
        own = np.zeros(len(codes), dtype=bool)
        own[np.unique(slots, return_index=True)[1]] = True
        self.keys = np.full(1 << (64 - self.SHIFT), -1, dtype=np.int64)
        self.logs = np.zeros(len(self.keys))
        self.keys[slots[own]], self.logs[slots[own]] = codes[own], logs[own]
        by = np.argsort(codes[~own])
        self.more, self.more_logs = codes[~own][by], logs[~own][by]

    def slots(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * self.MIX) >> np.uint64(self.SHIFT)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each code, 0 where it isn't known; whether it is known."""
        slots = self.slots(codes)
        known = self.keys[slots] == codes
        logs = np.where(known, self.logs[slots], 0.0)
        rest = np.flatnonzero(~known)
        if len(rest):
            at, hit = find(self.more, codes[rest])
            logs[rest[hit]] = self.more_logs[at[hit]]
            known[rest[hit]] = True
        return logs, known


def least_of_top(df: DataFrame, column: str, most: int) -> float | int | None:
    """The least value such that at most ``most`` rows reach it, at the bounds of a histogram on a log scale; None: no row."""
    bins = df.groupBy(F.floor(F.log2(column) * 8).alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("least")).orderBy(F.desc("b")).collect()
    least, taken = None, 0
    for b in bins:
        if taken + b["rows"] > most:
            break
        least, taken = b["least"], taken + b["rows"]
    return least


def _last(column: str, size: int):
    """The last ``size`` bytes of a code."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1))


@dataclass
class Tree:
    """By context length k: ``strings[k]`` (code, log): context and next byte, seen in training, with the log10 probability
    that the longest state of the context gives the byte; ``states[k]`` (ctx, weight): log10 of the back-off weight."""

    strings: list[DataFrame]
    states: list[DataFrame]

    def log10(self, codes: DataFrame) -> DataFrame:
        """Rows (code, log) for ``codes`` (code: DEPTH + 1 bytes, distinct), whether they were seen in training or not."""
        rows = codes.select("code")
        for k in range(DEPTH, -1, -1):
            strings = self.strings[k].select(F.col("code").alias("_c"), F.col("log").alias(f"log{k}"))
            states = self.states[k].select(F.col("ctx").alias("_s"), F.col("weight").alias(f"weight{k}"))
            rows = rows.join(strings, _last("code", k + 1) == F.col("_c"), "left").drop("_c")
            rows = rows.join(states, F.shiftright(_last("code", k + 1), 8) == F.col("_s"), "left").drop("_s")
        log = F.lit(-float(np.log10(256.0)))
        for k in range(DEPTH + 1):
            log = F.coalesce(F.col(f"log{k}"), F.coalesce(f"weight{k}", F.lit(0.0)) + log)
        return rows.select("code", log.alias("log"))


def build_tree(grams: DataFrame, gain: float = 60.0) -> Tree:
    """The tree from counts (code, n) of DEPTH + 1 bytes.  No counts give a tree that takes all bytes for equally likely."""
    counts = [grams.select("code", "n")]
    for k in range(DEPTH, 0, -1):
        counts.append(cut(counts[-1].groupBy(_last("code", k).alias("code")).agg(F.sum("n").alias("n"))))
    counts.reverse()
    strings, states = [], []
    by_context = Window.partitionBy("ctx")
    for k in range(DEPTH + 1):
        if k:
            lower = strings[-1].select(F.col("code").alias("suffix"), F.pow(F.lit(10.0), "log").alias("lower"))
            own = counts[k].join(lower, _last("code", k) == F.col("suffix"))
        else:
            own = counts[0].withColumn("lower", F.lit(1 / 256))
        own = own.withColumn("ctx", F.shiftright("code", 8))
        own = own.withColumn("total", F.sum("n").over(by_context)).withColumn("kinds", F.count(F.lit(1)).over(by_context))
        own = own.withColumn("gain", F.sum(F.col("n") * F.log2(F.col("n") / F.col("total") / F.col("lower"))).over(by_context))
        state = (F.col("gain") >= gain) if k else F.lit(True)
        smooth = F.when(state, (F.col("n") + F.col("kinds") * F.col("lower")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("lower"))
        weight = F.when(state, F.log10(F.col("kinds") / (F.col("total") + F.col("kinds"))))
        made = cut(own.select("code", "n", F.log10(smooth).alias("log"), "ctx", weight.alias("weight")))
        strings.append(made.select("code", "n", "log"))
        states.append(cut(made.where("weight is not null").groupBy("ctx").agg(F.first("weight").alias("weight"))))
    return Tree(strings, states)


@dataclass
class Model:
    tree: Tree
    often: tuple[np.ndarray, np.ndarray]  # the most frequent codes, by descending frequency, with their log10
    frequent: dict[bytes, int]
    words: DataFrame  # the others: word, n
    tokens: int
    kinds: int


def train(rows: DataFrame, gain: float = 60.0, max_words: int = 100_000, quick: int = 500_000) -> Model:
    """A model from all rows (text).  Null texts count as empty ones: an end mark each."""
    counted = cut(rows.select("text").mapInArrow(count_training, "kind int, code long, word binary, n long").groupBy("kind", "code", "word").agg(F.sum("n").alias("n")))
    words = counted.where("kind = 1").select("word", "n")
    size = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = least_of_top(words, "n", max_words)
    rare = words.where(F.col("n") < least) if least is not None else words
    frequent = {}
    if least is not None:
        often = words.where(F.col("n") >= least).toArrow()
        frequent = dict(zip(often["word"].to_pylist(), often["n"].to_pylist(), strict=True))
    tree = build_tree(counted.where("kind = 0").select("code", "n"), gain)
    least = least_of_top(tree.strings[DEPTH], "n", quick)
    codes, logs = np.zeros(0, dtype=np.int64), np.zeros(0)
    if least is not None:
        top = tree.strings[DEPTH].where(F.col("n") >= least).toArrow()
        by = np.lexsort((top["code"].to_numpy(), -top["n"].to_numpy()))
        codes, logs = top["code"].to_numpy()[by], top["log"].to_numpy()[by]
    return Model(tree, (codes, logs), frequent, rare, int(size["n"] or 0), int(size["v"] or 0))


SCORED = pa.schema(
    [("id", pa.int64()), ("uid", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_c", pa.float64()), ("score", pa.float64())]
    + [("words", pa.list_(pa.binary())), ("word_n", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64())), ("code_n", pa.list_(pa.int64()))]
)


def _lists(owners: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """One list for each of ``rows``, of the values whose ascending owner it is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(rows + 1)).astype(np.int32)), values)


def _scored(ids: list, texts: list[bytes | None], uid: int, quick: Quick, logs: dict[bytes, float], frequent: dict[bytes, int]) -> pa.RecordBatch:
    n = len(ids)
    totals, known, log_c = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n)
    tokens = np.zeros(n, dtype=np.int64)
    codes, sizes = [], []
    rare, rare_n, rare_of = [], [], []
    for k, text in enumerate(texts):
        own = words_of(text)
        codes.append(codes_of(symbols_of(own)))
        sizes.append(len(codes[-1]))
        own.append(b"")
        tokens[k] = len(own)
        for w, times in Counter(own).items():
            if (x := logs.get(w)) is None:
                rare.append(w), rare_n.append(times), rare_of.append(k)
            else:
                known[k] += times
                log_c[k] += times * x
    every, owner = np.concatenate(codes), np.repeat(np.arange(n), sizes)
    missed = []
    for at in range(0, len(every), STEP):
        part, of = every[at : at + STEP], owner[at : at + STEP]
        found, hit = quick.find(part)
        totals += np.bincount(of, weights=found, minlength=n)
        part, of = part[~hit], of[~hit]
        by = np.lexsort((part, of))
        part, of = part[by], of[by]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), dtype=bool), (part[1:] != part[:-1]) | (of[1:] != of[:-1]))))
        missed.append((of[first], part[first], np.diff(np.concatenate((first, [len(part)])))))
    of, part, times = (np.concatenate(x) for x in zip(*missed, strict=True))
    rare_of = np.array(rare_of, dtype=np.int64)
    arrays = [pa.array(ids, pa.int64()), pa.array(np.arange(uid, uid + n)), pa.array(tokens), pa.array(known), pa.array(log_c), pa.array(totals)]
    arrays += [_lists(rare_of, n, pa.array(rare, pa.binary())), _lists(rare_of, n, pa.array(rare_n, pa.int64())), _lists(of, n, pa.array(part)), _lists(of, n, pa.array(times.astype(np.int64)))]
    return pa.RecordBatch.from_arrays(arrays, schema=SCORED)


def score_texts(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (id, uid, n_tokens, n_known, log_c, score, words, word_n, codes, code_n), computed once: log_c and n_known of the
    words that are sent only, score of the codes that are sent only; the others stand in lists with their counts in the text."""
    shipped = rows.sparkSession.sparkContext.broadcast((model.often, model.frequent))

    def score(batches):
        often, frequent = shipped.value
        quick = Quick(*often)
        logs = {w: float(np.log10(n + 0.5)) for w, n in frequent.items()}
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _bytes(batch.column(1))
            start = held = 0
            for k, text in enumerate(texts):
                held += len(text or b"") + 1
                if held > STEP or k == len(texts) - 1:
                    yield _scored(ids[start : k + 1], texts[start : k + 1], uid, quick, logs, frequent)
                    uid += k + 1 - start
                    start, held = k + 1, 0

    shape = "id long, uid long, n_tokens long, n_known long, log_c double, score double, words array<binary>, word_n array<long>, codes array<long>, code_n array<long>"
    return cut(rows.mapInArrow(score, shape))


def lm_scores(docs: DataFrame, train_rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    A null text counts as empty (one token, the end).  Without training rows every c, N and V is 0 and the tree is uniform.
    Repeated rows are scored each; other columns are left aside; an empty table gives no rows.
    """
    model = train(train_rows.select(F.col(text_col).alias("text")), **how)
    scored = score_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), model)
    words = scored.select("uid", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("word_n").alias("times"))).alias("x")).select("uid", "x.word", "x.times")
    codes = scored.select("uid", F.explode(F.arrays_zip(F.col("codes").alias("code"), F.col("code_n").alias("times"))).alias("x")).select("uid", "x.code", "x.times")
    seen = model.tree.strings[DEPTH].select("code", "log")
    unseen = cut(codes.select("code").distinct().join(seen, "code", "left_anti"))
    logs = seen.unionByName(cut(model.tree.log10(unseen)))
    c = F.coalesce("n", F.lit(0))
    more = words.join(model.words, "word", "left").select("uid", (F.col("times") * F.log10(c + 0.5)).alias("log_c"), F.when(c > 0, F.col("times")).otherwise(0).alias("known"), F.lit(0.0).alias("score"))
    more = more.unionByName(codes.join(logs, "code").select("uid", F.lit(0.0).alias("log_c"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.col("log")).alias("score")))
    more = more.groupBy("uid").agg(*[F.sum(x).alias(f"more_{x}") for x in ("log_c", "known", "score")])
    rows = scored.select("id", "uid", "n_tokens", "n_known", "log_c", "score").join(more, "uid", "left")
    base = F.col("log_c") + F.coalesce("more_log_c", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(model.tokens + 0.5 * (model.kinds + 1)))
    known = (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long")
    return rows.select("id", "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def op6_lmscore(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; fold 1 is held out, all others are learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id") == 1, F.lit(True))
    scored = lm_scores(docs, docs.where(~held_out))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold("id") == 1, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
