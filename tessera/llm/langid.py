"""Language identification by interpolated Kneser-Ney character models.

A text is reduced to its letters, lower-cased, runs of anything else being one space.  For each language a character model
of order ``ORDER`` is estimated from a bounded, documented sample of labelled texts (``max_docs`` a language, the lowest
hashes of the id): counts at the highest order, continuation counts below it, one absolute discount an order.  N-grams are
kept as sorted arrays of 64-bit hashes with one log probability a language beside them, so a text is scored by binary
searches.  The language of the lowest cross-entropy a character is chosen; the difference to the second, scaled by length,
is turned into a probability by a logistic curve fitted on labelled texts that the counts don't see, and texts whose
cross-entropy is above what nearly all of those have, or whose probability is low, are marked as rejected.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fold, lowest_hashes, table

ORDER = 4
UND = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower-case code point if it is a letter, else a space."""
    if not _letters:
        found = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            if (x := chr(c)).isalpha():
                low = x.lower()
                found[c] = ord(low) if len(low) == 1 else c
        _letters.append(found)
    return _letters[0]


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the reduced text, with one space at each end; empty if the text has no letter."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    gap = codes == 32
    if gap.all():
        return np.zeros(0, dtype=np.uint32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    gap = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return codes[keep]


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` codes that end at each place; before the first there are zeros."""
    padded = np.concatenate((np.zeros(order - 1, dtype=np.uint64), codes.astype(np.uint64)))
    n = len(codes)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            total = (total + padded[k : k + n] + np.uint64(1)) * _MIX
            total ^= total >> np.uint64(29)
    return total


def count_grams(texts) -> pd.DataFrame:
    """Counts of n-grams of the highest order: their codes as a string, and how often they occur."""
    chunks = []
    for text in texts:
        codes = letters_of(text)
        if len(codes):
            padded = np.concatenate((np.zeros(ORDER - 1, dtype=np.uint32), codes))
            chunks.append(np.lib.stride_tricks.sliding_window_view(padded, ORDER))
    if not chunks:
        return pd.DataFrame({"gram": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64")})
    packed = np.ascontiguousarray(np.concatenate(chunks)).view(f"V{4 * ORDER}").ravel()
    grams, n = np.unique(packed, return_counts=True)
    return pd.DataFrame({"gram": [g.tobytes() for g in grams], "n": n.astype(np.int64)})


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by order from 1: sorted hashes
    logs: list[np.ndarray]  # by order: log probability of each n-gram, a column for each language
    contexts: list[np.ndarray]  # by order: sorted hashes of contexts
    backoff: list[np.ndarray]  # by order: log of the weight of the lower order
    unseen: float
    slope: float = 1.0
    shift: float = 0.0
    limits: np.ndarray | None = None

    def logs_of(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character of a reduced text, a column for each language; each distinct n-gram is looked up once."""
        full = gram_hashes(codes, ORDER)
        order_of = np.argsort(full)
        ordered = full[order_of]
        first = np.ones(len(codes), dtype=bool)
        first[1:] = ordered[1:] != ordered[:-1]
        places = order_of[first]
        logs = np.zeros((len(places), len(self.languages)), dtype=np.float64)
        todo = np.arange(len(places))
        for order in range(ORDER, 0, -1):
            keys = gram_hashes(codes, order)[places[todo]]
            at, hit = find(self.grams[order - 1], keys)
            logs[todo[hit]] += self.logs[order - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if order > 1:
                # the context of a missing n-gram ends one place before it
                before = np.concatenate((np.zeros(1, dtype=np.uint64), gram_hashes(codes, order - 1)[:-1]))
                before[0] = gram_hashes(np.zeros(order - 1, dtype=np.uint32), order - 1)[-1]
                at, hit = find(self.contexts[order - 1], before[places[todo]])
                logs[todo[hit]] += self.backoff[order - 1][at[hit]]
        else:
            logs[todo] += self.unseen
        out = np.empty((len(codes), len(self.languages)))
        out[order_of] = logs[np.cumsum(first) - 1]
        return out

    def entropies(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text under each language, and its number of characters (0: no letter)."""
        parts = [letters_of(t) for t in texts]
        sizes = np.array([max(len(p) - 1, 0) for p in parts])  # the first space is given
        out = np.zeros((len(parts), len(self.languages)))
        group: list[int] = []

        def flush():
            pad = np.zeros(ORDER - 1, dtype=np.uint32)
            logs = self.logs_of(np.concatenate([x for i in group for x in (pad, parts[i])]))
            at = 0
            for i in group:
                at += ORDER - 1
                out[i] = -logs[at + 1 : at + len(parts[i])].sum(axis=0) / sizes[i]
                at += len(parts[i])
            group.clear()

        for i, p in enumerate(parts):
            if sizes[i]:
                group.append(i)
                if sum(len(parts[j]) for j in group[-64:]) > 200_000 or len(group) >= 64:
                    flush()
        if group:
            flush()
        return out, sizes

    def predict(self, texts) -> pd.DataFrame:
        """lang, score (0 to 1), rejected for each text."""
        if not self.languages:
            n = len(texts)
            return pd.DataFrame({"lang": [UND] * n, "score": [0.0] * n, "rejected": [True] * n})
        entropy, sizes = self.entropies(texts)
        best = entropy.argmin(axis=1)
        rows = np.arange(len(best))
        low = entropy[rows, best]
        others = entropy.copy()
        others[rows, best] = np.inf
        margin = (others.min(axis=1) - low) if len(self.languages) > 1 else np.full(len(best), 10.0)
        score = 1 / (1 + np.exp(-np.clip(self.slope * margin * np.sqrt(np.maximum(sizes, 1)) + self.shift, -50, 50)))
        none = sizes == 0
        rejected = none | (score < 0.5)
        if self.limits is not None:
            rejected |= low > self.limits[best]
        return pd.DataFrame({"lang": np.where(none, UND, np.array(self.languages, dtype=object)[best]), "score": np.where(none, 0.0, score), "rejected": rejected})


def find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    if not len(table_):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return at, table_[at] == keys


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.75


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from (n-grams as a matrix of codes, counts) of each language."""
    languages = sorted(counts)
    alphabet = {int(c) for grams, _ in counts.values() for c in np.unique(grams[:, -1])} | {32}
    uniform = 1.0 / (len(alphabet) + 1)
    levels = {}  # (language, order) -> grams, counts: the highest as counted, lower ones by how many letters precede them
    for lang in languages:
        grams, n = counts[lang]
        levels[lang, ORDER] = grams, n.astype(np.float64)
        for order in range(ORDER - 1, 0, -1):
            grams, n = np.unique(levels[lang, order + 1][0][:, 1:], axis=0, return_counts=True)
            levels[lang, order] = grams, n.astype(np.float64)
    model = Model(languages, [], [], [], [], float(np.log(uniform)))
    for order in range(1, ORDER + 1):
        everything = np.unique(np.concatenate([levels[lang, order][0] for lang in languages]), axis=0)
        hashes = rows_hash(everything)
        by_hash = np.argsort(hashes)
        everything, hashes = everything[by_hash], hashes[by_hash]
        context_rows = np.unique(everything[:, :-1], axis=0) if order > 1 else np.zeros((1, 0), dtype=np.uint32)
        context_hashes = rows_hash(context_rows)
        by_hash = np.argsort(context_hashes)
        context_rows, context_hashes = context_rows[by_hash], context_hashes[by_hash]
        of_context = find(context_hashes, rows_hash(everything[:, :-1]))[0]
        if order > 1:
            lower = lower_logs(model, everything[:, 1:], order - 1)
        logs, backoff = np.zeros((len(everything), len(languages))), np.zeros((len(context_rows), len(languages)))
        for k, lang in enumerate(languages):
            grams, n = levels[lang, order]
            d = _discount(n)
            at = find(hashes, rows_hash(grams))[0]
            own = np.zeros(len(everything))
            own[at] = n
            total = np.bincount(of_context, weights=own, minlength=len(context_rows))
            kinds = np.bincount(of_context, weights=own > 0, minlength=len(context_rows))
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            below = np.exp(lower[:, k]) if order > 1 else np.full(len(everything), uniform)
            share = np.where(total[of_context] > 0, np.maximum(own - d, 0) / np.maximum(total[of_context], 1), 0.0)
            logs[:, k] = np.log(share + weight[of_context] * below)
            backoff[:, k] = np.log(np.maximum(weight, 1e-12))
        if order == 1:
            model.unseen = 0.0
            unseen = backoff[0] + np.log(uniform)
        model.grams.append(hashes), model.logs.append(logs.astype(np.float64)), model.contexts.append(context_hashes), model.backoff.append(backoff)
    model.unseen = unseen
    return model


def rows_hash(rows: np.ndarray) -> np.ndarray:
    """The hashes of n-grams given as rows of codes, as ``gram_hashes`` has them."""
    total = np.zeros(len(rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            total = (total + rows[:, k].astype(np.uint64) + np.uint64(1)) * _MIX
            total ^= total >> np.uint64(29)
    return total


def lower_logs(model: Model, rows: np.ndarray, order: int) -> np.ndarray:
    """Log probabilities of n-grams of a lower order, all of which the model has."""
    at, hit = find(model.grams[order - 1], rows_hash(rows))
    assert hit.all()
    return model.logs[order - 1][at]


def calibrate(model: Model, texts: list[str], langs: list[str], steps: int = 400) -> None:
    """Fits slope and shift on labelled texts, and the limit of cross-entropy that 99.5 % of a language's texts keep."""
    known = [k for k, lang in enumerate(langs) if lang in set(model.languages)]
    if not known or len(model.languages) < 2:
        model.slope, model.shift = 1.0, 0.0
        return
    entropy, sizes = model.entropies([texts[k] for k in known])
    true = np.array([model.languages.index(langs[k]) for k in known])
    use = sizes > 0
    entropy, sizes, true = entropy[use], sizes[use], true[use]
    if not len(true):
        return
    best = entropy.argmin(axis=1)
    ordered = np.sort(entropy, axis=1)
    x = (ordered[:, 1] - ordered[:, 0]) * np.sqrt(sizes)
    y = (best == true).astype(float)
    scale = max(float(np.median(x)), 1e-6)
    a, b = 1.0, 0.0
    for _ in range(steps):  # gradient steps; a slight pull to the start keeps them bounded if all are right
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -50, 50)))
        a -= 0.5 * (((p - y) * x / scale).mean() + 1e-3 * (a - 1))
        b -= 0.5 * ((p - y).mean() + 1e-3 * b)
    model.slope, model.shift = max(a, 0.0) / scale, b
    own = entropy[np.arange(len(true)), true]
    model.limits = np.array([np.quantile(own[true == k], 0.995) * 1.1 if (true == k).any() else np.inf for k in range(len(model.languages))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500) -> Model:
    """A model from at most ``max_docs`` texts a language outside fold 0, the lowest hashes of the id.

    Rows with a null id, text or language teach nothing.  Fold 1 of the sample is kept for calibration.  With no labelled
    row the model has no language and everything is ``und``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null").where(fold("id") != 0)
    chosen = lowest_hashes(rows.select("id", "lang").distinct(), "id", max_docs, "lang")
    sample = cut(rows.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "text", (fold("id") == 1).alias("calibrate")).repartition(8))

    def count(batches):
        for batch in batches:
            for lang, texts in batch[~batch["calibrate"]].groupby("lang")["text"]:
                yield count_grams(texts).assign(lang=lang)

    counted = sample.mapInPandas(count, "gram binary, n long, lang string").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    for lang in set(counted["lang"].to_pylist()):
        part = counted.filter(pc.equal(counted["lang"], lang))
        grams = np.frombuffer(b"".join(part["gram"].to_pylist()), dtype=np.uint32).reshape(-1, ORDER)
        counts[lang] = grams, part["n"].to_numpy()
    if not counts:
        return Model([], [], [], [], [], 0.0)
    model = estimate(counts)
    check = sample.where("calibrate").select("text", "lang").toArrow()
    calibrate(model, check["text"].to_pylist(), check["lang"].to_pylist())
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``language``: struct of lang, score and rejected.  A text without a letter is ``und``, 0, true.

    A column of that name is replaced, others stay; repeated rows have one result; ties go to the first language.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shipped.value.predict(texts.tolist())

    return docs.withColumn("language", predict(F.col(text_col)))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document; fold 0 is held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))
