"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a seed lexicon and of a lexicon learned from the labelled sample, insults near a
second person, capitals, punctuation, obfuscated spellings, repeats, lengths.  The classifier is fitted on the driver from a
bounded sample of labelled rows (``max_rows``, the lowest hashes of the id); features and scores are computed where the
documents are.  Trees are fitted to the logistic loss on binned features; isotonic regression on a part of the sample that
the trees don't see turns their sum into a probability.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FOLDS, fold, fresh, lowest_hashes, table

#: Seed lexicon: common insults (English, German, French, Spanish).
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb trash garbage scum loser losers clown clowns worthless pathetic disgusting filth filthy vermin creep freak liar fool fools imbecile cretin"
    " idiota imbecil estupido basura asqueroso patetico payaso dummkopf trottel abschaum widerlich erbarmlich wertlos mull imbécile crétin ordure minable débile dégoûtant".split()
)
#: Second persons of the same languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú usted ustedes tus vosotros".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TOKEN = re.compile(r"\S+")
_NEAR = 5
FEATURES = (
    "seed_density", "seed_count", "learned_density", "learned_count", "learned_max", "learned_sum", "second_density", "near_second", "capital_words", "capital_letters",
    "exclaims", "questions", "punctuation", "obfuscated", "obfuscated_insults", "digits", "repeats", "distinct", "log_words", "word_length",
)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    """The features of one text; a null or empty text has all zero."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = set(words)
    known = kinds & INSULTS
    bad = kinds & learned.keys()
    seed = sum(words.count(w) for w in known) if known else 0
    hits = [learned[w] * words.count(w) for w in bad]
    second = kinds & SECOND
    near = 0
    if second and (known or bad):
        people = [i for i, w in enumerate(words) if w in second]
        for i, w in enumerate(words):
            if w in known or w in bad:
                at = np.searchsorted(people, i)
                near += any(abs(people[j] - i) <= _NEAR for j in (at - 1, at) if 0 <= j < len(people))
    tokens = _TOKEN.findall(text)
    odd = [t for t in set(tokens) if any(c in "013457@$!|*." for c in t[1:-1]) and any(c.isalpha() for c in t)]
    plain = [re.sub(r"[^\w]|_", "", t.lower().translate(LEET)) for t in odd]
    letters = sum(map(str.isalpha, text))
    marks = len(text) - letters - sum(map(str.isspace, text))
    return [
        seed / n, np.log1p(seed), sum(words.count(w) for w in bad) / n if bad else 0.0, np.log1p(len(bad)), max((learned[w] for w in bad), default=0.0), np.log1p(sum(hits)), sum(words.count(w) for w in second) / n if second else 0.0,
        float(np.log1p(near)), sum(t.isupper() and len(t) > 1 for t in tokens) / len(tokens), sum(map(str.isupper, text)) / max(letters, 1), text.count("!") / n, text.count("?") / n, marks / len(text),
        len(odd) / len(tokens), np.log1p(sum(w in INSULTS or w in learned for w in plain)), sum(map(str.isdigit, text)) / len(text), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(kinds) / n, np.log1p(n), len(text) / n,
    ]


@dataclass
class Trees:
    """Boosted trees in heap order; a node without a split has feature -1."""

    feature: np.ndarray = field(default=None)
    threshold: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)
    base: float = 0.0
    depth: int = 3

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                split = f[at]
                at = np.where(split < 0, at, 2 * at + 1 + (x[rows, np.maximum(split, 0)] > t[at]))
            total += v[at]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 0.002) -> Trees:
    """Newton boosting of the logistic loss with histograms of ``bins`` quantile bins; a leaf has the share ``least`` of rows, and 3."""
    n, width = x.shape
    least = max(3, int(least * n))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    size = 2 ** (depth + 1) - 1
    fs, ts, vs = [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        f, t, v = np.full(size, -1), np.zeros(size), np.zeros(size)
        own = {0: np.arange(n)}
        for node in range(size):
            rows = own.pop(node, None)
            if rows is None:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            v[node] = -rate * gs / (hs + ridge)
            if node >= 2**depth - 1 or len(rows) < 2 * least:
                continue
            best = (1e-6, None, None)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] is not None:
                j, k = best[1], best[2]
                f[node], t[node] = j, edges[j][k]
                left = binned[rows, j] <= k
                own[2 * node + 1], own[2 * node + 2] = rows[left], rows[~left]
        for rows, node in _leaves(binned, f, t, edges, depth):
            margin[rows] += v[node]
        fs.append(f), ts.append(t), vs.append(v)
    return Trees(np.array(fs).reshape(-1, size), np.array(ts).reshape(-1, size), np.array(vs).reshape(-1, size), base, depth)


def _leaves(binned: np.ndarray, f: np.ndarray, t: np.ndarray, edges: list[np.ndarray], depth: int):
    at = np.zeros(len(binned), dtype=np.int64)
    cut = np.array([np.searchsorted(edges[j], t[k]) if j >= 0 else 0 for k, j in enumerate(f)])
    rows = np.arange(len(binned))
    for _ in range(depth):
        at = np.where(f[at] < 0, at, 2 * at + 1 + (binned[rows, np.maximum(f[at], 0)] > cut[at]))
    for node in np.unique(at):
        yield np.nonzero(at == node)[0], node


def fit_isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Steps (margin, probability), both rising: pool adjacent violators; each block is pulled to the base rate by ``prior`` rows."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([label, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    rate = y.mean() if len(y) else 0.5
    ms = np.array([b[2] / b[1] for b in blocks])
    ps = np.maximum.accumulate([(b[0] + prior * rate) / (b[1] + prior) for b in blocks]) if blocks else np.array([])
    return ms, ps


@dataclass
class Model:
    learned: dict[str, float]
    trees: Trees
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t, self.learned) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        margin = self.trees.margin(x)
        return np.interp(margin, *self.steps) if len(self.steps[0]) else 1 / (1 + np.exp(-margin))


def word_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's words."""
    kinds = set(words_of(text))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(w) for w in kinds), dtype=np.uint64, count=len(kinds)))


def learn_lexicon(hashed: list[np.ndarray], y: np.ndarray, odds: float = 2.0, chance: float = 0.5) -> dict[int, float]:
    """Words that toxic documents have far more often than others: hash to log odds, from the ``word_hashes`` of documents.

    A word is taken if the bound on the probability that it stands in so many toxic documents by chance, times the number of
    words tried (those of a toxic document that stand in three documents or more), is at most ``chance``.
    """
    if not y.any():
        return {}
    words = np.unique(np.concatenate([h for h, label in zip(hashed, y, strict=True) if label]))
    p, total = np.zeros(len(words)), np.zeros(len(words))
    for own, label in zip(hashed, y, strict=True):
        at = np.searchsorted(words, own)
        at = at[(at < len(words)) & (words[np.minimum(at, max(len(words) - 1, 0))] == own)] if len(words) else at[:0]
        total[at] += 1
        p[at] += label
    q = total - p
    toxic, clean = max(y.sum(), 1), max((1 - y).sum(), 1)
    rate = toxic / (toxic + clean)
    tried = p + q >= 3
    words, p, q = words[tried], p[tried], q[tried]
    share = p / (p + q)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = -(p + q) * (share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0))
    weight = np.log((p + 0.5) / (toxic + 1)) - np.log((q + 0.5) / (clean + 1))
    found = (share > rate) & (bound + np.log(max(len(words), 1)) <= np.log(chance)) & (weight >= odds) & (p >= 3 * q)
    return dict(zip(words[found].tolist(), weight[found].tolist(), strict=True))


def _named(texts: list[str], hashed: list[np.ndarray], wanted: set[int]) -> dict[int, str]:
    """The words of these hashes."""
    names: dict[int, str] = {}
    ordered = np.array(sorted(wanted), dtype=np.uint64)
    for text, own in zip(texts, hashed, strict=True):
        if len(names) < len(wanted) and np.isin(ordered, own).any():
            names |= {h: w for w in set(words_of(text)) if (h := xxhash.xxh64_intdigest(w)) in wanted}
    return names


def fit(texts: list[str], labels: list[int], seed: int = 42) -> Model:
    """A model from texts with labels 0 and 1; with no rows or a single class, a constant one.

    Features of a row are taken with a lexicon learned from the other four folds, so that learned words don't look better to
    the trees than they are; the calibration sees margins of trees that were fitted without the row's fold.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        flat = float(y.mean()) if len(y) else 0.0
        return Model({}, Trees(np.full((0, 15), -1), np.zeros((0, 15)), np.zeros((0, 15))), (np.array([0.0]), np.array([flat])))
    part = np.random.default_rng(seed).permutation(len(y)) % 5
    hashed = [word_hashes(t) for t in texts]
    found = [learn_lexicon([h for h, k in zip(hashed, part, strict=True) if k != fold_], y[part != fold_]) for fold_ in range(5)]
    whole = learn_lexicon(hashed, y)
    names = _named(texts, hashed, set().union(whole, *found))
    spelled = lambda lexicon: {names[h]: w for h, w in lexicon.items()}
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(5):
        learned = spelled(found[k])
        for i in np.nonzero(part == k)[0]:
            x[i] = features(texts[i], learned)
    margin = np.zeros(len(y))
    for k in range(5):
        margin[part == k] = fit_trees(x[part != k], y[part != k]).margin(x[part == k])
    return Model(spelled(whole), fit_trees(x, y), fit_isotonic(margin, y))


def sample_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (_id, t, y) of at most ``max_rows`` labelled rows outside fold 0: the lowest hashes of the id, from all rows.

    The ids are chosen first (a bounded top-k), then their texts are fetched.  Ids with contradicting labels are left out,
    repeated rows of an id count once, null ids, labels and texts not at all.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    marked = marked.where(fold("_id") != 0)
    present = docs.select(F.col(id_col).alias("_id")).join(marked, "_id", "left_semi").distinct()
    chosen = lowest_hashes(marked.join(present, "_id", "left_semi"), "_id", max_rows)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).select("_id", "t", F.col("y").cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, **how) -> tuple[list[str], list[int]]:
    """Texts and labels of ``sample_rows``, in the order of the ids' hashes, to look at or to fit by hand."""
    got = sample_rows(docs, labels, **how).orderBy(F.xxhash64("_id"), "_id").select("t", "y").toArrow()
    return got["t"].to_pylist(), got["y"].to_pylist()


def learn(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """The model that ``fit`` makes of ``sample_rows``.

    It is fitted in one task, on at most ``max_rows`` rows; the driver gets the model, not the texts.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, y = [], []
        for batch in batches:
            texts += batch["t"].tolist()
            y += batch["y"].tolist()
        yield pd.DataFrame({"model": [pickle.dumps(fit(texts, y))]})

    rows = sample_rows(docs, labels, **how).repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id").select("t", "y")
    got = rows.mapInPandas(work, "model binary").first()
    return pickle.loads(got["model"]) if got else fit([], [])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability of being toxic; null and empty texts are scored like a text without words.

    A column of the name ``score_col`` is replaced, others stay.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.score(texts), dtype="float64")

    return docs.withColumn(score_col, score(F.col(text_col)))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 0 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; the model is learned from the labelled ones outside fold 0.

    Columns stay as they are, whatever their names; repeated rows stay or go together; without labels no row scores above 0.
    """
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    name = fresh("_toxic", docs)
    return with_score(docs, model, text_col, name).where(F.col(name) < threshold).select(*docs.columns)


__all__ = ["FOLDS", "Model", "features", "fit", "labelled_sample", "learn", "op10_toxicity", "remove_toxic", "with_score"]
