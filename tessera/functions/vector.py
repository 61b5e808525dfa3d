"""Similarity of vectors and of texts.

Dense vectors are arrays; texts are compared by the cosine of their term counts, within the row or, where sections meet many
chunks, by a join on the terms, unless an embedder is given (``functions.effects``).  Cosines lie between -1 and 1; that of a zero vector is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a column expression that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is all zero (V1)."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def preserved(similarity: Column, threshold: float | None = 0.75, literal: bool = False) -> Column:
    """struct(is_valid, similarity) (V2).  A threshold of None is 0.75; with ``literal`` so is 0."""
    if threshold is None or literal and not threshold:
        threshold = 0.75
    return F.struct((similarity >= threshold).alias("is_valid"), similarity.alias("similarity"))


def relevance(similarity: Column) -> Column:
    """Similarity, 0 where it can't be had (V4)."""
    return F.coalesce(similarity, F.lit(0.0))


def boosted(score: Column, times: Column, boost: float = 0.5) -> Column:
    """Score raised for each edge, at most 1 (V6)."""
    return F.when(F.coalesce(times, F.lit(0)) > 0, F.least(F.lit(1.0), score + boost * times)).otherwise(score)


def recency(now: Column, then: Column) -> Column:
    """1 for now, falling to 0.1 over a day (V7)."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(3.6e9)
    return F.greatest(F.lit(0.1), 1 - hours / 24)


def combined_score(relevance_: Column, importance: Column, recency_: Column) -> Column:
    """Rank of a context item for a query (V8)."""
    return relevance_ * 0.6 + importance * 0.3 + recency_ * 0.1


def retention_score(importance: Column, relevance_: Column, usage: Column) -> Column:
    """Rank of a context item when the store is pruned (V9)."""
    return importance * 0.4 + relevance_ * 0.4 + F.least(usage / 10, F.lit(0.2))


# --- texts ------------------------------------------------------------------------------------------------------------
TERM_GAPS = r"[^\p{L}\p{N}]+"


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, term, tf) of lower-cased runs of letters and digits."""
    terms = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TERM_GAPS), lambda t: t != "")
    return df.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def text_norms(counts: DataFrame) -> DataFrame:
    return counts.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def _counts(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its distinct words, as row * size + word in ascending order, and how often it has them."""
    return np.unique(rows * size + words, return_counts=True)


def batch_cosines(xs: pa.Array, ys: pa.Array) -> np.ndarray:
    """Cosines of the term counts of two columns of texts, row by row.

    Arrow lower-cases, splits and numbers the terms of the whole batch; rows are then counted by sorting numbers.
    """
    split = [pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), TERM_GAPS) for texts in (xs, ys)]
    terms = pa.concat_arrays([s.flatten() for s in split]).dictionary_encode()
    codes, names = terms.indices.to_numpy().astype(np.int64), terms.dictionary
    size, gap = max(len(names), 1), names.index("").as_py()
    counted, at = [], 0
    for s in split:
        rows = pc.list_parent_indices(s).to_numpy().astype(np.int64)
        own = codes[at : at + len(rows)]
        at += len(rows)
        counted.append(_counts(own[own != gap], rows[own != gap], size))
    (ka, na), (kb, nb) = counted
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    dots = np.bincount(ka[i] // size, weights=na[i] * nb[j], minlength=len(xs))
    norms = [np.sqrt(np.bincount(k // size, weights=n * n, minlength=len(xs))) for k, n in counted]
    both = norms[0] * norms[1]
    return np.divide(dots, both, out=np.zeros(len(xs)), where=both > 0)


#: Characters of two columns that are compared at a time.
CHARS = 8_000_000


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term counts of two texts of a row, 0 where either has none.

    Within the row, so that no terms are shuffled; batch by batch, in pieces of a bounded number of characters.
    """

    @F.arrow_udf("double")
    def cosines(xs: pa.Array, ys: pa.Array) -> pa.Array:
        xs, ys = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (xs, ys))
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (xs, ys)))
        out, at = [], 0
        while at < len(xs):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS)))
            out.append(batch_cosines(xs.slice(at, stop - at), ys.slice(at, stop - at)))
            at = stop
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return cosines(a, b)


def pair_similarity(pairs: DataFrame, a_text: str, b_text: str) -> DataFrame:
    """``pairs`` with ``similarity`` of two of its texts."""
    return pairs.withColumn("similarity", term_cosine(F.col(a_text), F.col(b_text)))


def text_coherence(pairs: DataFrame, a_text: str, b_text: str) -> DataFrame:
    """``pairs`` with ``coherence``: 0 if a text is blank, 1 if they are equal when stripped, else their similarity (V5)."""
    from tessera.functions.text import strip

    a, b = strip(F.coalesce(F.col(a_text), F.lit(""))), strip(F.coalesce(F.col(b_text), F.lit("")))
    scored = pair_similarity(pairs, a_text, b_text)
    return scored.withColumn("coherence", F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.col("similarity"))).drop("similarity")


def mean_pairwise_cosine(df: DataFrame, group: list[str], vector: str, dims: int) -> DataFrame:
    """Mean cosine of all pairs of a group (A6): 1 for fewer than two rows.

    With unit vectors the sum over pairs is (|sum|^2 - n) / 2, so one aggregation does it, without any pair.  A zero vector
    counts as cosine 0 with every other.
    """
    size = norm(F.col(vector))
    unit = df.withColumn("_n", size)
    sums = [F.sum(F.when(F.col("_n") > 0, F.col(vector)[k] / F.col("_n")).otherwise(0.0)) for k in range(dims)]
    agg = unit.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_n") > 0, 1).otherwise(0)).alias("_units"), F.array(*sums).alias("_s"))
    return agg.select(*group, "n", F.when(F.col("n") < 2, 1.0).otherwise((dot(F.col("_s"), F.col("_s")) - F.col("_units")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))
