"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` holds, for one text, the hashes of all its prefixes modulo two primes.  The hash of any span follows from
two of them, so spans of any texts are compared in constant time, and the longest common extension of two places is found by
binary search.  A fingerprint keeps of a text: its length, the hash of the whole, a ladder of hashes of prefixes and of
suffixes at lengths that grow by a quarter, and the least hashes of its spans of ``SPAN`` code points in ``SLOTS`` slots.
Two fingerprints are compared by binary search on the ladders (common start and end) and by their equal slots (common spans
anywhere); the larger of the two shares is their likeness.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 12
SLOTS = 64
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the first n powers of its base and of the base's inverse."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _powers.clear()
        for p, b in zip(PRIMES, BASES, strict=True):
            pair = []
            for root in (b, pow(b, -1, p)):
                out = np.ones(1, dtype=np.uint64)
                while len(out) < size:
                    out = np.concatenate((out, out * np.uint64(pow(root, len(out), p)) % np.uint64(p)))
                pair.append(out)
            _powers.append((pair[0], pair[1]))
    return _powers


class PrefixHashes:
    def __init__(self, text: str | None):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.prefix = []
        for p, (up, _) in zip(PRIMES, powers(self.n + 1), strict=True):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(codes * up[: self.n] % np.uint64(p), out=sums[1:])
            self.prefix.append(sums % np.uint64(p))

    def spans(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of many spans modulo one of the primes."""
        p = np.uint64(PRIMES[which])
        h = self.prefix[which]
        return (h[ends] + p - h[starts]) % p * powers(self.n + 1)[which][1][starts] % p

    def span(self, start: int, end: int) -> int:
        """Hash of the code points from ``start`` up to ``end``, modulo both primes, in one integer."""
        at, to = np.array([start]), np.array([end])
        return int(self.spans(at, to, 0)[0]) << 31 | int(self.spans(at, to, 1)[0])

    def same(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        """Whether two spans of this length are equal (up to a collision of 62 bits)."""
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common span from two places on, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def ladder(n: int) -> np.ndarray:
    """Lengths from 1 up to n, each larger than the one before by about a quarter."""
    steps, at = [], 1
    while at <= n:
        steps.append(at)
        at += max(1, at // 4)
    return np.array(steps, dtype=np.int64)


def _mix16(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def fingerprint(text: str | None) -> str:
    """length, whole, prefixes, suffixes and slots in hexadecimal, joined by ``-``; equal texts have equal fingerprints."""
    h = PrefixHashes(text)
    n = h.n
    steps = ladder(n)
    none = np.zeros(0, dtype=np.uint64)
    starts = _mix16(h.spans(np.zeros_like(steps), steps)) if len(steps) else none
    ends = _mix16(h.spans(n - steps, np.full_like(steps, n))) if len(steps) else none
    slots = np.full(SLOTS, 1 << 31, dtype=np.int64)
    if n:
        at = np.arange(max(1, n - SPAN + 1))
        values = h.spans(at, np.minimum(at + SPAN, n)).astype(np.int64)
        with np.errstate(over="ignore"):
            values = ((values.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(slots, values & (SLOTS - 1), values >> 6)
    filled = slots < 1 << 31
    marks = np.where(filled, _mix16(slots + 1) | np.uint64(1), np.uint64(0))
    return f"{n:x}-{h.span(0, n):016x}-{_hex(starts)}-{_hex(ends)}-{_hex(marks)}"


def _hex(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


class Parsed:
    """A fingerprint taken apart once, for comparing."""

    def __init__(self, fp: str):
        self.fp = fp
        n, _, starts, ends, slots = fp.split("-")
        self.n = int(n, 16)
        self.starts, self.ends, self.slots = (np.frombuffer(bytes.fromhex(x), dtype=">u2") for x in (starts, ends, slots))


def _common(a: np.ndarray, b: np.ndarray, n: int) -> float:
    """Estimated length of the common start, from ladders of its hashes: binary search for the last equal rung."""
    rungs = min(len(a), len(b))
    same = bisect_right(range(rungs), 0, key=lambda k: int(a[k] != b[k]))
    if not same:
        return 0.0
    steps = ladder(n)
    low = steps[same - 1]
    high = steps[same] if same < len(steps) else n
    return float(min((low + high) / 2, n))


def likeness(a: Parsed, b: Parsed) -> float:
    """0 to 1; 1 for equal fingerprints only."""
    if a.fp == b.fp:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    n = min(a.n, b.n)
    ends = min(_common(a.starts, b.starts, n) + _common(a.ends, b.ends, n), n) * 2 / (a.n + b.n)
    either = ((a.slots > 0) | (b.slots > 0)).sum()
    jaccard = ((a.slots == b.slots) & (a.slots > 0)).sum() / either if either else 0.0
    return float(min(max(ends, 2 * jaccard / (1 + jaccard)), 1 - 1e-6))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, tail, id, text) in partitions that hold whole buckets, each sorted by tail and id.

    Buckets are ranges of ids between approximate quantiles.  Each ends with the first row of the next bucket, the last with
    the first row of all (tail: true), so that every row's successor follows it.  Null ids come first.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [k / (4 * partitions) for k in range(1, 4 * partitions)]
    found = rows.agg(F.percentile_approx("k", shares, 20 * partitions).alias("q")).first()["q"]
    bounds = np.array(sorted(set(found or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.int64), side="right").astype(np.int32))

    firsts = {r["b"]: r["k"] for r in rows.select("k", bucket_of("k").alias("b")).groupBy("b").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}
    keys = np.array(sorted(before), dtype=np.int64)
    to = np.array([before[k] for k in sorted(before)], dtype=np.int32)

    @F.pandas_udf("int")
    def tail_of(k: pd.Series) -> pd.Series:
        k = k.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
        hit = keys[at] == k if len(keys) else np.zeros(len(k), dtype=bool)
        return pd.Series(np.where(hit, to[at] if len(keys) else 0, -1).astype(np.int32))

    placed = rows.withColumn("b", bucket_of("k")).withColumn("t", tail_of("k"))
    places = F.array(F.struct(F.col("b").alias("bucket"), F.lit(False).alias("tail")), F.struct(F.col("t").alias("bucket"), F.lit(True).alias("tail")))
    dealt = placed.select("k", "id", "text", F.explode(places).alias("p")).where("p.bucket >= 0").select("p.bucket", "p.tail", "k", "id", "text")
    return dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "tail", "k", F.xxhash64("text")).select("bucket", "tail", "id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each of ``docs``.

    The next row is the next in ascending id, after the last the first; of equal ids the one of the lower text hash comes
    first.  Null texts count as empty.  A single row is its own successor.  No rows give none.
    """
    shape = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(batches):
        last = None
        for batch in batches:
            for row in zip(batch["bucket"], batch["tail"], batch["id"], batch["text"], strict=True):
                row = (*row, Parsed(fingerprint(row[3])))
                if last is not None and not last[1] and last[0] == row[0]:
                    yield last, row
                last = row

    def work(batches):
        out = []
        for (_, _, id_, text, own), (_, _, _, following, next_) in pairs(batches):
            other = edited(text, following)
            fp = fingerprint(other)
            out.append((id_, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own.fp, fp, likeness(own, Parsed(fp)), likeness(own, next_)))
            if len(out) >= 2000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(out):
        made = pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        return made.assign(id=made["id"].astype("Int64"))

    return in_order(docs, id_col, text_col).mapInPandas(work, shape)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")
