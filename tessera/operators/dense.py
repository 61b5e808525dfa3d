"""Similarity of chunks' vectors with sections' as a blocked matrix product.

Sections go to every task as a matrix of unit vectors, in blocks of at most ``MATRIX_BYTES``; a template is one block.  A task
multiplies an Arrow batch of chunks with a block and keeps of each row the best section and the next, so that no row for a
chunk and a section is ever made.  More blocks are taken one after the other, on the rows that carry what was best so far:
the chunks are read once and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Bytes of a block of section vectors, which every task holds.
MATRIX_BYTES = 32 << 20
#: Products that a task holds at a time.
CELLS = 4_000_000


@dataclass
class Block:
    """Sections of one block by the length of their vectors: for each, their indexes in ascending order and unit vectors.
    """

    nodes: dict[int, np.ndarray]
    units: dict[int, np.ndarray]


def _block(rows: list[tuple[int, list | None]]) -> Block:
    by: dict[int, list] = {}
    for node, v in rows:
        v = np.asarray([] if v is None or any(x is None for x in v) else v, dtype=np.float64)
        size = np.sqrt((v * v).sum())
        by.setdefault(len(v), []).append((node, v / size if size > 0 and np.isfinite(size) else np.zeros(len(v))))
    nodes, units = {}, {}
    for dims, found in by.items():
        found.sort(key=lambda x: x[0])
        nodes[dims], units[dims] = np.array([n for n, _ in found], dtype=np.int64), np.array([u for _, u in found]).reshape(len(found), dims)
    return Block(nodes, units)


def section_blocks(sections: DataFrame, vector: str = "embedding", most: int = MATRIX_BYTES) -> Iterator[Broadcast]:
    """The sections' vectors as broadcast blocks of at most ``most`` bytes, by ascending index; the driver holds one at a time."""
    sc, rows, size = sections.sparkSession.sparkContext, [], 0
    for r in sections.select(F.col("node_idx").cast("int").alias("n"), F.col(vector).cast("array<double>").alias("v")).orderBy("n").toLocalIterator():
        if rows and size + 8 * len(r["v"] or []) > most:
            yield sc.broadcast(_block(rows))
            rows, size = [], 0
        rows.append((r["n"], r["v"]))
        size += 8 * len(r["v"] or [])
    if rows:
        yield sc.broadcast(_block(rows))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and starts of a column of arrays, and all their values; a null array, or one with a null in it, counts as empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if values.null_count:
        bad = np.zeros(len(column), dtype=bool)
        bad[pc.list_parent_indices(column).to_numpy()[pc.is_null(values).to_numpy(zero_copy_only=False)]] = True
        starts = np.cumsum(lengths) - lengths
        lengths = np.where(bad, 0, lengths)
        return lengths, starts, pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
    return lengths, np.cumsum(lengths) - lengths, values.to_numpy(zero_copy_only=False)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1))
    good = (size > 0) & np.isfinite(size)
    return np.where(good[:, None], m, 0.0) / np.where(good, size, 1.0)[:, None]


def _groups(column: pa.Array, width: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of equal vector length, in pieces whose products fit: (length, row numbers, unit vectors)."""
    lengths, starts, values = _vectors(column)
    for dims in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dims)
        step = max(1, CELLS // max(1, width.get(dims, 1), dims))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield dims, part, _unit(values[starts[part][:, None] + np.arange(dims)].reshape(len(part), dims))


#: What is kept of a chunk: the best section and the next, -1 where there is none.
KEPT = ["node_idx", "score", "second_idx", "second_score"]


def _merge(kept: list[np.ndarray], rows: np.ndarray, node: np.ndarray, score: np.ndarray) -> None:
    """Puts one more candidate a row into the best two; of equal scores the smaller section is better."""
    n1, s1, n2, s2 = (k[rows] for k in kept)
    known = node >= 0
    over1 = known & ((n1 < 0) | (score > s1) | (score == s1) & (node < n1))
    over2 = known & ~over1 & ((n2 < 0) | (score > s2) | (score == s2) & (node < n2))
    kept[2][rows], kept[3][rows] = np.where(over1, n1, np.where(over2, node, n2)), np.where(over1, s1, np.where(over2, score, s2))
    kept[0][rows], kept[1][rows] = np.where(over1, node, n1), np.where(over1, score, s1)


def _best_two(batch: pa.RecordBatch, block: Block, kept: list[np.ndarray]) -> None:
    for dims, rows, units in _groups(batch.column("_v"), {d: len(n) for d, n in block.nodes.items()}):
        if dims in block.nodes:
            nodes, scores = block.nodes[dims], units @ block.units[dims].T
            line = np.arange(len(rows))
            for _ in range(min(2, len(nodes))):
                at = scores.argmax(axis=1)
                _merge(kept, rows, nodes[at], scores[line, at])
                scores[line, at] = -np.inf
        # sections of other lengths: cosine 0 with the two smallest
        others = np.sort(np.concatenate([n[:2] for d, n in block.nodes.items() if d != dims] or [np.zeros(0, dtype=np.int64)]))[:2]
        for n in others.tolist():
            _merge(kept, rows, np.full(len(rows), n), np.zeros(len(rows)))


@dataclass
class DenseScores:
    """Cosines of the vectors of ``chunks`` with those of ``sections``, worked out where they are asked for.

    Both tables may have vectors of several lengths: those of different lengths, null and zero vectors, and such with a null
    or an infinite part have cosine 0.  Sections of equal cosine rank by ``node_idx``.
    """

    chunks: DataFrame
    sections: DataFrame
    vector: str = "embedding"
    section_vector: str = "embedding"
    most: int = MATRIX_BYTES

    def best(self) -> DataFrame:
        """Rows (doc_id, chunk_id, node_idx, score, second_idx, second_score), one for each chunk; null where there is no section."""
        rows = self.chunks.select("doc_id", "chunk_id", F.col(self.vector).cast("array<double>").alias("_v"), *[F.lit(-1 if "idx" in c else 0.0).cast("long" if "idx" in c else "double").alias(c) for c in KEPT])
        for block in section_blocks(self.sections, self.section_vector, self.most):
            rows = rows.mapInArrow(self._step(block), rows.schema)
        null = lambda c, of: F.when(F.col(of) >= 0, F.col(c))
        return rows.select("doc_id", "chunk_id", null("node_idx", "node_idx").cast("int").alias("node_idx"), null("score", "node_idx").alias("score"), null("second_idx", "second_idx").cast("int").alias("second_idx"), null("second_score", "second_idx").alias("second_score"))

    @staticmethod
    def _step(block: Broadcast):
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in KEPT]
                _best_two(batch, block.value, kept)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "chunk_id", "_v")), *map(pa.array, kept)], names=batch.schema.names)

        return work

    def of(self, pairs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        """``pairs`` (doc_id, chunk_id, node_idx, ...) with ``score``; those of unknown chunks or sections are left out.

        ``chunks``: those that pairs can have, if they are fewer; their vectors are what is shuffled.
        """
        vectors = (self.chunks if chunks is None else chunks).select("doc_id", "chunk_id", F.col(self.vector).cast("array<double>").alias("_v"))
        rows = pairs.join(vectors, ["doc_id", "chunk_id"]).withColumn("score", F.lit(None).cast("double"))
        shape = StructType([f if f.name != "node_idx" else StructField("node_idx", IntegerType()) for f in rows.schema.fields[:-1]] + [StructField("score", DoubleType())])
        rows = rows.withColumn("node_idx", F.col("node_idx").cast("int"))
        for block in section_blocks(self.sections, self.section_vector, self.most):
            rows = rows.mapInArrow(self._pairs(block), shape)
        return rows.where("score is not null").drop("_v")

    @staticmethod
    def _pairs(block: Broadcast):
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = batch.column("score").to_numpy(zero_copy_only=False).astype(np.float64).copy()
                asked = pc.fill_null(batch.column("node_idx"), -1).to_numpy(zero_copy_only=False)
                for nodes in block.value.nodes.values():
                    score[np.isin(asked, nodes)] = 0.0
                for dims, rows, units in _groups(batch.column("_v"), {}):
                    if dims in block.value.nodes:
                        nodes = block.value.nodes[dims]
                        at = np.minimum(np.searchsorted(nodes, asked[rows]), len(nodes) - 1)
                        hit = nodes[at] == asked[rows]
                        score[rows[hit]] = (units[hit] * block.value.units[dims][at[hit]]).sum(axis=1)
                names = batch.schema.names
                columns = {**{c: batch.column(c) for c in names}, "score": pa.array(score, mask=np.isnan(score))}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

        return work
