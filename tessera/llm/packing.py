"""Packing documents into sequences of a fixed length: concatenate and cut.

Two passes.  The first turns every text into ids, ends it with one more id, and writes the ids with the partition that they
were made in and the number of ids before them in that partition.  Prefix sums over the partitions' totals then say where each
partition begins in the concatenation of all, and with that where each document does.  The second pass cuts at the multiples
of the sequence length; it needs no shuffle, since a document's place says which windows it falls in.

A piece is what of one document lies in one window.  ``sequences`` puts pieces together: windows that lie within one task are
finished there, and only those at its two ends go out as boundary records, which meet by their window.

All windows are full but the last, so that the whole table has less than one window of padding.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, sized, small_batches, table

LENGTH = 2048
END = 1
PAD = 0
#: Words, and parts of words, whose ids a worker remembers, the first that it meets; others are made each time.
REMEMBERED = 300_000
#: Partitions whose totals are summed in one group.
BLOCK = 1000
#: Below this code point composed forms, lower case and classes of characters are the same everywhere.
_LATIN = 0x250
#: Neither beyond it, nor of a lower case beyond it, nor what is white space for Python alone.
_PLAIN = re.compile(f"[^\x1c-\x1f{chr(_LATIN)}-{chr(sys.maxunicode)}{''.join(c for c in map(chr, range(_LATIN)) if max(map(ord, c.lower())) >= _LATIN)}]*")


def _split_pattern(spec: dict) -> re.Pattern | None:
    """The pattern that cuts words into parts, for Latin text, if the vocabulary is of the kind that ``Encoder`` does by word:
    composed, lower-case, without white space, and each part on its own."""
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or [b["type"] for b in before] != ["Split", "ByteLevel"]:
        return None
    split, level = before
    if not split["invert"] or split["behavior"] != "Removed" or level["add_prefix_space"] or level["use_regex"] or spec["model"]["type"] != "BPE":
        return None
    pattern = split["pattern"]["Regex"]
    for name in "LN":
        pattern = pattern.replace(rf"\p{{{name}}}", re.escape("".join(c for c in map(chr, range(_LATIN)) if unicodedata.category(c)[0] == name)))
    return re.compile(pattern)


class Encoder:
    """Ids of texts, as little-endian integers of two or four bytes, by the vocabulary's size.

    Where no id reaches over white space, the ids of a text are those of its words in a row, and a word's are those of its
    parts.  Texts are split and their words numbered by Arrow; the vocabulary's own model makes the ids of each word once a
    batch, unless it is remembered.  Words with characters beyond Latin, texts with special tokens in them and vocabularies of
    another kind are left to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.split, self.model = _split_pattern(spec), self.tokenizer.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(128, _LATIN)}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        out = []
        for part in self.split.findall(word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                ids = array(self.code, [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.bytes))]).tobytes()
                if len(self.parts) < REMEMBERED:
                    self.parts[part] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.words.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        other = [k for k in new if not _PLAIN.fullmatch(words[k])]
        for k, ids in zip(other, self._whole([words[k] for k in other]), strict=True):
            found[k] = ids
        for k in new:
            if found[k] is None:
                found[k] = self._word(words[k])
        for k in new[: max(0, REMEMBERED - len(self.words))]:
            self.words[words[k]] = found[k]
        return found

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text; no text is null."""
        if self.split is None:
            return self._whole(texts.to_pylist())
        special = reduce(pc.or_, [pc.match_substring(texts, t) for t in self.special], pa.array(np.zeros(len(texts), dtype=bool)))
        lists = pc.ascii_split_whitespace(pc.if_else(special, "", texts))
        numbered = lists.flatten().dictionary_encode()
        made = self._words(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, made), np.int32, len(made)) // array(self.code).itemsize
        ids, first = np.frombuffer(b"".join(made), dtype=f"<u{array(self.code).itemsize}"), np.cumsum(size, dtype=np.int32) - size
        word = numbered.indices.to_numpy()
        count = size[word]
        stop = np.cumsum(count, dtype=np.int32)
        place = np.repeat(first[word] - (stop - count), count)
        place += np.arange(len(place), dtype=np.int32)
        ids = ids[place]
        bounds = np.concatenate(([0], stop))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        at = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
        for k, own in zip(at, self._whole([texts[k].as_py() for k in at]), strict=True):
            out[k] = own
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Bytes of text that are made into ids at a time.
BYTES = 16_000_000


def _groups(texts: pa.StringArray, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that have together at most about ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)))
        yield start, stop
        start = stop


def tokenize(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, before, n, id, ids): each text's ids and ``end``, how many they are, and how many ids come before them in
    their partition."""
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, make = 0, encoder(path)
        last = array(make.code, [end])
        width, last = last.itemsize, last.tobytes()
        for batch in batches:
            texts = batch.column("text")
            for a, b in _groups(texts):
                ids = [x + last for x in make.encode(texts.slice(a, b - a))]
                n = np.array([len(x) // width for x in ids], dtype=np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(a, b - a), pa.array(before), pa.array(n), batch.column("id").slice(a, b - a), pa.array(ids, pa.binary())], schema=schema)

    return rows.mapInArrow(work, "part int, before long, n long, id long, ids binary")


def part_offsets(rows: DataFrame) -> DataFrame:
    """Rows (part, base): ids before each partition.  Sums inside blocks of partitions, then over the blocks."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"part div {BLOCK}"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each thousand partitions
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    own = totals.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(blocks, "block").select("part", (F.col("base") + F.col("first")).alias("base"))


def place(docs: DataFrame, path: str, folder: str | None = None, **how) -> DataFrame:
    """Rows (at, n, id, ids): the documents' ids with their place in the concatenation of all.

    Documents stand in the order of the partitions that the table is read in, and in those as they come.  The ids are written
    once, in ``folder`` or a new one in the shared checkpoint folder, and everything after reads them there: lost executors
    can't change a place.
    """
    spark = docs.sparkSession
    kept = folder or f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    with small_batches(spark):
        tokenize(docs, path, **how).write.mode("overwrite").option("compression", "zstd").parquet(kept)
    rows = spark.read.parquet(kept)
    return rows.join(sized(part_offsets(rows)), "part").select((F.col("base") + F.col("before")).alias("at"), "n", "id", "ids")


def _pieces(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """For every piece of a batch: its row, start, length, window and offset there."""
    at, n = (batch.column(c).to_numpy() for c in ("at", "n"))
    first, last = at // length, (at + n - 1) // length
    count = last - first + 1
    row = np.repeat(np.arange(len(at)), count)
    window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(window * length, at[row]) - at[row]
    stop = np.minimum((window + 1) * length, at[row] + n[row]) - at[row]
    return row, start, stop - start, window, (at[row] + start) % length


def _wide(ids: bytes, n: int) -> np.ndarray:
    """A document's ids in four bytes each."""
    return np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")


def pieces(placed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each part of a document in a window."""
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, size, window, offset = _pieces(batch, length)
            crc, ids, here = np.empty(len(row), dtype=np.int64), b"", -1
            all_ids, n = batch.column("ids"), batch.column("n").to_numpy()
            for k, (r, a, s) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
                if r != here:
                    here, ids = r, memoryview(_wide(all_ids[r].as_py(), n[r])).cast("B")
                crc[k] = zlib.crc32(ids[4 * a : 4 * (a + s)])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *map(pa.array, (start, size, crc, n[row], window, offset))], schema=schema)

    return placed.mapInArrow(work, ", ".join(f"{c} long" for c in names))


FRAGMENT = "sequence_id long, offset long, n long, ids array<long>, parts array<struct<id: long, start: long, length: long, offset: long>>"


def _fragments(placed: DataFrame, length: int) -> DataFrame:
    """Rows of ``FRAGMENT``: runs of pieces that follow each other in a window and in a task."""
    part = pa.struct([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(part))])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list = []  # window, offset, ids, parts
        for batch in batches:
            done = []
            all_ids, n, names = batch.column("ids"), batch.column("n").to_numpy(), batch.column("id").to_pylist()
            here, ids = -1, None
            for r, a, s, w, o in zip(*(x.tolist() for x in _pieces(batch, length)), strict=True):
                if r != here:
                    here, ids = r, _wide(all_ids[r].as_py(), n[r])
                if run and (run[0] != w or run[1] + len(run[2]) != o):
                    done.append(run)
                    run = []
                run = run or [w, o, [], []]
                run[2].extend(ids[a : a + s].tolist())
                run[3].append({"id": names[r], "start": a, "length": s, "offset": o})
            if done:
                yield frame(done)
        if run:
            yield frame([run])

    def frame(runs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in runs]), pa.array([x[1] for x in runs]), pa.array([len(x[2]) for x in runs]), pa.array([x[2] for x in runs], schema.field("ids").type), pa.array([x[3] for x in runs], schema.field("parts").type)], schema=schema)

    return placed.mapInArrow(work, FRAGMENT)


def sequences(placed: DataFrame, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """Rows (sequence_id, n, ids, parts): whole sequences; ``n`` ids of documents, then ``pad`` up to ``length``, which only
    the last one needs.  One whose ``n`` is a power of two isn't padded.  ``parts``: the pieces, in order.

    Windows that one task holds whole go out as they are; of the others each task has a boundary record, and these are
    gathered by window: a window has ``length`` ids at most, so a group is never larger.
    """
    found = _fragments(placed, length)
    whole = found.where(F.col("n") == length).select("sequence_id", "n", "ids", "parts")
    met = found.where(F.col("n") < length).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "n", "ids", "parts"))).alias("f"))
    met = met.select("sequence_id", F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"), F.flatten(F.transform("f", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("f", lambda x: x["parts"])).alias("parts"))
    short = (F.col("n") < length) & (F.col("n").bitwiseAND(F.col("n") - 1) != 0)
    padded = F.when(short, F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), (length - F.col("n")).cast("int")))).otherwise(F.col("ids"))
    return whole.unionByName(met.withColumn("ids", padded))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, folder: str | None = None, **how) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all pieces of all documents.

    Null and empty texts are a document of the end id alone.  Repeated rows, equal ids and null ids are documents of their
    own, each with its pieces.  Texts are taken whole, however long.  No rows give none.  Other columns aren't read.
    """
    return pieces(place(docs, path or vocabulary(), folder, **how), length)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
