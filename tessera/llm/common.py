"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Folds by crc32(doc_id as text).
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(doc_id.cast("string")) % folds).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; where none is set, a temporary one in local mode (tests), else an error."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is a file or folder of that name, in any store that Spark can write to."""
    store, path = _path(spark, name)
    return store.exists(path)


def remove(spark: SparkSession, name: str) -> None:
    """Deletes a folder in any store that Spark can write to."""
    store, path = _path(spark, name)
    store.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder.

    A checkpoint keeps the size that the optimizer estimates, which is the product of a join's sides: in loops its digits
    double with every turn, and multiplying them stops the driver.  Where it has got beyond 128 bits it is forgotten.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint()
    plan = kept._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= 128:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), kept._jdf.schema(), False), spark)


def counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """The same rows as ``cut`` gives, and aggregates of them, all in one job."""
    seen = Observation()
    kept = cut(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
    return kept, seen.get


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, which in a loop of many small jobs may be long after they fill disks.
    Memory that Arrow keeps for later goes back as well.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """While it holds, Python gets rows in Arrow batches of at most so many: for functions of long texts run at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body) -> Column:
    """``body`` of a column expression that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, combine) -> Column:
    """The running combination of an array: each element is combined with what stands before it.

    ``combine(x, y)``: x with the combination y of earlier elements, null if there is none; must be associative.  An
    aggregate that appends to an array copies it at each of its n elements; so long arrays are cut into pieces of about the
    square root of n, combined each and then with what stands before the piece.
    """

    def piece(a: Column) -> Column:
        return F.aggregate(a, F.slice(a, 1, 0), lambda done, x: F.concat(done, F.array(combine(x, F.get(done, F.size(done) - 1)))))

    def pieces(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / size).cast("int") - 1), lambda i: piece(F.slice(a, i * size + 1, size)))

    def joined(parts: Column) -> Column:
        return let(piece(F.transform(parts, lambda p: F.element_at(p, -1))), lambda totals: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: combine(x, F.get(totals, i - 1)))))))

    return let(values, lambda a: F.when(F.size(a) <= 32, piece(a)).otherwise(let(pieces(a), joined)))


def checksum(*cols: str) -> dict[str, Column]:
    """Aggregates that give the count and an order-free checksum of rows."""
    mixed = F.xxhash64(*cols)
    return {"n": F.count(F.lit(1)), "a": F.sum(F.shiftrightunsigned(mixed, 33)), "b": F.bit_xor(mixed)}


#: Bytes of a table (as JSON text, which is more than it takes as rows) up to which it is sent to every task.
SMALL = 32 << 20


def _bytes(df: DataFrame) -> Column:
    return F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})))


def size_of(df: DataFrame) -> int:
    """Bytes of all rows as JSON text."""
    return df.agg(_bytes(df)).first()[0] or 0


def sized(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The same rows, computed once, marked for a broadcast if they take at most ``most`` bytes; else joins shuffle them."""
    kept, seen = counted(df, bytes=_bytes(df))
    return F.broadcast(kept) if (seen["bytes"] or 0) <= most else kept


#: Parts to which the rows of one key are dealt in a salted join.
SALTS = 8


def salted_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``few`` (one row for each value of ``key``), whose rows are repeated so that a frequent
    value of ``rows`` is dealt to ``SALTS`` tasks."""
    salt = fresh("_salt", rows, few)
    spread = few.withColumn(salt, F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    others = [F.col(c) for c in rows.columns if c != key]
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int") if others else (F.rand(1) * SALTS).cast("int"))
    return dealt.join(spread, [key, salt]).drop(salt)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lowest_hashes(rows: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """Of ``rows`` (distinct ``key``, not null) the ``most`` of the lowest key hashes, in each value of ``by`` if it is given.

    A sample whose bound is ``most`` and that all rows have the same chance of.  Hashes beyond the share that is surely
    enough (six standard deviations over it) are left out where the rows are, so that what is ordered is small.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 52)) / float(1 << 52)
    enough = most + 6 * most**0.5 + 10
    at, size, rank = (fresh(c, rows) for c in ("_place", "_n", "_k"))
    rows = rows.withColumn(at, place)
    if by is None:
        n = rows.count()
        near = rows.where(F.col(at) <= enough / max(n, 1))
        return near.orderBy(at, key).limit(most).drop(at)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias(size))
    near = rows.join(sizes, by).where(F.col(at) <= enough / F.col(size))
    ranked = near.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(at, key)))
    return ranked.where(F.col(rank) <= most).drop(at, rank, size)
