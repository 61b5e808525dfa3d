"""Results to files (K1-K9).

Sinks write with Spark's writers under one folder a session; a folder is replaced as a whole, so a repeated job leaves the
same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import safe_filename, session_id
from tessera.operators.render import EXTENSIONS
from tessera.sources.named import save_named


def session_folder(base: str, ts) -> str:
    """``base/<yyyymmdd_hhmmss>`` (K2)."""
    return f"{base.rstrip('/')}/{ts:%Y%m%d_%H%M%S}"


def with_session(df: DataFrame, ts: Column) -> DataFrame:
    """A session's rows carry its id, by which tables are partitioned."""
    return df.withColumn("session_id", session_id(ts))


def save_text(df: DataFrame, path: str, column: str = "document") -> None:
    """Each row of a column as a record of text files (K1, K7, K8)."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def save_nodes(nodes: DataFrame, path: str) -> None:
    """A folder for each node with text, named by its path; the text lies in it (K3)."""
    rows = nodes.where("processed_content <> ''").select(safe_filename(F.col("path")).alias("filename"), F.col("processed_content").alias("value"))
    rows.write.mode("overwrite").partitionBy("filename").text(path)


def save_document(df: DataFrame, folder: str, fmt: str = "latex", column: str = "document") -> str:
    """The final document under the folder, by its format; an unknown one is taken for LaTeX (K4)."""
    path = f"{folder.rstrip('/')}/final_document{EXTENSIONS.get(fmt, EXTENSIONS['latex'])}"
    save_text(df, path, column)
    return path


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One file of exactly this name, in any store that Spark can write to; an old one is replaced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_document_file(df: DataFrame, folder: str, fmt: str = "latex", column: str = "document") -> str:
    """A single final document as the file ``final_document`` with its format's ending (K4); more than one is an error."""
    rows = df.select(column).head(2)
    if len(rows) != 1:
        raise ValueError("one document makes a file; use save_document for more")
    path = f"{folder.rstrip('/')}/final_document{EXTENSIONS.get(fmt, EXTENSIONS['latex'])}"
    write_file(df.sparkSession, path, rows[0][0] or "")
    return path


def save_node_files(nodes: DataFrame, folder: str) -> list[str]:
    """Nodes as files named by their paths under ``processed_nodes`` (K3), written by the tasks that have them; their names.

    Nodes of several documents may lie there if no two have the same path; else that is an error, and nothing is written.
    """
    rows = nodes.where("processed_content <> ''").select(safe_filename(F.col("path")).alias("filename"), F.col("processed_content").alias("content"))
    at = f"{folder.rstrip('/')}/processed_nodes"
    save_named(rows, at)
    return sorted(f"{at}/{r['filename']}" for r in rows.select("filename").collect())


def append_log(entries: DataFrame, folder: str) -> None:
    """Log entries (session_id, ts, message) to the session's log (K5)."""
    entries.write.mode("append").partitionBy("session_id").json(f"{folder.rstrip('/')}/processing_log")


def save_checkpoint(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A stage's table, written and read again (K6): what comes after it doesn't repeat its effects."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_json(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def preprocessed_name(path: Column) -> Column:
    """``x.tex`` to ``x_preprocessed.tex`` (K9)."""
    return F.replace(path, F.lit(".tex"), F.lit("_preprocessed.tex"))
