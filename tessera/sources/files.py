"""Documents from files."""

from __future__ import annotations

import io
import tarfile
import urllib.request
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.materialize import materialized
from tessera.sources.named import read_tars, store_of

TEXT_EXTENSIONS = (".txt", ".tex", ".md")


def extension_of(path: Column) -> Column:
    """The extension as it is spelled, with its dot; empty if there is none."""
    return F.regexp_extract(path, r"(\.[^./\\]+)$", 1)


def document_id(path: Column) -> Column:
    return F.xxhash64(path)


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (doc_id, path, ext, content) of .txt, .tex and .md files (S1); other extensions raise when the rows are read."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    ext = extension_of(F.col("path"))
    ext = F.when(ext.isin(*TEXT_EXTENSIONS), ext).otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path"))).cast("string"))
    return rows.select(document_id(F.col("path")).alias("doc_id"), "path", ext.alias("ext"), "content")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(data: bytes) -> list[tuple[str, str]]:
    """(style name, text) of the body's paragraphs; styles by their names, ``Normal`` where none is given."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else s.get(f"{_W}styleId")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else "Normal"
        if name.lower().startswith("heading"):
            name = "H" + name[1:]
        text = "".join("\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else e.text or "" for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
        out.append((name, text))
    return out


def read_docx(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (doc_id, path, pos, style, text) of the paragraphs of Word files."""

    @F.pandas_udf("array<struct<style:string,text:string>>")
    def paragraphs(contents: pd.Series) -> pd.Series:
        return pd.Series([[{"style": s, "text": t} for s, t in docx_paragraphs(bytes(c))] for c in contents])

    rows = spark.read.format("binaryFile").load(paths).select("path", paragraphs("content").alias("ps"))
    return rows.select(document_id(F.col("path")).alias("doc_id"), "path", F.posexplode("ps").alias("pos", "p")).select("doc_id", "path", "pos", "p.style", "p.text")


# --- included files (S3) ----------------------------------------------------------------------------------------------
INCLUDE = r"\\(?:input|include)\s*\{([^}]+)\}"


def plain_path(path: Column, ups: int = 8) -> Column:
    """A path without ``.`` parts and with up to ``ups`` of its ``..`` parts taken back."""
    path = F.regexp_replace(path, r"(?<=^|/)(?:\./)+", "")
    for _ in range(ups):
        path = F.regexp_replace(path, r"(?<=^|/)(?!\.\./)[^/]+/\.\./", "")
    return path


def resolve_includes(docs: DataFrame) -> DataFrame:
    """``docs`` (path, content) with each ``\\input`` and ``\\include`` replaced by the file it names, to any depth.

    Names are relative to the folder of the file that they stand in and get ``.tex`` if they don't end so.  A file that isn't
    among ``docs`` leaves the command; one that includes itself, directly or not, is left at the second time.  Each piece of a text carries
    the chain of files that it was included by, so one file may stand in several places.
    """
    files = docs.select(plain_path(F.col("path")).alias("_file"), F.col("content").alias("_text"))
    pieces = docs.where("content is not null").select("path", F.array().cast("array<int>").alias("at"), F.array(plain_path(F.col("path"))).alias("chain"), F.col("content").alias("t"), F.lit(True).alias("open"))
    todo = F.col("open") & F.col("t").rlike(INCLUDE)
    while not pieces.where(todo).isEmpty():
        zipped = F.arrays_zip(F.split("t", INCLUDE, -1).alias("piece"), F.regexp_extract_all("t", F.lit(INCLUDE), F.lit(1)).alias("name"), F.regexp_extract_all("t", F.lit(INCLUDE), F.lit(0)).alias("command"))
        parts = pieces.where(todo).select("path", "at", "chain", F.posexplode(zipped).alias("k", "x"))
        name = F.trim("x.name")
        own = F.when(name.startswith("/"), F.lit("")).otherwise(F.regexp_extract(F.element_at("chain", -1), r"^(.*/)", 1))
        target = plain_path(F.concat(own, F.when(name.endswith(".tex"), name).otherwise(F.concat(name, F.lit(".tex")))))
        parts = parts.withColumn("_file", target).join(files, "_file", "left")
        parts = parts.withColumn("found", F.coalesce(F.col("_text").isNotNull() & ~F.array_contains("chain", F.col("_file")), F.lit(False)))
        before = parts.select("path", F.concat("at", F.array(2 * F.col("k"))).alias("at"), "chain", F.col("x.piece").alias("t"), F.lit(False).alias("open"))
        chain = F.when(F.col("found"), F.concat("chain", F.array("_file"))).otherwise(F.col("chain"))
        text = F.when(F.col("found"), F.col("_text")).otherwise(F.coalesce("x.command", F.lit("")))
        named = parts.select("path", F.concat("at", F.array(2 * F.col("k") + 1)).alias("at"), chain.alias("chain"), text.alias("t"), F.col("found").alias("open"))
        pieces = materialized(pieces.where(~todo).withColumn("open", F.lit(False)).unionByName(before).unionByName(named))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda p: p["t"]), "")
    return docs.join(pieces.groupBy("path").agg(whole.alias("_new")), "path", "left").withColumn("content", F.col("_new")).select(*docs.columns)


# --- archives and the network (S4-S7) ---------------------------------------------------------------------------------
MAIN_NAMES = ("main.tex", "paper.tex", "manuscript.tex")


def filename_of_url(url: Column) -> Column:
    """The last part of a URL's path, with ``.tex``."""
    name = F.regexp_extract(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), r"([^/]*)$", 1)
    return F.when(name.endswith(".tex"), name).otherwise(F.concat(name, F.lit(".tex")))


def main_file(files: DataFrame, by: str = "archive", path: str = "path", position: str = "pos") -> DataFrame:
    """The main file of each archive: the first of a usual name, else the first."""
    usual = F.regexp_extract(F.col(path), r"([^/]*)$", 1).isin(*MAIN_NAMES)
    return files.groupBy(by).agg(F.min_by(path, F.struct(F.when(usual, 0).otherwise(1), F.col(position), F.col(path))).alias("main"))


def tex_members(data: bytes, limit: int = 1 << 28) -> list[tuple[str, str]]:
    """(name, text) of the .tex files of a tar archive, read in memory and never unpacked to disk (S5); one of more than
    ``limit`` bytes is an error."""
    out = []
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for m in tar:
            if m.isfile() and m.name.endswith(".tex"):
                if m.size > limit:
                    raise ValueError(f"{m.name} has {m.size} bytes, more than {limit}")
                out.append((m.name, tar.extractfile(m).read().decode("utf-8", "replace")))
    return out


def read_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (archive, pos, path, content) of the .tex files in tar archives, one member after the other.

    Archives in a store that only Spark reads come as binary files, of at most 2 GB each.
    """
    found = spark.read.format("binaryFile").load(paths)
    names = [r["path"] for r in found.select("path").collect()]
    try:
        for n in names:
            store_of(n)
        return read_tars(spark, names)
    except (ValueError, OSError, NotImplementedError):  # a scheme that pyarrow doesn't know
        pass

    @F.pandas_udf("array<struct<path:string,content:string>>")
    def members(contents: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "content": t} for p, t in tex_members(bytes(c))] for c in contents])

    rows = found.select(F.col("path").alias("archive"), members("content").alias("ms"))
    return rows.select("archive", F.posexplode("ms").alias("pos", "m")).select("archive", "pos", "m.path", "m.content")


def read_archived(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (doc_id, path, ext, content): of each tar archive the main file, with what it includes from the archive."""
    members = read_archives(spark, paths)
    inside = members.select("archive", "pos", F.concat("archive", F.lit("!/"), "path").alias("path"), "content")
    main = main_file(inside).select(F.col("main").alias("path"))
    whole = resolve_includes(inside.select("path", "content")).join(main, "path", "left_semi")
    return whole.select(document_id(F.col("path")).alias("doc_id"), "path", F.lit(".tex").alias("ext"), "content")


class UrlPartition(InputPartition):
    def __init__(self, url: str):
        self.url = url


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.timeout = float(options.get("timeout", "30"))
        if options.get("allow", "false").lower() != "true":
            raise ValueError("reading from the network is off; set option allow to true")

    def partitions(self):
        return [UrlPartition(u) for u in self.urls]

    def read(self, partition):
        with urllib.request.urlopen(partition.url, timeout=self.timeout) as r:
            yield (partition.url, r.read())


class HttpSource(DataSource):
    """``spark.read.format("tessera_http").option("urls", "...").option("allow", "true")``: rows (url, content)."""

    @classmethod
    def name(cls):
        return "tessera_http"

    def schema(self):
        return "url string, content binary"

    def reader(self, schema):
        return HttpReader(self.options)


def register_http(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)


def latest_documents(sessions: DataFrame) -> DataFrame:
    """The last final document of each path over sessions (session_id, path, content), for a later analysis."""
    order = Window.partitionBy("path").orderBy(F.desc("session_id"))
    return sessions.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
