"""Documents to chunks (P1-P5, P7-P11), one generator for each kind of file.

Every function takes documents (doc_id, ext, content, ...) and returns the chunk table of ``schema.CHUNKS``; chunk ids count
from 0 within a document in the order of the text.  Blank and null contents have no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.latex import parse_latex
from tessera.schema import PATH_SEPARATOR

# The marker of a section, the threshold and the separator of semantic splits, the kinds of files.
MARKER = r"% --- (.+?) ---"
SPLIT_THRESHOLD = 1500
SPLIT_SEPARATOR = "|||---|||"
EXTENSIONS = (".tex", ".txt", ".md", ".docx")

_STRINGS = "array<string>"
_BARE = "struct<hierarchy_path:array<string>,labels:array<string>,citations:array<string>,refs:array<string>,caption:string,source:string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def parent_of(path: Column, empty: str = "Preamble") -> Column:
    return F.coalesce(F.nullif(F.array_join(path, PATH_SEPARATOR), F.lit("")), F.lit(empty))


def _chunks(rows: DataFrame, order: list[str], parent: Column | None = None) -> DataFrame:
    """From rows (doc_id, type, content, path, labels, citations, refs, caption) and what orders them to numbered chunks."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    meta = F.struct(F.col("path").alias("hierarchy_path"), "labels", "citations", "refs", "caption", F.lit(None).cast("string").alias("source"))
    return rows.select("doc_id", number.cast("int").alias("chunk_id"), "type", "content", (parent_of(F.col("path")) if parent is None else parent).alias("parent_section"), meta.alias("metadata"))


def _plain(path: Column) -> list[Column]:
    return [F.lit("paragraph").alias("type"), path.alias("path"), _none().alias("labels"), _none().alias("citations"), _none().alias("refs"), F.lit(None).cast("string").alias("caption")]


def section_bodies(docs: DataFrame, content: str = "content") -> DataFrame:
    """Rows (doc_id, sec_pos, section, body): text before the first marker (section null, position 0), then each section.

    Markers aren't anchored to lines and lie within one; blank bodies are dropped.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    names = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), strip))
    parts = docs.select("doc_id", F.posexplode(F.arrays_zip(names.alias("section"), F.split(text, MARKER, -1).alias("body"))).alias("sec_pos", "x"))
    return parts.select("doc_id", "sec_pos", F.col("x.section").alias("section"), strip(F.col("x.body")).alias("body")).where("body <> ''")


def chunk_tex(docs: DataFrame, content: str = "content") -> DataFrame:
    """Documents with section markers (.tex, .txt): each body is parsed under its section."""
    bodies = section_bodies(docs, content)
    whole = F.array(F.struct(F.lit("paragraph").alias("type"), F.col("body").alias("content"), F.array(F.lit("Preamble")).alias("path"), _none().alias("labels"), _none().alias("citations"), _none().alias("refs"), F.lit(None).cast("string").alias("caption")))
    parsed = bodies.where("section is not null").select("doc_id", "sec_pos", parse_latex(F.col("body"), F.array("section")).alias("items"))
    rows = bodies.where("section is null").select("doc_id", "sec_pos", whole.alias("items")).unionByName(parsed)
    rows = rows.select("doc_id", "sec_pos", F.posexplode("items").alias("pos", "x")).select("doc_id", "sec_pos", "pos", "x.*")
    return _chunks(rows, ["sec_pos", "pos"])


def chunk_latex(docs: DataFrame, content: str = "content") -> DataFrame:
    """Whole LaTeX documents without markers."""
    rows = docs.select("doc_id", F.posexplode(parse_latex(F.col(content), F.array().cast(_STRINGS))).alias("pos", "x")).select("doc_id", "pos", "x.*")
    return _chunks(rows, ["pos"])


def heading_paths(headings: Column) -> Column:
    """Path after each heading of an array of (level, title): a heading cuts the path to its level and adds its title."""
    start = F.struct(F.array().cast(_STRINGS).alias("path"), F.array().cast("array<array<string>>").alias("all"))

    def step(acc: Column, h: Column) -> Column:
        path = F.concat(F.slice(acc["path"], F.lit(1), F.greatest(h["level"] - 1, F.lit(0))), F.array(h["title"]))
        return F.struct(path.alias("path"), F.concat(acc["all"], F.array(path)).alias("all"))

    return F.aggregate(headings, start, step, lambda acc: acc["all"])


def chunk_markdown(docs: DataFrame, content: str = "content") -> DataFrame:
    """Markdown by its headings (P4): one paragraph for each body that isn't blank; text before the first has an empty path."""
    pattern = r"(?md)^#{1,6}[ \t].*$"
    text = F.coalesce(F.col(content), F.lit(""))
    lines = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    heads = F.transform(lines, lambda h: F.struct(F.length(F.regexp_extract(h, "^#+", 0)).alias("level"), strip(F.regexp_replace(h, "^#+", "")).alias("title")))
    paths = F.concat(F.array(F.array().cast(_STRINGS)), heading_paths(heads))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(paths.alias("path"), F.split(text, pattern, -1).alias("body"))).alias("pos", "x"))
    rows = rows.withColumn("content", strip(F.col("x.body"))).where("content <> ''")
    return _chunks(rows.select("doc_id", "pos", "content", *_plain(F.col("x.path"))), ["pos"])


def chunk_paragraph_table(paragraphs: DataFrame) -> DataFrame:
    """Word documents from their paragraphs (doc_id, pos, style, text): headings open groups, whose texts are joined (P5).

    A level that can't be read is no heading.  Text without a heading has an empty parent section.
    """
    level = F.when(F.col("style").startswith("Heading"), F.coalesce(F.try_to_number(F.element_at(F.split("style", " "), -1), F.lit("999")).cast("int"), F.lit(0))).otherwise(0)
    rows = paragraphs.withColumn("level", level)
    running = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("grp", F.sum((F.col("level") > 0).cast("int")).over(running))
    heads = rows.where("level > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("grp", "level", F.trim("text").alias("title")))).alias("heads"))
    paths = heads.select("doc_id", F.posexplode(heading_paths(F.col("heads"))).alias("grp", "path")).withColumn("grp", F.col("grp") + 1)
    bodies = rows.where("level = 0").groupBy("doc_id", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ps")).withColumn("content", strip(F.array_join(F.col("ps.text"), "\n"))).where("content <> ''")
    joined = bodies.join(paths, ["doc_id", "grp"], "left").withColumn("p", F.coalesce("path", F.array().cast(_STRINGS)))
    return _chunks(joined.select("doc_id", "grp", "content", *_plain(F.col("p"))), ["grp"], F.array_join("path", PATH_SEPARATOR))


def chunk_lines(docs: DataFrame, content: str = "content") -> DataFrame:
    """Plain prose: one paragraph for each line that isn't blank."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\n")).alias("pos", "line")).withColumn("content", strip(F.col("line"))).where("content <> ''")
    return _chunks(rows.select("doc_id", "pos", "content", *_plain(_none())), ["pos"])


def split_at_markers(content: Column, markers: Column) -> Column:
    """Parts of a text cut where markers first occur (P8): trimmed, without empty ones; the text itself if none is found."""
    at = F.array_sort(F.filter(F.transform(F.filter(F.transform(markers, strip), lambda m: m != ""), lambda m: F.instr(content, m)), lambda p: p > 0))
    bounds = F.concat(F.array(F.lit(1)), at, F.array(F.length(content) + 1))
    parts = F.transform(F.sequence(F.lit(1), F.size(at) + 1), lambda i: strip(content.substr(F.element_at(bounds, i), F.element_at(bounds, i + 1) - F.element_at(bounds, i))))
    return F.when(F.size(at) > 0, F.filter(parts, lambda p: p != "")).otherwise(F.array(content))


def split_long_chunks(chunks: DataFrame, markers: Column, threshold: int = SPLIT_THRESHOLD) -> DataFrame:
    """Chunks with paragraphs of more than ``threshold`` characters split at markers (array column), numbered anew.

    Null markers, as after a failed call, leave the chunk whole.
    """
    long_ = (F.col("type") == "paragraph") & (F.length("content") > threshold) & markers.isNotNull()
    parts = F.when(long_, split_at_markers(F.col("content"), markers)).otherwise(F.array("content"))
    rows = chunks.select("doc_id", F.col("chunk_id").alias("old"), "type", "parent_section", "metadata", F.posexplode(parts).alias("sub", "content"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("old", "sub")) - 1
    return rows.select("doc_id", number.cast("int").alias("chunk_id"), "type", "content", "parent_section", "metadata")


def markers_of_reply(reply: Column) -> Column:
    return F.split(reply, r"\|\|\|---\|\|\|")


def chunk_documents(docs: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """Chunks of documents (doc_id, ext, content) by extension (P1); Word documents come as their paragraphs.

    Other extensions raise an error when the rows are read; a null one and a Word document without ``paragraphs`` do too.
    """
    known = F.coalesce(F.col("ext").isin(*(EXTENSIONS if paragraphs is not None else [e for e in EXTENSIONS if e != ".docx"])), F.lit(False))
    docs = docs.withColumn("ext", F.when(known, F.col("ext")).otherwise(F.raise_error(F.concat(F.lit("unsupported extension: "), F.coalesce("ext", F.lit("null")))).cast("string")))
    found = chunk_tex(docs.where(F.col("ext").isin(".tex", ".txt"))).unionByName(chunk_markdown(docs.where("ext = '.md'")))
    return found.unionByName(chunk_paragraph_table(paragraphs)) if paragraphs is not None else found


def group_by_section(chunks: DataFrame) -> DataFrame:
    """Rows (doc_id, section, position, chunks) by the first title of the path, in the order of the text."""
    key = F.coalesce(F.try_element_at(F.col("metadata.hierarchy_path"), F.lit(1)), F.lit("Preamble"))
    grouped = chunks.groupBy("doc_id", key.alias("section")).agg(F.min("chunk_id").alias("first"), F.array_sort(F.collect_list(F.struct("chunk_id", "type", "content"))).alias("chunks"))
    return grouped.withColumn("position", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).cast("int")).drop("first")


def ungroup(grouped: DataFrame) -> DataFrame:
    """Grouped chunks as rows again."""
    return grouped.select("doc_id", "section", F.explode("chunks").alias("c")).select("doc_id", "section", "c.*")


# Commands that get a section marker, in order.
SECTION_COMMANDS = [
    (r"\\begin\{abstract\}", "Abstract"),
    (r"\\section\*?\{[Ii]ntroduction\}", "Introduction"),
    (r"\\section\*?\{.*?[Mm]ethod", "Methods"),
    (r"\\section\*?\{.*?[Rr]esult", "Results"),
    (r"\\section\*?\{.*?[Dd]iscussion\}", "Discussion"),
    (r"\\section\*?\{.*?[Cc]onclusion\}", "Conclusion"),
    (r"\\begin\{thebibliography\}", "References"),
]


def add_section_markers(text: Column) -> Column:
    """A marker line before each known command."""
    for pattern, name in SECTION_COMMANDS:
        text = F.regexp_replace(text, f"(?i)({pattern})", f"% --- {name} ---\n$1")
    return text


def preprocess_tex(text: Column) -> Column:
    """Comment lines blanked, runs of blank lines shortened, markers added (P10)."""
    text = F.regexp_replace(text, r"(?md)^%(?! ---).*$", "")
    return add_section_markers(F.regexp_replace(text, r"\n\s*\n\s*\n", "\n\n"))
