"""Trees rendered to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions, headers and footers of the formats.
EXTENSIONS = {"latex": ".tex", "markdown": ".md", "json": ".json"}
_PAD = " " * 20
HEADERS = {
    "latex": ("\n" + _PAD).join(
        ["\\documentclass{article}", "\\usepackage[utf8]{inputenc}", "\\usepackage{amsmath}", "\\usepackage{graphicx}", "\\usepackage{hyperref}", "\\title{Refactored Document}", "\\author{Automated System}", "\\date{\\today}", "\\begin{document}", "\\maketitle"]
    ),
    "markdown": "",
}
FOOTERS = {"latex": "\\end{document}", "markdown": ""}
ORPHANS = {"latex": "\n\\section*{Uncategorized Content}", "markdown": "\n# Uncategorized Content"}
COMMANDS = ("section", "subsection", "subsubsection")


def heading(title: Column, depth: Column, fmt: str) -> Column:
    """The heading of a node (R2, R3); titles aren't escaped."""
    if fmt == "markdown":
        return F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), title)
    command = F.lit("paragraph")
    for k, name in enumerate(COMMANDS, 1):
        command = F.when(depth == k, name).otherwise(command)
    return F.concat(F.lit("\\"), command, F.lit("{"), title, F.lit("}"))


def render(nodes: DataFrame, fmt: str = "latex", orphans: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """Rows (doc_id, document) from nodes (doc_id, path, sort_key, processed_content).

    Nodes come depth first; empty lines between them are left out; orphans (doc_id, chunk_id, content) follow under a
    heading of their own.  ``json``: an array of titles, depths and contents (R4).  A node's place must be unique.
    """
    if fmt == "json":
        entry = F.struct("sort_key", F.element_at("path", -1).alias("title"), F.size("path").alias("depth"), F.coalesce("processed_content", F.lit("")).alias("content"))
        listed = nodes.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("x"))
        return listed.select(by, F.to_json(F.transform("x", lambda n: F.struct(n["title"].alias("title"), n["depth"].alias("depth"), n["content"].alias("content")))).alias("document"))
    lines = F.filter(F.array(heading(F.element_at("path", -1), F.size("path"), fmt), F.coalesce("processed_content", F.lit(""))), lambda x: x != "")
    body = nodes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("sort_key", lines.alias("lines")))).alias("ns")).select(by, F.flatten("ns.lines").alias("parts"))
    if orphans is not None:
        rest = orphans.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda x: x["content"]), "\n\n").alias("rest"))
        body = body.join(rest, by, "full_outer")
        extra = F.when(F.col("rest").isNotNull(), F.array(F.lit(ORPHANS[fmt]), F.col("rest"))).otherwise(F.array().cast("array<string>"))
        body = body.select(by, F.concat(F.coalesce("parts", F.array().cast("array<string>")), extra).alias("parts"))
    whole = F.concat(F.array(F.lit(HEADERS[fmt])), F.col("parts"), F.array(F.lit(FOOTERS[fmt])))
    return body.select(by, F.array_join(F.filter(whole, lambda x: x != ""), "\n").alias("document"))


def full_text(nodes: DataFrame, by: str = "doc_id") -> DataFrame:
    """Rows (doc_id, text): all contents depth first, each with a blank line after it."""
    has = nodes.where("processed_content <> ''")
    return has.groupBy(by).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "processed_content"))), lambda x: x["processed_content"]), "\n\n"), F.lit("\n\n")).alias("text"))
