"""Analysis of processed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import running

#: Elements that a report compares, with the name of their count.
ELEMENTS = ("sections", "figure", "table", "equation")


def element_counts(chunks: DataFrame, by: list[str], type_: str = "type", path: str = "path", content: str = "content", literal: bool = False) -> DataFrame:
    """Counts of each document (A2): sections by depth of their paths, elements by exact type, chunks, characters.

    With ``literal`` the section counts are 0, as they are where nodes carry no paths.
    """
    return chunks.groupBy(*by).agg(*_counts(F.lit(True), type_, path, content, literal))


def _counts(use: Column, type_: str, path: str, content: str, literal: bool) -> list[Column]:
    depth = lambda d: F.lit(0).cast("long") if literal else F.count_distinct(F.when(use & (F.size(path) >= d), F.slice(path, 1, d)))
    return [
        depth(1).alias("sections"),
        depth(2).alias("subsections"),
        depth(3).alias("subsubsections"),
        *[F.count_if(use & (F.col(type_) == t)).alias(t) for t in ("figure", "table", "equation")],
        F.count_if(use).alias("chunks"),
        F.coalesce(F.sum(F.when(use, F.length(content))), F.lit(0)).alias("chars"),
    ]


def count_pairs(chunks: DataFrame, kept: Column, by: list[str], type_: str = "type", path: str = "path", content: str = "content", literal: bool = False) -> DataFrame:
    """Rows (by, original, processed): the counts of all chunks and of those ``kept``, in one pass; documents of which nothing
    is kept are left out."""
    return chunks.groupBy(*by).agg(F.struct(*_counts(F.lit(True), type_, path, content, literal)).alias("original"), F.struct(*_counts(kept, type_, path, content, literal)).alias("processed")).where("processed.chunks > 0")


def preservation(pairs: DataFrame, by: list[str], original: str = "original", processed: str = "processed", augmented: str | None = None) -> DataFrame:
    """Rows (by, element, original, processed, rate) from pairs of count structs (A3).

    An element that the original lacks has rate 100 if the result lacks it too, else 0.  ``augmented`` counts as original.
    """
    before = lambda e: F.col(f"{original}.{e}") + (F.coalesce(F.col(f"{augmented}.{e}"), F.lit(0)) if augmented else F.lit(0))
    each = F.array(*[F.struct(F.lit(e).alias("element"), before(e).alias("original"), F.col(f"{processed}.{e}").alias("processed")) for e in ELEMENTS])
    rows = pairs.select(*by, F.explode(each).alias("x")).select(*by, "x.*")
    none = F.when(F.col("processed") == 0, 100.0).otherwise(0.0)
    return rows.withColumn("rate", F.when(F.col("original") > 0, F.col("processed") / F.nullif(F.col("original"), F.lit(0)) * 100).otherwise(none))


def structure_change(pairs: DataFrame, by: list[str], original: str = "original", processed: str = "processed") -> DataFrame:
    """Change of size in percent, section counts and depths (A4)."""
    o, p = (lambda n: F.col(f"{original}.{n}")), (lambda n: F.col(f"{processed}.{n}"))
    change = F.when(o("chars") > 0, (p("chars") - o("chars")) / F.nullif(o("chars"), F.lit(0)) * 100).otherwise(0.0)
    return pairs.select(
        *by, change.alias("char_change_percent"), o("sections").alias("original_sections"), p("sections").alias("processed_sections"),
        (o("subsections") + o("subsubsections")).alias("original_depth"), (p("subsections") + p("subsubsections")).alias("processed_depth"),
    )


def quality_score(rates: dict[str, Column], change: Column, original_depth: Column, processed_depth: Column, augmented: bool = False) -> Column:
    """0 to 100 (A5): each of equation, figure and table below 95 percent costs a tenth of what it lacks, a change of size of
    over a quarter 20 (not if there was an augmentation), more depth gives 5."""
    score = F.lit(100.0)
    for e in ("equation", "figure", "table"):
        score = score - F.when(rates[e] < 95, (1 - rates[e] / 100) * 10).otherwise(0.0)
    if not augmented:
        score = score - F.when(F.abs(change) > 25, 20.0).otherwise(0.0)
    score = score + F.when(processed_depth > original_depth, 5.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def scored_pairs(pairs: DataFrame, by: list[str], augmented: bool = False) -> DataFrame:
    """Rows (by, quality_score) from pairs of count structs."""
    wide = preservation(pairs, by).groupBy(*by).agg(*[F.max(F.when(F.col("element") == e, F.struct("rate", "original", "processed"))).alias(f"_{e}") for e in ELEMENTS])
    rows = wide.join(structure_change(pairs, by), by)
    for e in ELEMENTS:
        rows = rows.withColumn(e, F.col(f"_{e}.rate")).withColumn(f"{e}_original", F.col(f"_{e}.original")).withColumn(f"{e}_processed", F.col(f"_{e}.processed")).drop(f"_{e}")
    rates = {e: F.col(e) for e in ELEMENTS}
    return rows.withColumn("quality_score", quality_score(rates, F.col("char_change_percent"), F.col("original_depth"), F.col("processed_depth"), augmented))


def tenths(value: str, signed: bool = False) -> Column:
    """A double with one decimal, as printf writes it: by its exact value, ties to even (``format_string`` rounds ties up)."""
    return F.expr(f"format_number(cast(`{value}` as double), '{'+0.0;-0.0' if signed else '0.0'}')")


def report(rows: DataFrame, by: list[str]) -> DataFrame:
    """A Markdown report of each row of ``scored_pairs`` (A5)."""
    line = lambda e: F.format_string(f"| {e.capitalize():<9} | %-8d | %-9d | %s%%              |", f"{e}_original", f"{e}_processed", tenths(e))
    text = F.concat_ws(
        "\n",
        F.lit("# Document Processing Analysis Report"), F.lit("---"), F.format_string("**Overall Quality Score: %s/100**", tenths("quality_score")),
        F.lit("\n## 1. Content Preservation Analysis"), F.lit("| Element   | Original | Processed | Preservation Rate |"), F.lit("|-----------|----------|-----------|-------------------|"), *[line(e) for e in ELEMENTS],
        F.lit("\n## 2. Structural & Size Analysis"), F.format_string("- **Character Count Change:** %s%%", tenths("char_change_percent", signed=True)),
        F.format_string("- **Section Count:** %d -> %d", "original_sections", "processed_sections"), F.format_string("- **Subsection/Depth Count:** %d -> %d", "original_depth", "processed_depth"),
    )
    return rows.select(*by, text.alias("report"))


def validation_stats(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, passed, failed, mean similarity and success rate of validations (is_valid, similarity) (A7); zeros if none."""
    aggs = [
        F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("passed"), F.count_if(~F.col("is_valid")).alias("failed"),
        F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("average_similarity"), F.coalesce(F.avg(F.col("is_valid").cast("double")), F.lit(0.0)).alias("success_rate"),
    ]
    return results.groupBy(*by).agg(*aggs) if by else results.agg(*aggs)


def running_mean(results: DataFrame, by: list[str], order: str, value: str = "similarity") -> DataFrame:
    """The mean up to each row (W9), of the values that are there; running sums in two levels."""
    rows = running(results.withColumn("_there", F.col(value).isNotNull().cast("long")), by, [F.col(order)], {"_sum": value, "_many": "_there"})
    return rows.withColumn("running_mean", F.col("_sum") / F.nullif(F.col("_many"), F.lit(0))).drop("_there", "_n", "_sum", "_many")


def contributions(used: DataFrame, section: str = "section", chunk: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Sources of each section, and what each chunk went into (A9), from rows (section, chunk, content)."""
    by_section = used.groupBy(section).agg(F.count_distinct(chunk).alias("n_chunks"), F.array_sort(F.collect_set(chunk)).alias("chunks"))
    by_chunk = used.groupBy(chunk).agg(F.count_distinct(section).alias("n_sections"), F.concat(F.left(F.min("content"), F.lit(100)), F.lit("...")).alias("excerpt"))
    return by_section, by_chunk


def contribution_summary(used: DataFrame, section: str = "section", chunk: str = "chunk_id") -> DataFrame:
    """Chunks, sections, and chunks used in several sections."""
    per = used.groupBy(chunk).agg(F.count_distinct(section).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("n") > 1).alias("n_reused")).crossJoin(used.agg(F.count_distinct(section).alias("n_sections")))


#: What of a text must be kept: name and pattern of one occurrence.
KEPT = {
    "equations": r"\\begin\{(?:equation|align|gather|multline)\*?\}|\$\$",
    "code_blocks": r"\\begin\{(?:verbatim|lstlisting|minted)\}|```",
    "lists": r"\\begin\{(?:itemize|enumerate|description)\}",
    "figures": r"\\begin\{figure\*?\}",
}


def preserved_elements(pairs: DataFrame, by: list[str], original: str, final: str) -> DataFrame:
    """Rows (by, element, original, final, preserved) of two texts (A10)."""
    n = lambda text, p: F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p))
    each = F.array(*[F.struct(F.lit(e).alias("element"), n(original, p).alias("original"), n(final, p).alias("final")) for e, p in KEPT.items()])
    return pairs.select(*by, F.explode(each).alias("x")).select(*by, "x.*", (F.col("x.original") == F.col("x.final")).alias("preserved"))
