"""``python -m tessera SOURCE... --out FOLDER``: restructures documents and writes them, with the tables between."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.effects import CALL_SECONDS, EMBEDDERS, MAX_TOKENS, TEMPERATURE, GuardedModel, TimedModel, language_model
from tessera.operators.chunk import SPLIT_THRESHOLD
from tessera.operators.mapping import THRESHOLD
from tessera.plans.restructure import STAGES, Options, analyse, restructure
from tessera.session import session
from tessera.sources import files, sinks, templates


def read_sources(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Documents of text files, Word files and tar archives, and the paragraphs of the Word files; one id a file."""
    word, tar = [p for p in paths if p.endswith(".docx")], [p for p in paths if p.endswith((".tar", ".tar.gz", ".tgz"))]
    plain = [p for p in paths if p not in word and p not in tar]
    found = [files.read_texts(spark, plain)] if plain else []
    found += [files.read_archived(spark, tar)] if tar else []
    paragraphs = files.read_docx(spark, word) if word else None
    if paragraphs is not None:
        found.append(paragraphs.groupBy("doc_id", "path").agg(F.lit(".docx").alias("ext"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("content")))
    docs = found[0]
    for more in found[1:]:
        docs = docs.unionByName(more)
    return docs, paragraphs


def main(args: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("source", nargs="+", help="files: .tex, .txt, .md, .docx, tar archives")
    p.add_argument("--source2", help="a document to combine with the source, which must be one then")
    p.add_argument("--combine", choices=("smart", "robust"), default="smart")
    p.add_argument("--out", required=True)
    p.add_argument("--template", default="bitcoin_paper_hierarchical")
    p.add_argument("--templates", help="a JSON file with templates by name")
    p.add_argument("--stage", choices=STAGES, default="all")
    p.add_argument("--format", choices=("latex", "markdown", "json"), default="latex")
    p.add_argument("--remediate-orphans", action="store_true")
    p.add_argument("--no-polish", action="store_true")
    p.add_argument("--analysis", action="store_true", help="compare the result with the source")
    p.add_argument("--embedder", choices=sorted(EMBEDDERS), help="what sections and chunks are compared by; their terms if it isn't given")
    p.add_argument("--threshold", type=float, default=THRESHOLD, help="least similarity of a chunk with its section")
    p.add_argument("--split", action="store_true", help="let the model split long paragraphs")
    p.add_argument("--split-threshold", type=int, default=SPLIT_THRESHOLD, help="characters from which on a paragraph is long")
    p.add_argument("--provider", default="echo")
    p.add_argument("--max-tokens", type=int, default=MAX_TOKENS)
    p.add_argument("--temperature", type=float, default=TEMPERATURE)
    p.add_argument("--timeout", type=float, default=CALL_SECONDS, help="seconds of a call")
    a = p.parse_args(args)
    spark = session("tessera")
    folder = sinks.session_folder(a.out, datetime.datetime.now(datetime.UTC))
    docs, paragraphs = read_sources(spark, a.source)
    more = None
    if a.source2:
        if len(a.source) != 1:
            p.error("--source2 needs a single source")
        more = read_sources(spark, [a.source2])[0].drop("doc_id").crossJoin(docs.select("doc_id"))  # two single rows
    model = GuardedModel(TimedModel(language_model(a.provider), a.max_tokens, a.temperature, a.timeout))
    embedder = EMBEDDERS[a.embedder]() if a.embedder else None
    options = Options(a.stage, a.format, a.split, a.remediate_orphans, not a.no_polish, threshold=a.threshold, embedder=embedder, split_threshold=a.split_threshold)
    found = restructure(docs, templates.skeleton(spark, a.template, a.templates), model, options, more, a.combine, paragraphs)
    if a.stage != "all":
        sinks.save_checkpoint(found, folder, a.stage)
        return folder
    found = sinks.save_checkpoint(found, folder, "document")
    if a.analysis:
        ending = {"latex": ".tex", "markdown": ".md", "json": ".txt"}[a.format]
        sinks.save_json(analyse(docs.where("ext <> '.docx'"), found.select("doc_id", F.lit(ending).alias("ext"), F.col("document").alias("content"))), folder, "analysis")
    return sinks.save_document_file(found, folder, a.format) if len(a.source) == 1 else sinks.save_document(found, folder, a.format)


if __name__ == "__main__":
    print(main())
