"""The whole way of a document: chunks, mapping, processing, polishing, rendering; combination of two; analysis of a result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.effects import EchoModel, Embedder, GuardedModel, LanguageModel, embed
from tessera.materialize import materialized
from tessera.operators import analysis, chunk, combine, mapping, process, render
from tessera.operators.dense import DenseScores
from tessera.sources import templates

STAGES = ("chunk", "map", "all")


@dataclass
class Options:
    """``stage``: where to stop; ``split``: long paragraphs by the model; ``remediate``: orphans by the model; ``embedder``:
    what chunks and sections are compared by, instead of by their terms; ``split_threshold``: characters of a long paragraph."""

    stage: str = "all"
    fmt: str = "latex"
    split: bool = False
    remediate: bool = False
    polish: bool = True
    critique: bool = False
    threshold: float = mapping.THRESHOLD
    embedder: Embedder | None = None
    split_threshold: int = chunk.SPLIT_THRESHOLD


def chunks_of(docs: DataFrame, model: LanguageModel, options: Options, paragraphs: DataFrame | None = None) -> DataFrame:
    found = chunk.chunk_documents(docs, paragraphs)
    if options.split:
        long_ = F.when((F.col("type") == "paragraph") & (F.length("content") > options.split_threshold), F.col("content"))
        asked = materialized(found.withColumn("_reply", F.when(long_.isNotNull(), process.split_reply(long_, model))))  # asked once
        found = chunk.split_long_chunks(asked, chunk.markers_of_reply(F.col("_reply")), options.split_threshold)
    return materialized(found)


def map_documents(chunks: DataFrame, sections: DataFrame, model: LanguageModel, options: Options) -> DataFrame:
    """Assignments with ranks, by term similarity or by an embedder; orphans are asked for where ``remediate`` is set."""
    scores: mapping.Scores = embedded_scores(chunks, sections, options.embedder) if options.embedder else mapping.text_scores(chunks, sections)
    edges = materialized(mapping.reference_edges(chunks))
    assigned = mapping.assign_boosted(chunks, scores, edges, options.threshold)
    if options.remediate:
        assigned = materialized(assigned)
        details = "\n".join(f"- {r['path_key']}: {r['description'] or ''}" for r in sections.orderBy("node_idx").collect())
        orphans = chunks.join(assigned.where("node_idx is null"), ["doc_id", "chunk_id"], "left_semi")
        assigned = mapping.model_rescue(assigned, process.orphan_replies(orphans, F.lit(details), model), sections)
    return materialized(mapping.with_rank(mapping.cohesion(assigned, edges)))


def embedded_scores(chunks: DataFrame, sections: DataFrame, embedder: Embedder) -> DenseScores:
    """Scores by an embedder's vectors of the chunks' texts and of the sections' descriptions, which are made once each."""
    theirs = materialized(chunks.select("doc_id", "chunk_id", "metadata", embed(F.col("content"), embedder).alias("embedding")))
    return DenseScores(theirs, materialized(sections.select("node_idx", embed(F.coalesce("description", "title"), embedder).alias("embedding"))))


def section_nodes(chunks: DataFrame, assigned: DataFrame, sections: DataFrame) -> DataFrame:
    """Nodes (doc_id, path, sort_key, content, generative) of every document: the whole template, filled where chunks fell."""
    filled = mapping.node_contents(chunks, assigned)
    root = sections.where("depth = 1").select(F.element_at("path", 1).alias("_root"), F.col("generative").alias("_gen"))
    tree = sections.select("node_idx", "path", "sort_key").withColumn("_root", F.element_at("path", 1)).join(root, "_root").select("node_idx", "path", "sort_key", F.col("_gen").alias("generative"))
    every = chunks.select("doc_id").distinct().crossJoin(F.broadcast(tree)) if sections.count() <= mapping.MAX_SECTIONS else chunks.select("doc_id").distinct().crossJoin(tree)
    return every.join(filled, ["doc_id", "node_idx"], "left").select("doc_id", "path", "sort_key", F.coalesce("node_content", F.lit("")).alias("content"), "generative")


def process_nodes(nodes: DataFrame, model: LanguageModel, options: Options) -> DataFrame:
    """Main nodes first; generative ones are written from the rendered main tree and stand before it; then polish."""
    main = process.process_tree(nodes.where("not generative"), model, fmt=options.fmt, critique=options.critique)
    text = render.render(main, options.fmt if options.fmt in render.HEADERS else "latex").select("doc_id", F.col("document").alias("_whole"))
    gen = nodes.where("generative").join(text, "doc_id", "left")
    written = process.process_tree(gen, model, fmt=options.fmt, generative=F.col("_whole"), critique=options.critique).drop("_whole")
    both = combine.recombine(written, main).withColumn("sort_key", F.concat(F.array(F.col("part")), "sort_key")).drop("part")
    return process.polish(both, model) if options.polish else both


def restructure(docs: DataFrame, sections: DataFrame | None = None, model: LanguageModel | None = None, options: Options | None = None, augmentation: DataFrame | None = None, strategy: str = "smart", paragraphs: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, document), or the table of an earlier stage.

    ``augmentation``: documents of the same ids, combined with the first by ``strategy`` (smart or robust) before they are
    processed; both have the template's tree, so robust keeps the first's texts.
    """
    options = options or Options()
    if options.stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    model = model or GuardedModel(EchoModel())
    sections = materialized(templates.skeleton(docs.sparkSession, "bitcoin_paper_hierarchical") if sections is None else sections)
    chunks = chunks_of(docs, model, options, paragraphs)
    if options.stage == "chunk":
        return chunks
    assigned = map_documents(chunks, sections, model, options)
    if options.stage == "map":
        return assigned
    nodes = section_nodes(chunks, assigned, sections)
    if augmentation is not None:
        more = chunks_of(augmentation, model, options)
        other = section_nodes(more, map_documents(more, sections, model, Options(threshold=options.threshold)), sections)
        tree = {"smart": combine.combine_smart, "robust": combine.combine_robust}[strategy](nodes, other)
        nodes = tree.join(nodes.select("doc_id", "path", "generative"), ["doc_id", "path"], "left").withColumn("generative", F.coalesce("generative", F.lit(False)))
    done = process_nodes(nodes, model, options)
    orphans = chunks.join(assigned.where("node_idx is null"), ["doc_id", "chunk_id"], "left_semi").select("doc_id", "chunk_id", "content")
    return render.render(done, options.fmt, orphans)


def analyse(original: DataFrame, final: DataFrame) -> DataFrame:
    """Rows (doc_id, quality_score, report, ...) of two sets of documents (doc_id, ext, content) with the same ids."""
    names = ["sections", "subsections", "subsubsections", "figure", "table", "equation", "chunks", "chars"]
    counts = lambda d, name: analysis.element_counts(chunk.chunk_documents(d).withColumn("path", F.col("metadata.hierarchy_path")), ["doc_id"]).select("doc_id", F.struct(*names).alias(name))
    scored = analysis.scored_pairs(counts(original, "original").join(counts(final, "processed"), "doc_id"), ["doc_id"])
    return scored.join(analysis.report(scored, ["doc_id"]), "doc_id")
