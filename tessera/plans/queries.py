"""The named queries: each takes (spark, sf_dir) and applies operators of the library to whole test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import effects, text, vector
from tessera.materialize import shared_folder
from tessera.operators import analysis, breaker, chunk, combine, context, mapping, process, render
from tessera.plans import inputs
from tessera.plans.inputs import table
from tessera.plans.restructure import Options, restructure
from tessera.sources import files, sinks, templates
from tessera.streaming import state

R = lambda c: F.round(c, 6)


# --- chunks -----------------------------------------------------------------------------------------------------------
def chunk_paragraphs(spark, d) -> DataFrame:
    return chunk.chunk_lines(inputs.documents(spark, d)).where(text.valid_chunk(F.col("type"), F.col("content"), F.col("parent_section"))).select("doc_id", "chunk_id", "content", "parent_section")


def section_marker_split(spark, d) -> DataFrame:
    return chunk.section_bodies(inputs.conversation_texts(spark, d, "% --- %s ---"))


def section_marker_chunks(spark, d) -> DataFrame:
    docs = inputs.conversation_texts(spark, d, "% --- %s ---").withColumn("ext", F.lit(".tex"))
    return chunk.chunk_documents(docs).select("doc_id", "chunk_id", "type", "content", "parent_section")


def chunks_grouped_by_section(spark, d) -> DataFrame:
    grouped = chunk.group_by_section(inputs.turn_chunks(spark, d))
    return grouped.select("doc_id", "section", "position", F.size("chunks").cast("long").alias("n_chunks"), F.array_join(F.col("chunks.chunk_id").cast("array<string>"), ",").alias("chunk_ids"))


def ungrouped_chunks(spark, d) -> DataFrame:
    return chunk.ungroup(chunk.group_by_section(inputs.turn_chunks(spark, d))).select("doc_id", "section", "chunk_id", "content")


def markdown_chunks(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("t", F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), "role", F.lit("\n"), "text"))
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("content"))
    return chunk.chunk_markdown(docs).select("doc_id", "chunk_id", "content", "parent_section")


def paragraph_table_chunks(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", F.concat(F.lit("Heading "), (F.col("turn") % 3 + 1).cast("string"))).otherwise("Normal").alias("style"), "text")
    return chunk.chunk_paragraph_table(rows).select("doc_id", "chunk_id", "content", "parent_section")


def latex_chunks(spark, d) -> DataFrame:
    head = F.concat(F.lit("\\section{A}\n"), F.left("content", F.lit(200)), F.lit("\n\\begin{figure}\\caption{c}\\label{f}"), F.col("doc_id").cast("string"), F.lit("\\end{figure}\nsee \\ref{f}\n\\subsection{B}\n"), F.col("content"))
    docs = inputs.documents(spark, d).withColumn("content", head)
    found = chunk.chunk_latex(docs)
    return found.select("doc_id", "chunk_id", "type", "parent_section", "content", F.array_join("metadata.labels", ",").alias("labels"), F.array_join("metadata.refs", ",").alias("refs"), F.coalesce("metadata.caption", F.lit("")).alias("caption"))


def long_chunk_split(spark, d) -> DataFrame:
    rows = inputs.documents(spark, d).withColumn("chunk_id", F.lit(0)).withColumn("type", F.lit("paragraph")).withColumn("parent_section", F.lit("x")).withColumn("metadata", F.struct(F.lit(1).alias("one")))
    third = F.floor(F.length("content") / 3).cast("int")
    markers = F.array(F.substring(F.col("content"), third * 2, F.lit(20)), F.substring(F.col("content"), third, F.lit(20)), F.lit("no such marker"))
    return chunk.split_long_chunks(rows, markers).select("doc_id", "chunk_id", "content")


def tex_preprocess(spark, d) -> DataFrame:
    line = F.concat(F.lit("% note "), F.col("turn").cast("string"), F.lit("\n\n \n\n\\section{Introduction}\n% --- kept ---\n"), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", chunk.preprocess_tex(line).alias("content"))


def section_markers(spark, d) -> DataFrame:
    body = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("\\begin{abstract}", "\\section*{Our METHODS}", "\\section{Results of it}", "\\section{Conclusion}", "\\begin{thebibliography}")]), (F.col("turn") % 5 + 1).cast("int")), F.lit("\n"), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", chunk.add_section_markers(body).alias("content"))


# --- templates and trees ----------------------------------------------------------------------------------------------
def template_skeleton(spark, d) -> DataFrame:
    """The sections of a template, with how many turns of conversations their descriptions are most like."""
    sections = templates.skeleton(spark, "bitcoin_paper_hierarchical")
    chunks = inputs.turn_chunks(spark, d)
    found = mapping.assign(chunks, mapping.text_scores(chunks, sections), 0.05).groupBy("node_idx").agg(F.count(F.lit(1)).alias("n_chunks"))
    return sections.join(found, "node_idx", "left").select("node_idx", "path_key", "parent_idx", "depth", "title", "generative", "dynamic_subsections", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def skeleton_flatten(spark, d) -> DataFrame:
    nodes = (
        table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"), F.col("r_regionkey").alias("ord"))
        .unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("ord")))
        .unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("title"), F.col("c_custkey").alias("ord")))
    )
    return templates.skeleton_of_table(nodes, "id", "parent", "title", "ord").select("id", "path_key", "depth", F.array_join(F.col("sort_key").cast("array<string>"), ".").alias("sort_key"))


def tree_outline(spark, d) -> DataFrame:
    return templates.outline(inputs.region_nodes(spark, d), ["doc_id"])


# --- mapping ----------------------------------------------------------------------------------------------------------
def map_argmax(spark, d) -> DataFrame:
    return inputs.vector_scores(spark, d).best().select("doc_id", "chunk_id", "node_idx", R("score").alias("score"))


def map_second(spark, d) -> DataFrame:
    """By how much each chunk's best section is better than the next."""
    found = inputs.vector_scores(spark, d).best()
    return found.select("doc_id", "chunk_id", "node_idx", "second_idx", R("second_score").alias("second_score"), R(F.col("score") - F.col("second_score")).alias("margin"))


def map_orphans(spark, d) -> DataFrame:
    found = mapping.assign(inputs.vectors(spark, d), inputs.vector_scores(spark, d))
    return found.groupBy("method", F.coalesce("node_idx", F.lit(-1)).alias("node_idx")).agg(F.count(F.lit(1)).alias("n"), R(F.max("assignment_score")).alias("best"))


def reference_edges(spark, d) -> DataFrame:
    return mapping.reference_edges(inputs.line_chunks(spark, d)).select("doc_id", "src", "dst")


def graph_boost(spark, d) -> DataFrame:
    """Each chunk's best section after the boost."""
    found = mapping.graph_boost(inputs.vector_scores(spark, d), inputs.vector_edges(spark, d), threshold=0.0)
    return found.select("doc_id", "chunk_id", "node_idx", R("score").alias("score"))


def graph_corrections(spark, d) -> DataFrame:
    """The scores that the boost raises."""
    scores = inputs.vector_scores(spark, d)
    found = mapping.boost_corrections(scores.best(), scores, inputs.vector_edges(spark, d), threshold=0.0)
    return found.select("doc_id", "chunk_id", "node_idx", "times", R("score").alias("score"))


def _assigned(spark, d) -> DataFrame:
    return mapping.assign(inputs.vectors(spark, d), inputs.vector_scores(spark, d), 0.15)


def neighbor_rescue(spark, d) -> DataFrame:
    return mapping.neighbor_rescue(_assigned(spark, d)).withColumnRenamed("_n", "node_idx")


def graph_rescue(spark, d) -> DataFrame:
    return mapping.graph_rescue(_assigned(spark, d), inputs.vector_edges(spark, d)).withColumnRenamed("_n", "node_idx")


def cohesion(spark, d) -> DataFrame:
    found = mapping.cohesion(_assigned(spark, d), inputs.vector_edges(spark, d))
    return found.select("doc_id", "chunk_id", F.coalesce("node_idx", F.lit(-1)).alias("node_idx"), "method")


def model_rescue(spark, d) -> DataFrame:
    sections = inputs.centroids(spark, d).select("node_idx", F.concat(F.lit("A -> "), F.col("node_idx").cast("string")).alias("path_key"))
    replies = inputs.vectors(spark, d).select("doc_id", "chunk_id", F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit(" A -> "), F.col("doc_id").cast("string"), F.lit(" "))).otherwise("UNCATEGORIZED").alias("reply"))
    found = mapping.model_rescue(_assigned(spark, d), replies, sections)
    return found.select("doc_id", "chunk_id", F.coalesce("node_idx", F.lit(-1)).alias("node_idx"), "method")


def text_map(spark, d) -> DataFrame:
    sections = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("node_idx"), F.col("text").alias("description"))
    chunks = inputs.turn_chunks(spark, d)
    return mapping.assign(chunks, mapping.text_scores(chunks, sections)).select("doc_id", "chunk_id", F.coalesce("node_idx", F.lit(-1)).alias("node_idx"), R("assignment_score").alias("score"), "method")


def node_contents(spark, d) -> DataFrame:
    chunks = inputs.turn_chunks(spark, d)
    assigned = chunks.select("doc_id", "chunk_id", (F.col("chunk_id") % 2).alias("node_idx"), F.lit("semantic").alias("method"), F.lit(1.0).alias("assignment_score"))
    return mapping.node_contents(chunks, mapping.with_rank(assigned))


# --- text functions ---------------------------------------------------------------------------------------------------
def format_enforce_latex(spark, d) -> DataFrame:
    body = F.concat(F.lit("### Title\n- item\n"), F.col("content"))
    return inputs.documents(spark, d).select("doc_id", text.rewrite_format(body, "latex").alias("fixed"))


def format_enforce_markdown(spark, d) -> DataFrame:
    body = F.concat(F.lit("\\section{A} \\subsection{B} \\textbf{c} \\textit{d}\n"), F.col("content"))
    return inputs.documents(spark, d).select("doc_id", text.rewrite_format(body, "markdown").alias("fixed"))


def format_issues(spark, d) -> DataFrame:
    return inputs.documents(spark, d).select("doc_id", F.array_join(text.format_issues(F.col("content"), "latex"), "; ").alias("latex_issues"), F.array_join(text.format_issues(F.col("content"), "markdown"), "; ").alias("markdown_issues"))


def content_quality(spark, d) -> DataFrame:
    q = text.content_quality(F.col("content"))
    return inputs.documents(spark, d).select("doc_id", q.alias("q")).select("doc_id", "q.is_valid", R("q.score").alias("score"))


def section_summary(spark, d) -> DataFrame:
    return inputs.documents(spark, d).select("doc_id", text.section_summary(F.col("content")).alias("summary"))


def response_validation(spark, d) -> DataFrame:
    body = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  % Error: "), "text")).when(F.col("turn") % 4 == 1, F.left("text", F.lit(9))).otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.validate_response(body).alias("v")).select("conv_id", "turn", "v.ok", F.coalesce("v.text", F.lit("")).alias("text"), F.coalesce("v.reason", F.lit("")).alias("reason"))


def regex_matches(spark, d) -> DataFrame:
    found = text.find_all(F.col("content"), r"\d+")
    return inputs.documents(spark, d).select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, ",").alias("found"))


def prompts_and_replies(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    reply = F.concat(F.lit("Critique\nfinal polished version:  "), F.col("text"))
    return t.select(
        "conv_id", "turn", text.polished_part(reply).alias("polished"), F.array_join(text.path_of_reply(F.concat(F.lit('"'), "role", F.lit('" -> b'), F.col("turn").cast("string"))), "|").alias("path"),
        F.array_join(text.comma_list(F.col("text")), "|").alias("parts"), text.head(F.col("text"), 30, dots=True).alias("start"), text.tail(F.col("text"), 30).alias("ending"),
        text.render_prompt("term_extraction", full_text_excerpt=text.head(F.col("text"), process.TERMS_EXCERPT)).alias("prompt"),
    )


def file_names(spark, d) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", files.filename_of_url(F.col("url")).alias("filename"), text.safe_filename(F.array(F.lit("1. A b"), F.concat(F.lit("Part "), F.col("page_id").cast("string")))).alias("safe"), sinks.preprocessed_name(files.filename_of_url(F.col("url"))).alias("preprocessed"),
    )


def main_files(spark, d) -> DataFrame:
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_partkey") % 5 == 0, "src/main.tex").otherwise(F.concat(F.lit("src/x"), F.col("l_partkey").cast("string"), F.lit(".tex"))).alias("path"))
    return files.main_file(members)


def include_resolution(spark, d) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    roots = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("\\input {n"), k.cast("string"), F.lit("}"))), "+").alias("content")).select(F.concat(F.lit("/t/r"), F.col("n_regionkey").cast("string"), F.lit(".tex")).alias("path"), F.concat("content", F.lit("\\include{gone}")).alias("content"))
    leaves = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/t/n"), F.col("n_nationkey").cast("string"), F.lit(".tex")).alias("path"), F.concat(F.lit("<"), "n_name", F.lit(" \\input{r"), F.col("n_regionkey").cast("string"), F.lit("}>")).alias("content"))
    return files.resolve_includes(roots.unionByName(leaves)).where("path like '/t/r%'").select("path", "content")


def session_ids(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.session_id(F.col("o_orderdate")).alias("session_id"))


# --- similarity -------------------------------------------------------------------------------------------------------
def _next_pairs(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    b = t.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("b"))
    return t.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("a")).join(b, "pair_id")


def preservation_batch(spark, d) -> DataFrame:
    scored = vector.pair_similarity(_next_pairs(spark, d), "a", "b")
    return scored.select("pair_id", R("similarity").alias("similarity"), vector.preserved(R("similarity"))["is_valid"].alias("is_valid"))


def text_coherence(spark, d) -> DataFrame:
    pairs = _next_pairs(spark, d).withColumn("b", F.when(F.col("pair_id") % 3 == 0, F.concat(F.col("a"), F.lit(" "))).when(F.col("pair_id") % 3 == 1, "").otherwise(F.col("b")))
    return vector.text_coherence(pairs, "a", "b").select("pair_id", R("coherence").alias("coherence"))


def validation_stats(spark, d) -> DataFrame:
    found = analysis.validation_stats(preservation_batch(spark, d))
    return found.select("total", "passed", "failed", R("average_similarity").alias("average_similarity"), R("success_rate").alias("success_rate"))


def running_mean(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("similarity"))
    return analysis.running_mean(rows, ["user_id"], "event_id").select("user_id", "event_id", R("running_mean").alias("running_mean"))


def coherence_by_label(spark, d) -> DataFrame:
    return vector.mean_pairwise_cosine(table(spark, d, "embeddings"), ["label"], "embedding", 64).select("label", "n", R("coherence").alias("coherence"))


def item_scores(spark, d) -> DataFrame:
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    rows = inputs.context_items(spark, d)
    age = vector.recency(now, F.col("timestamp"))
    return rows.select("position", R(age).alias("recency"), R(vector.combined_score(F.col("relevance_score"), F.col("importance_score"), age)).alias("combined"), R(vector.retention_score(F.col("importance_score"), F.col("relevance_score"), F.col("usage_count"))).alias("retention"))


# --- context ----------------------------------------------------------------------------------------------------------
def build_context(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("item_id", F.regexp_extract("source", "[0-9]+", 0).cast("long"))
    pairs = docs.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")), "item_id").select(F.col("doc_id").alias("pair_id"), "item_id", "text", "query")
    scored = vector.pair_similarity(pairs, "text", "query").select("item_id", "text", F.col("pair_id").alias("position"), R("similarity").alias("relevance"))
    return context.build_context(scored, ["item_id"])


def context_prune(spark, d) -> DataFrame:
    return context.prune(inputs.context_items(spark, d), ["user_id"], 400).select("user_id", "position", F.col("kept_rank").cast("long").alias("kept_rank"))


def relevant_context(spark, d) -> DataFrame:
    rows = inputs.context_items(spark, d).withColumn("relevance", F.col("relevance_score"))
    return context.relevant_context(rows, ["user_id"], F.lit("2024-01-30 12:00:00").cast("timestamp"))


def document_context(spark, d) -> DataFrame:
    return context.document_context(inputs.context_items(spark, d), ["user_id"])


def context_stats(spark, d) -> DataFrame:
    return context.context_stats(inputs.context_items(spark, d), ["user_id"]).select("user_id", R("avg_relevance").alias("avg_relevance"), "n_items", "total_chars")


def section_index(spark, d) -> DataFrame:
    return context.section_index(inputs.context_items(spark, d), ["user_id"]).select("user_id", "section_name", F.array_join(F.col("items.position").cast("array<string>"), ",").alias("positions"))


def add_context(spark, d) -> DataFrame:
    rows = inputs.context_items(spark, d).select(F.col("user_id").alias("key"), F.col("position").alias("seq"), "content", "section_name", "importance_score", "context_type")
    return context.add_context(rows).withColumn("relevance_score", R("relevance_score"))


# --- analysis ---------------------------------------------------------------------------------------------------------
def _path_chunks(spark, d) -> DataFrame:
    return inputs.line_chunks(spark, d).withColumn("path", F.col("metadata.hierarchy_path"))


def _count_pairs(spark, d) -> DataFrame:
    return analysis.count_pairs(_path_chunks(spark, d), F.col("path")[0] != "R", ["doc_id"])


def element_counts(spark, d) -> DataFrame:
    return analysis.element_counts(_path_chunks(spark, d), ["doc_id"])


def preservation_report(spark, d) -> DataFrame:
    return analysis.preservation(_count_pairs(spark, d), ["doc_id"]).withColumn("rate", R("rate"))


def structure_change(spark, d) -> DataFrame:
    return analysis.structure_change(_count_pairs(spark, d), ["doc_id"]).withColumn("char_change_percent", R("char_change_percent"))


def quality_score(spark, d) -> DataFrame:
    return analysis.scored_pairs(_count_pairs(spark, d), ["doc_id"]).select("doc_id", R("quality_score").alias("quality_score"))


def quality_report(spark, d) -> DataFrame:
    return analysis.report(analysis.scored_pairs(_count_pairs(spark, d), ["doc_id"]), ["doc_id"])


def contribution_report(spark, d) -> DataFrame:
    used = table(spark, d, "documents").select(F.col("source").alias("section"), F.md5("text").alias("chunk_id"), F.col("text").alias("content"))
    return analysis.contributions(used)[1]


def contribution_summary(spark, d) -> DataFrame:
    used = table(spark, d, "documents").select(F.col("source").alias("section"), F.md5("text").alias("chunk_id"))
    return analysis.contribution_summary(used)


def preserved_elements(spark, d) -> DataFrame:
    pairs = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("\\begin{itemize}"), "text", F.lit("```")).alias("a"), F.concat("text", F.lit("```")).alias("b"))
    return analysis.preserved_elements(pairs, ["conv_id", "turn"], "a", "b").select("conv_id", "turn", "element", F.col("original").cast("long").alias("original"), F.col("final").cast("long").alias("final"), "preserved")


# --- combining --------------------------------------------------------------------------------------------------------
def combine_robust(spark, d) -> DataFrame:
    return inputs.keyed(combine.combine_robust(*inputs.trees(spark, d)))


def combine_merge(spark, d) -> DataFrame:
    return inputs.keyed(combine.combine_merge(*inputs.trees(spark, d)))


def combine_append(spark, d) -> DataFrame:
    return inputs.keyed(combine.combine_append(*inputs.trees(spark, d)))


def tree_overlap(spark, d) -> DataFrame:
    return inputs.keyed(combine.overlapping(*inputs.trees(spark, d)))


def tree_only_new(spark, d) -> DataFrame:
    return inputs.keyed(combine.only_new(*inputs.trees(spark, d)))


def tree_weave(spark, d) -> DataFrame:
    rows = combine.weave(*inputs.trees(spark, d))
    return rows.select("doc_id", F.array_join("path", " -> ").alias("path_key"), "content", "woven")


def tree_graft(spark, d) -> DataFrame:
    """Each nation's new group S1 moves to the next nation of its region, after the last to the first."""
    base, aug = inputs.trees(spark, d)
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    after = table(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_name").alias("own"), F.coalesce(F.lead("n_name").over(order), F.first("n_name").over(order)).alias("parent_path_key"))
    roots = combine.only_new(base, aug).where("element_at(path, -1) = 'S1'").withColumn("own", F.element_at("path", 1)).join(after, ["doc_id", "own"])
    moved = combine.graft(base, aug, roots.select("doc_id", F.array_join("path", " -> ").alias("path_key"), "parent_path_key")).withColumn("path_key", F.array_join("path", " -> "))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sort_key", "path_key"))
    return moved.select("doc_id", "path_key", "content", place.alias("place"))


# --- rendering and processing -----------------------------------------------------------------------------------------
def render_latex(spark, d) -> DataFrame:
    orphans = table(spark, d, "supplier").select((F.col("s_suppkey") % 5).cast("int").alias("doc_id"), F.col("s_suppkey").alias("chunk_id"), F.col("s_name").alias("content"))
    return render.render(inputs.region_nodes(spark, d), "latex", orphans)


def render_markdown(spark, d) -> DataFrame:
    return render.render(inputs.region_nodes(spark, d), "markdown")


def render_json(spark, d) -> DataFrame:
    return render.render(inputs.region_nodes(spark, d), "json")


def full_text(spark, d) -> DataFrame:
    return render.full_text(inputs.region_nodes(spark, d))


def transitions(spark, d) -> DataFrame:
    nodes = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.array(F.col("turn").cast("string")).alias("path"), F.array(F.col("turn").cast("int")).alias("sort_key"), F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("processed_content"))
    return process.sibling_pairs(nodes).select("doc_id", F.element_at("sort_key", 1).cast("long").alias("turn"), "has_pair")


def process_tree(spark, d) -> DataFrame:
    nodes = inputs.region_nodes(spark, d).withColumnRenamed("processed_content", "content")
    done = process.process_tree(nodes, effects.EchoModel())
    return done.select("doc_id", F.array_join("path", " -> ").alias("path_key"), "processed_content", F.array_join("issues", "; ").alias("issues"))


def process_node(spark, d) -> DataFrame:
    nodes = inputs.region_nodes(spark, d)
    rows = nodes.join(render.full_text(nodes), "doc_id")
    made = process.process_node(rows, ["ASIA"], effects.EchoModel(), F.col("text"))
    return made.select("doc_id", F.array_join("path", " -> ").alias("path_key"), "processed_content")


def polish(spark, d) -> DataFrame:
    rows = process.polish(inputs.region_nodes(spark, d), effects.EchoModel())
    return rows.select("doc_id", F.array_join("path", " -> ").alias("path_key"), "processed_content")


def embed_texts(spark, d) -> DataFrame:
    v = effects.embed(F.col("text"), effects.HashingEmbedder(64))
    return table(spark, d, "documents").select("doc_id", F.transform(v, lambda x: R(x)).alias("embedding"))


def circuit_breaker(spark, d) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    events = events.select("user_id", "event_id", (F.col("us") / 1e6).alias("at"), F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "allow").otherwise("success").alias("outcome"))
    return breaker.decisions(events, "user_id", ["event_id"], "at", "outcome", threshold=2, timeout=86400.0)


def recombined(spark, d) -> DataFrame:
    """Regions' trees, those of some roots taken for generative, put together with the generative first."""
    nodes = inputs.region_nodes(spark, d).withColumn("depth", F.size("path")).withColumn("generative", F.element_at("path", 1).like("A%")).withColumn("gen", mapping.generative_split(None))
    both = combine.recombine(nodes.where("gen"), nodes.where("not gen"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "sort_key"))
    return both.select("doc_id", F.array_join("path", " -> ").alias("path_key"), "part", place.alias("place"))


def content_weave(spark, d) -> DataFrame:
    """Contents of two trees woven by a model that echoes its prompt."""
    base, aug = inputs.trees(spark, d)
    found = combine.weave(base, aug.withColumn("content", F.when(F.size("path") == 1, "more of it").otherwise(F.col("content"))), process.woven(effects.EchoModel(), F.element_at("path", -1)))
    return found.select("doc_id", F.array_join("path", " -> ").alias("path_key"), "content", "woven")


def graft_replies(spark, d) -> DataFrame:
    """Parents of new subtrees by replies: each nation's groups under the nation before it, those of the first at the root."""
    base, aug = inputs.trees(spark, d)
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    before = table(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_name").alias("own"), F.coalesce(F.concat(F.lit(' "'), F.lag("n_name").over(order), F.lit('" ')), F.lit("root")).alias("reply"))
    replies = combine.only_new(base, aug).withColumn("own", F.element_at("path", 1)).join(before, ["doc_id", "own"]).select("doc_id", F.array_join("path", " -> ").alias("path_key"), "reply")
    return process.parents_of_replies(replies)


def dynamic_subsections(spark, d) -> DataFrame:
    """Turns of conversations in four sections, each split by replies that list the benchmark's items as titles."""
    items = table(spark, d, "benchmark").select((F.col("item_id") % 4).cast("int").alias("node_idx"), "item_id", "text")
    replies = items.groupBy("node_idx").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"])).alias("reply"))
    none = F.lit(None).cast("string")
    node = F.array(F.concat(F.lit("S"), F.col("node_idx").cast("string")))
    sections = items.select("node_idx").distinct().select(
        F.lit("t").alias("template"), "node_idx", node.alias("path"), node[0].alias("path_key"), F.lit(None).cast("int").alias("parent_idx"), F.lit(1).alias("depth"), node[0].alias("title"),
        F.array("node_idx").alias("sort_key"), none.alias("prompt"), none.alias("description"), F.lit(False).alias("generative"), F.lit(True).alias("dynamic_subsections"),
    )
    chunks = inputs.turn_chunks(spark, d)
    assigned = chunks.select("doc_id", "chunk_id", (F.col("chunk_id") % 4).alias("node_idx"), F.lit(1.0).alias("assignment_score"), F.lit("semantic").alias("method"))
    _, moved = mapping.dynamic_subsections(sections, process.titles_of_replies(replies), assigned, chunks)
    return moved.select("doc_id", "chunk_id", "node_idx", R("assignment_score").alias("score"))


def self_critique(spark, d) -> DataFrame:
    """Nodes of the second level written by a model that echoes, and criticised by it."""
    nodes = inputs.region_nodes(spark, d).where("size(path) = 2")
    made = process.refactor(F.col("processed_content"), F.array_join("path", " -> "), F.lit(""), effects.EchoModel(), critique=True)
    return nodes.select("doc_id", F.array_join("path", " -> ").alias("path_key"), made["fixed"].alias("text"))


def restructured(spark, d) -> DataFrame:
    docs = inputs.conversation_texts(spark, d, "% --- %s ---").withColumn("ext", F.lit(".tex"))
    made = restructure(docs, templates.skeleton(spark, "bitcoin_paper_hierarchical"), effects.EchoModel(), Options(fmt="markdown", polish=False))
    return made.select("doc_id", "document")


def mapped_groups(spark, d) -> DataFrame:
    sections = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("node_idx"), F.col("text").alias("description"))
    found = mapping.map_grouped(chunk.group_by_section(inputs.turn_chunks(spark, d)), sections)
    return found.select("doc_id", "chunk_id", F.coalesce("node_idx", F.lit(-1)).alias("node_idx"), R("assignment_score").alias("score"), "method")


def map_whole(spark, d) -> DataFrame:
    chunks = inputs.vectors(spark, d).withColumn("metadata", F.struct(F.array(F.concat(F.lit("k"), F.col("chunk_id").cast("string"))).alias("labels"), F.array(F.concat(F.lit("k"), ((F.col("chunk_id") * 7 + 3) % 11).cast("string"))).alias("refs")))
    found = mapping.map_chunks(chunks.withColumn("content", F.lit("")), inputs.vector_scores(spark, d), threshold=0.15)
    return found.select("doc_id", "chunk_id", F.coalesce("node_idx", F.lit(-1)).alias("node_idx"), "method", F.col("rank_in_node.group").alias("rank_group"), F.col("rank_in_node.anchor").alias("anchor"))


def regex_groups(spark, d) -> DataFrame:
    found = text.find_groups(F.col("content"), r"([A-Z])([a-z]+)")
    return inputs.documents(spark, d).select("doc_id", F.array_join(F.transform(found, lambda g: F.array_join(g, "+")), ",").alias("found"))


# --- files ------------------------------------------------------------------------------------------------------------
def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


def node_files(spark, d) -> DataFrame:
    """Nodes written as files of their own names, and read again."""
    at = _folder(spark)
    sinks.save_node_files(inputs.region_nodes(spark, d), at)
    return spark.read.text(f"{at}/processed_nodes", wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))


def final_documents(spark, d) -> DataFrame:
    """Rendered documents saved by their format, and read as sources."""
    at = _folder(spark)
    rows = render.render(inputs.region_nodes(spark, d), "json").select(F.col("document"))
    return spark.read.text(sinks.save_document(rows, at, "json")).select(F.col("value").alias("document"))


def session_log(spark, d) -> DataFrame:
    """Orders as log entries of a session each month, appended in two parts and read again."""
    at = _folder(spark)
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("session_id"), F.col("o_orderdate").cast("string").alias("ts"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message"))
    even = F.crc32("message") % 2 == 0
    sinks.append_log(rows.where(even), at)
    sinks.append_log(rows.where(~even), at)
    return spark.read.schema("ts string, message string, session_id string").json(f"{at}/processing_log").select("session_id", "ts", "message")


def stage_checkpoint(spark, d) -> DataFrame:
    return sinks.save_checkpoint(inputs.region_nodes(spark, d), _folder(spark), "nodes").select("doc_id", F.array_join("path", " -> ").alias("path_key"), F.col("processed_content").alias("content"))


def latest_documents(spark, d) -> DataFrame:
    sessions = table(spark, d, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("session_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"), F.col("props").alias("content"))
    return files.latest_documents(sessions)


def section_details(spark, d) -> DataFrame:
    nodes = inputs.region_nodes(spark, d).withColumn("path_key", F.array_join("path", " -> ")).withColumn("description", F.col("processed_content"))
    return templates.section_details(nodes, ["doc_id"])


def breaker_stream(spark, d) -> DataFrame:
    """The breaker on a stream of events, in batches, with its state between them."""
    at = _folder(spark)
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "allow").otherwise("success").alias("outcome"))
    events.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{at}/in")
    write = state.breaker_stream(stream, threshold=2, timeout=86400.0).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state")
    write.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(state.DECISIONS).parquet(f"{at}/out").select(F.col("key").cast("long").alias("user_id"), F.col("seq").alias("event_id"), "outcome", "allowed", "failures")


def _store_events(spark, d) -> DataFrame:
    """Events as what each user's context store is told: every fifth is a query."""
    kind = F.when(F.col("position") % 5 == 4, "ask").otherwise("add")
    return inputs.context_items(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("position").cast("long").alias("seq"), kind.alias("kind"), "content", "section_name", "importance_score", "context_type", (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6).alias("at"))


def _answers(found: DataFrame) -> DataFrame:
    return found.select(F.col("key").cast("long").alias("user_id"), F.col("seq").alias("event_id"), "kind", R("relevance_score").alias("relevance_score"), "context", "n_items", "total_chars", "uses", "in_section")


def store_answers(spark, d) -> DataFrame:
    """Additions to and queries of each user's context store, with the uses that the queries count."""
    return _answers(context.run_store(_store_events(spark, d), 300))


def store_stream(spark, d) -> DataFrame:
    """The same on a stream of events that arrive in three parts, with the stores as state between them."""
    at = _folder(spark)
    events = _store_events(spark, d)
    first, second = events.approxQuantile("seq", [1 / 3, 2 / 3], 0.01) or (0, 0)
    for k, part in enumerate((F.col("seq") <= first, (F.col("seq") > first) & (F.col("seq") <= second), F.col("seq") > second)):
        events.where(part).write.mode("append").parquet(f"{at}/in")
        stream = state.store_stream(spark.readStream.schema(events.schema).parquet(f"{at}/in"), 300)
        write = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state")
        write.foreachBatch(lambda rows, n, k=k: rows.write.mode("overwrite").parquet(f"{at}/out/batch={k}-{n}")).trigger(availableNow=True).start().awaitTermination()
    return _answers(spark.read.schema(context.ANSWERS).parquet(f"{at}/out"))


def validation_stream(spark, d) -> DataFrame:
    """Validation statistics on a stream of events by type."""
    at = _folder(spark)
    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), (F.col("value") >= 50).alias("is_valid"), F.col("value").alias("similarity"))
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    write = state.stats_stream(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state")
    write.foreachBatch(lambda found, n: found.write.mode("overwrite").parquet(f"{at}/out")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("key", "total", "passed", R("average_similarity").alias("average_similarity"))


QUERIES = [
    content_quality, chunk_paragraphs, section_marker_split, section_marker_chunks, chunks_grouped_by_section, ungrouped_chunks, markdown_chunks, paragraph_table_chunks, latex_chunks, long_chunk_split, tex_preprocess, section_markers,
    template_skeleton, skeleton_flatten, tree_outline, map_argmax, map_second, map_orphans, reference_edges, graph_boost, graph_corrections, neighbor_rescue, graph_rescue, cohesion, model_rescue, text_map, node_contents,
    format_enforce_latex, format_enforce_markdown, format_issues, section_summary, response_validation, regex_matches, prompts_and_replies, file_names, main_files, include_resolution, session_ids,
    preservation_batch, text_coherence, validation_stats, running_mean, coherence_by_label, item_scores, build_context, context_prune, relevant_context, document_context, context_stats, section_index, add_context,
    element_counts, preservation_report, structure_change, quality_score, quality_report, contribution_report, contribution_summary, preserved_elements,
    combine_robust, combine_merge, combine_append, tree_overlap, tree_only_new, tree_weave, tree_graft, render_latex, render_markdown, render_json, full_text, transitions, process_tree, polish, embed_texts, circuit_breaker, recombined, restructured,
    process_node, mapped_groups, map_whole, regex_groups, node_files, final_documents, session_log, stage_checkpoint, latest_documents, section_details, breaker_stream, validation_stream, store_answers, store_stream, content_weave, graft_replies, dynamic_subsections, self_critique,
]
