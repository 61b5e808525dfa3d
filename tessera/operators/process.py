"""Sections processed by a model, and polished."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.effects import LanguageModel, ask
from tessera.functions.text import comma_list, enforce_format, head, polished_part, render_prompt, system_prompt, tail
from tessera.materialize import materialized
from tessera.operators.render import full_text
from tessera.schema import PATH_SEPARATOR

#: Excerpt lengths of prompts.
TERMS_EXCERPT, TRANSITION_EXCERPT = 4000, 300
CONTEXT = "A peer-to-peer electronic cash system."


def refactor(content: Column, path: Column, parent: Column, model: LanguageModel, context: str = CONTEXT, fmt: str = "latex", critique: bool = False) -> Column:
    """struct(fixed, issues) of the model's text for a section (L2); null if the model fails.  ``critique``: a second pass (L3)."""
    prompt = render_prompt("hierarchical_refactor", node_path=path, global_context=F.lit(context), parent_context=parent, node_content=content)
    text = ask(F.when(content != "", prompt), model, system_prompt(fmt))["text"]
    if critique:
        text = polished_part(ask(render_prompt("self_critique_and_refine", node_path=path, refactored_text=text), model)["text"])
    return enforce_format(text, fmt)


def process_tree(nodes: DataFrame, model: LanguageModel, context: str = CONTEXT, fmt: str = "latex", generative: Column | None = None, critique: bool = False) -> DataFrame:
    """Nodes (doc_id, path, sort_key, content) with processed_content and issues, parents before children (L1).

    One pass for each depth: a node's prompt has its parent's processed text.  Nodes without content have an empty one.
    ``generative``: what every node is written from instead of its content (F4).
    """
    rows = nodes.withColumn("_in", F.coalesce(generative if generative is not None else F.col("content"), F.lit("")))
    depths = sorted(r[0] for r in rows.select(F.size("path").alias("d")).distinct().collect())
    done: DataFrame | None = None
    for d in depths:
        level = rows.where(F.size("path") == d)
        if done is None:
            level = level.withColumn("_parent", F.lit(""))
        else:
            above = done.select("doc_id", F.col("path").alias("_up"), F.col("processed_content").alias("_parent"))
            level = level.withColumn("_up", F.slice("path", 1, d - 1)).join(above, ["doc_id", "_up"], "left").drop("_up").withColumn("_parent", F.coalesce("_parent", F.lit("")))
        made = refactor(F.col("_in"), F.array_join("path", PATH_SEPARATOR), F.col("_parent"), model, context, fmt, critique)
        level = level.withColumn("_r", made).withColumn("processed_content", F.when(F.col("_in") == "", F.lit("")).otherwise(F.coalesce("_r.fixed", F.lit("")))).withColumn("issues", F.coalesce("_r.issues", F.array().cast("array<string>"))).drop("_r", "_parent")
        # what a model said is kept: the next depth must not ask again
        level = materialized(level)
        done = level if done is None else done.unionByName(level)
    return (done if done is not None else rows.withColumn("processed_content", F.lit("")).withColumn("issues", F.array().cast("array<string>"))).drop("_in")


def process_node(nodes: DataFrame, path: list[str], model: LanguageModel, whole: Column, context: str = CONTEXT, fmt: str = "latex") -> DataFrame:
    """``nodes`` (with processed_content) with the one of this path in each document written anew from ``whole``, usually the
    document's text, by its own prompt and without a parent (L4); a failed call leaves an empty text."""
    here = F.col("path") == F.array(*[F.lit(p) for p in path])
    made = refactor(F.when(here, whole).otherwise(F.lit("")), F.array_join("path", PATH_SEPARATOR), F.lit("N/A"), model, context, fmt)
    return nodes.withColumn("_r", made).withColumn("processed_content", F.when(here, F.coalesce("_r.fixed", F.lit(""))).otherwise(F.col("processed_content"))).select(*nodes.columns)


def key_terms(nodes: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows (doc_id, terms): a document's chief terms by a model, from the start of its text."""
    reply = ask(render_prompt("term_extraction", full_text_excerpt=head(F.col("text"), TERMS_EXCERPT)), model)["text"]
    return full_text(nodes).select("doc_id", comma_list(reply).alias("terms"))


def standardize_terms(nodes: DataFrame, model: LanguageModel, literal: bool = False) -> DataFrame:
    """Nodes rewritten to use their document's terms (G2); a failed call leaves the text.  ``literal``: the first node only."""
    rows = nodes.join(key_terms(nodes, model), "doc_id", "left")
    prompt = render_prompt("term_standardization", key_terms_list=F.array_join("terms", ", "), text_content=F.col("processed_content"))
    use = (F.col("processed_content") != "") & (F.size("terms") > 0)
    if literal:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("sort_key")))
        use = use & (F.col("_k") == 1)
    return rows.withColumn("processed_content", F.coalesce(ask(F.when(use, prompt), model)["text"], "processed_content")).select(*nodes.columns)


def sibling_pairs(nodes: DataFrame) -> DataFrame:
    """Nodes with the title and end of the sibling before them if both have content (J13); an empty sibling parts its neighbours."""
    order = Window.partitionBy("doc_id", F.slice("path", F.lit(1), F.size("path") - 1)).orderBy("sort_key")
    before = F.lag("processed_content").over(order)
    title = F.lag(F.element_at("path", -1)).over(order)
    return nodes.withColumn("_before", before).withColumn("_title", title).withColumn("has_pair", F.coalesce((F.col("_before") != "") & (F.col("processed_content") != ""), F.lit(False)))


def add_transitions(nodes: DataFrame, model: LanguageModel) -> DataFrame:
    """Nodes with a sentence that leads over from the sibling before."""
    rows = sibling_pairs(nodes)
    prompt = render_prompt(
        "section_transition", prev_section_title=F.col("_title"), prev_section_ending=tail(F.col("_before"), TRANSITION_EXCERPT), current_section_title=F.element_at("path", -1),
        current_section_beginning=head(F.col("processed_content"), TRANSITION_EXCERPT),
    )
    said = ask(F.when(F.col("has_pair"), prompt), model)["text"]
    return rows.withColumn("_said", said).withColumn("processed_content", F.when(F.col("_said").isNotNull(), F.concat("_said", F.lit("\n\n"), "processed_content")).otherwise(F.col("processed_content"))).select(*nodes.columns)


def polish(nodes: DataFrame, model: LanguageModel, fmt: str | None = None) -> DataFrame:
    """Terms, then transitions (G1); ``fmt``: the result is brought to a format again."""
    rows = add_transitions(standardize_terms(nodes, model), model)
    return rows.withColumn("processed_content", enforce_format(F.col("processed_content"), fmt)["fixed"]) if fmt else rows


def split_reply(content: Column, model: LanguageModel) -> Column:
    """A model's markers of a long paragraph (P8), for ``chunk.markers_of_reply``; null if it fails."""
    return ask(render_prompt("semantic_split_paragraph", text_content=content), model)["text"]


def orphan_replies(orphans: DataFrame, details: Column, model: LanguageModel) -> DataFrame:
    """Rows (doc_id, chunk_id, reply): the section a model names for each orphan (M5)."""
    reply = ask(render_prompt("llm_map_chunk_to_section", section_details=details, chunk_content=F.col("content")), model)["text"]
    return orphans.select("doc_id", "chunk_id", reply.alias("reply"))


def woven(model: LanguageModel, title: Column):
    """A weaving of two contents by a model for ``combine.weave``; its failure appends (B2)."""

    def how(base: Column, aug: Column) -> Column:
        said = ask(render_prompt("content_weaving", section_name=title, original_content=base, augmentation_content=aug), model)["text"]
        return F.coalesce(said, F.concat(base, F.lit("\n\n"), aug))

    return how


def grafting_prompts(new_roots: DataFrame, outline: DataFrame) -> DataFrame:
    """``new_roots`` (doc_id, path_key, path, description) with ``prompt``: where in a tree's outline (doc_id, text) each belongs."""
    prompt = render_prompt("structure_grafting_location", tree_summary=F.col("text"), new_section_title=F.element_at("path", -1), new_section_description=F.coalesce("description", F.lit("")))
    return new_roots.join(outline, "doc_id").withColumn("prompt", prompt)


def parents_of_replies(replies: DataFrame) -> DataFrame:
    """Rows (doc_id, path_key, parent_path_key) of replies (doc_id, path_key, reply) that name a parent; ROOT gives an empty one."""
    from tessera.functions.text import path_of_reply

    return replies.select("doc_id", "path_key", F.array_join(path_of_reply(F.col("reply")), PATH_SEPARATOR).alias("parent_path_key"))


def grafting_parents(new_roots: DataFrame, outline: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows (doc_id, path_key, parent_path_key) by a model from a tree's outline."""
    return parents_of_replies(grafting_prompts(new_roots, outline).withColumn("reply", ask(F.col("prompt"), model)["text"]))


def titles_of_replies(replies: DataFrame) -> DataFrame:
    """Rows (node_idx, title, ord) of replies (node_idx, reply) that are JSON lists of titles (M8); other replies give none."""
    from tessera.functions.text import json_titles

    return replies.select("node_idx", F.posexplode(json_titles(F.col("reply"))).alias("ord", "title")).where("title is not null and title <> ''").select("node_idx", "title", "ord")
