"""Chunks onto sections (M1-M8, J1-J7): similarity, reference graph, boost, model pass, cohesion.

Inputs are chunks (doc_id, chunk_id, ...), a section table that is small by nature (a template; its size is checked) and
scores: a table (doc_id, chunk_id, node_idx, score) of the pairs that don't score 0, or ``DenseScores``, which are worked out
where they are needed.  Everything is keyed by doc_id; windows never span documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vector import boosted, term_counts, text_norms
from tessera.materialize import materialized
from tessera.operators.dense import DenseScores

# Least score of an assignment, the margin of a confident one, and what an edge adds.
THRESHOLD = 0.3
CONFIDENT = 0.3
BOOST = 0.5
#: Sections up to which a template is sent to every task.
MAX_SECTIONS = 10_000


def _template(sections: DataFrame) -> DataFrame:
    """A section table marked for a broadcast, after a check that it has the size of a template."""
    n = sections.count()
    if n > MAX_SECTIONS:
        raise ValueError(f"{n} sections; a template has at most {MAX_SECTIONS}")
    return F.broadcast(sections)


@dataclass
class ScoreTable:
    """Scores that are a table; a pair that isn't in it scores 0."""

    scores: DataFrame

    def best(self) -> DataFrame:
        return best_section(self.scores)

    def of(self, pairs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        return pairs.join(self.scores.select("doc_id", "chunk_id", "node_idx", "score"), ["doc_id", "chunk_id", "node_idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


Scores = DataFrame | ScoreTable | DenseScores


def _scorer(scores: Scores) -> ScoreTable | DenseScores:
    return ScoreTable(scores) if isinstance(scores, DataFrame) else scores


#: Bytes of a template's terms up to which they are sent to every task.
TERM_BYTES = 64 << 20


def text_scores(chunks: DataFrame, sections: DataFrame, text: str = "content", section_text: str = "description") -> DataFrame:
    """Cosine of term counts, for the pairs with a common term (J1 without a model); other pairs score 0 and aren't listed."""
    sections = _template(sections)
    keyed = chunks.withColumn("_k", F.struct("doc_id", "chunk_id"))
    a, b = term_counts(keyed, "_k", text), term_counts(sections, "node_idx", section_text).withColumnRenamed("id", "node_idx").withColumnRenamed("tf", "tf2")
    size = b.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    dots = a.join(F.broadcast(b) if size <= TERM_BYTES else b, "term").groupBy("id", "node_idx").agg(F.sum(F.col("tf") * F.col("tf2")).alias("dot"))
    norms = text_norms(b.select(F.col("node_idx").alias("id"), "term", F.col("tf2").alias("tf"))).select(F.col("id").alias("node_idx"), F.col("norm").alias("norm2"))
    scored = dots.join(text_norms(a), "id").join(F.broadcast(norms), "node_idx")
    return scored.select("id.doc_id", "id.chunk_id", "node_idx", (F.col("dot") / (F.col("norm") * F.col("norm2"))).alias("score"))


def reference_edges(chunks: DataFrame, literal: bool = False) -> DataFrame:
    """Edges (doc_id, src, dst, ref_pos) from chunks that refer to a label to the last chunk that has it.

    An edge that occurs twice keeps its first reference.  With ``literal`` references to chunk 0 are ignored.
    """
    labels = chunks.select("doc_id", "chunk_id", F.explode("metadata.labels").alias("label")).groupBy("doc_id", "label").agg(F.max("chunk_id").alias("dst"))
    refs = chunks.select("doc_id", F.col("chunk_id").alias("src"), F.posexplode("metadata.refs").alias("ref_pos", "label"))
    edges = refs.join(labels, ["doc_id", "label"])
    return (edges.where("dst <> 0") if literal else edges).groupBy("doc_id", "src", "dst").agg(F.min("ref_pos").alias("ref_pos"))


def best_section(scores: DataFrame) -> DataFrame:
    """Rows (doc_id, chunk_id, node_idx, score) of each chunk's best section; of equal ones the first."""
    best = F.max(F.struct(F.col("score"), (-F.col("node_idx")).alias("n"))).alias("m")
    return scores.groupBy("doc_id", "chunk_id").agg(best).select("doc_id", "chunk_id", (-F.col("m.n")).cast("int").alias("node_idx"), F.col("m.score").alias("score"))


def boost_corrections(best: DataFrame, scores: Scores, edges: DataFrame, threshold: float = THRESHOLD, boost: float = BOOST, chunks: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, chunk_id, node_idx, times, score): the pairs whose score a reference raises, and to what.

    A reference to a chunk that is confidently placed raises the section of that one.  The confident are fixed before any
    boost; each edge counts once, two edges into a section twice, up to 1.  There are at most as many pairs as edges, and only
    they are shuffled, with the vectors of ``chunks``, those that refer to others, where scores are dense.
    """
    sure = best.where(F.col("score") >= threshold + CONFIDENT).select("doc_id", F.col("chunk_id").alias("dst"), "node_idx")
    times = edges.join(sure, ["doc_id", "dst"]).groupBy("doc_id", F.col("src").alias("chunk_id"), "node_idx").agg(F.count(F.lit(1)).alias("times"))
    found = _scorer(scores).of(times, chunks)
    return found.select("doc_id", "chunk_id", "node_idx", "times", boosted(F.col("score"), F.col("times"), boost).alias("score"))


def graph_boost(scores: Scores, edges: DataFrame, threshold: float = THRESHOLD, boost: float = BOOST, chunks: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, chunk_id, node_idx, score) of each chunk's best section after the boost.

    A boost never lowers a score: so the best is the better of what was best and of what was raised, and no other score is
    needed.  What was best is written once, as the boost starts from it.
    """
    best = materialized(_scorer(scores).best().select("doc_id", "chunk_id", "node_idx", "score"))
    raised = boost_corrections(best, scores, edges, threshold, boost, chunks).drop("times")
    return best_section(best.unionByName(raised))


def assign(chunks: DataFrame, scores: Scores, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, chunk_id, node_idx, assignment_score, method): the best section from the threshold on, else orphan."""
    if isinstance(scores, DenseScores):  # every chunk has its row
        return placed(scores.best(), threshold)
    return placed(chunks.select("doc_id", "chunk_id").join(_scorer(scores).best(), ["doc_id", "chunk_id"], "left"), threshold)


def placed(best: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Assignments from each chunk's best section (doc_id, chunk_id, node_idx, score), null where there is none."""
    there = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return best.select("doc_id", "chunk_id", F.when(there, F.col("node_idx")).alias("node_idx"), F.coalesce("score", F.lit(0.0)).alias("assignment_score"), F.when(there, "semantic").otherwise("orphan").alias("method"))


def assign_boosted(chunks: DataFrame, scores: Scores, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Assignments after the boost; ``chunks`` are those of the scores, and say in ``metadata.refs`` which refer to others."""
    best = graph_boost(scores, edges, threshold, chunks=_referring(scores))
    rows = chunks.select("doc_id", "chunk_id").join(best, ["doc_id", "chunk_id"], "left")
    return placed(rows, threshold)


def _referring(scores: Scores) -> DataFrame | None:
    """Of dense scores' chunks those that refer to others, if they say so."""
    if isinstance(scores, DenseScores) and "metadata" in scores.chunks.columns:
        return scores.chunks.where(F.size("metadata.refs") > 0)
    return None


def model_rescue(assigned: DataFrame, replies: DataFrame, sections: DataFrame) -> DataFrame:
    """Orphans placed by a model's reply (doc_id, chunk_id, reply) that is a valid path (M5, J7); others stay orphans."""
    paths = sections.select(F.col("path_key").alias("_p"), F.col("node_idx").alias("_n"))
    found = replies.select("doc_id", "chunk_id", F.trim("reply").alias("_p")).join(_template(paths), "_p").select("doc_id", "chunk_id", "_n")
    return _rescued(assigned, found, "llm")


def _rescued(assigned: DataFrame, found: DataFrame, method: str) -> DataFrame:
    rows = assigned.join(found, ["doc_id", "chunk_id"], "left")
    here = F.col("node_idx").isNull() & F.col("_n").isNotNull()
    return rows.select("doc_id", "chunk_id", F.coalesce("node_idx", "_n").alias("node_idx"), "assignment_score", F.when(here, method).otherwise(F.col("method")).alias("method"))


def neighbor_rescue(assigned: DataFrame) -> DataFrame:
    """Orphans (doc_id, chunk_id, _n) whose neighbours by id are both placed in the same section (J4).  Rescues don't cascade."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    near = assigned.withColumn("a", F.lag("node_idx").over(order)).withColumn("b", F.lead("node_idx").over(order)).withColumn("ia", F.lag("chunk_id").over(order)).withColumn("ib", F.lead("chunk_id").over(order))
    return near.where("node_idx is null and a = b and ia = chunk_id - 1 and ib = chunk_id + 1").select("doc_id", "chunk_id", F.col("a").alias("_n"))


def graph_rescue(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphans (doc_id, chunk_id, _n) that refer to a placed chunk, by their first such reference."""
    orphans = assigned.where("node_idx is null").select("doc_id", F.col("chunk_id").alias("src"))
    placed = assigned.where("node_idx is not null").select("doc_id", F.col("chunk_id").alias("dst"), "node_idx")
    found = edges.join(orphans, ["doc_id", "src"]).join(placed, ["doc_id", "dst"])
    return found.groupBy("doc_id", F.col("src").alias("chunk_id")).agg(F.min_by("node_idx", F.struct("ref_pos", "dst")).alias("_n"))


def cohesion(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphans rescued by their neighbours, else by the graph, both from the same snapshot."""
    near = neighbor_rescue(assigned)
    far = graph_rescue(assigned, edges).join(near, ["doc_id", "chunk_id"], "left_anti")
    return _rescued(_rescued(assigned, near, "neighbor"), far, "graph")


def with_rank(assigned: DataFrame) -> DataFrame:
    """Assignments with ``rank_in_node`` (group, anchor, chunk_id), by which a section's chunks are ordered.

    Placed by score: by id.  Rescued by neighbours: right after the predecessor.  By a model, then by the graph: at the end.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    own = lambda m: F.when(m == "llm", 1).when(m == "graph", 2).otherwise(0)
    before = F.lag("method").over(order)
    group = F.when(F.col("method") == "neighbor", own(before)).otherwise(own(F.col("method")))
    anchor = F.when(F.col("method") == "neighbor", F.col("chunk_id") - 1).otherwise(F.col("chunk_id"))
    return assigned.withColumn("rank_in_node", F.struct(group.cast("int").alias("group"), anchor.cast("int").alias("anchor"), F.col("chunk_id").cast("int").alias("chunk_id")))


def map_chunks(chunks: DataFrame, scores: Scores, sections: DataFrame | None = None, replies: DataFrame | None = None, threshold: float = THRESHOLD, literal: bool = False) -> DataFrame:
    """Assignments with ranks: boost, best section, model pass if there are replies, cohesion (M2).  No chunks give none."""
    edges = reference_edges(chunks, literal)
    assigned = assign_boosted(chunks, scores, edges, threshold)
    if replies is not None:
        assigned = model_rescue(assigned, replies, sections)
    return with_rank(cohesion(assigned, edges))


def map_grouped(grouped: DataFrame, sections: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Chunks grouped by section mapped in a single pass by their terms (M7, M3)."""
    from tessera.operators.chunk import ungroup

    chunks = ungroup(grouped)
    return assign(chunks, text_scores(chunks, sections), threshold)


def node_contents(chunks: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows (doc_id, node_idx, node_content): a section's chunks in order, a blank line between (F9).  Orphans are left out."""
    joined = chunks.select("doc_id", "chunk_id", "content").join(assigned.where("node_idx is not null"), ["doc_id", "chunk_id"])
    return joined.groupBy("doc_id", "node_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_node", "content"))), lambda x: x["content"]), "\n\n").alias("node_content"))


def dynamic_subsections(sections: DataFrame, titles: DataFrame, assigned: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A template with new nodes under dynamic ones, and the assignments with those nodes' chunks mapped to them (M8).

    ``titles``: (node_idx, title, ord), from a model's list.  Chunks go to the new node whose title they are most alike, the
    first of equal ones; a node without titles keeps its chunks.
    """
    top = sections.agg(F.max("node_idx").alias("m")).first()["m"] or 0
    order = Window.orderBy("node_idx", "ord")  # a template's new nodes, bounded by its size
    new = titles.withColumn("new_idx", (F.row_number().over(order) + top).cast("int"))
    parents = sections.select("node_idx", "template", "path", "sort_key", "depth", "prompt", "generative")
    made = new.join(parents, "node_idx").select(
        "template", F.col("new_idx").alias("node_idx"), F.concat("path", F.array("title")).alias("path"), F.col("node_idx").alias("parent_idx"), (F.col("depth") + 1).alias("depth"), "title",
        F.concat("sort_key", F.array(F.col("ord").cast("int"))).alias("sort_key"), "prompt", F.col("title").alias("description"), "generative",
    )
    made = made.withColumn("path_key", F.array_join("path", " -> ")).withColumn("dynamic_subsections", F.lit(False)).select(*sections.columns)
    theirs = assigned.join(new.select("node_idx").distinct(), "node_idx", "left_semi").select("doc_id", "chunk_id", F.col("node_idx").alias("parent_idx"))
    scored = text_scores(chunks.join(theirs, ["doc_id", "chunk_id"], "left_semi"), made)
    every = theirs.join(_template(made.select("node_idx", "parent_idx")), "parent_idx").join(scored, ["doc_id", "chunk_id", "node_idx"], "left").select("doc_id", "chunk_id", "node_idx", F.coalesce("score", F.lit(0.0)).alias("score"))
    best = best_section(every).select("doc_id", "chunk_id", F.col("node_idx").alias("_n"), F.col("score").alias("_s"))
    moved = assigned.join(best, ["doc_id", "chunk_id"], "left")
    moved = moved.withColumn("node_idx", F.coalesce("_n", "node_idx")).withColumn("assignment_score", F.coalesce("_s", "assignment_score")).select(*assigned.columns)
    return sections.unionByName(made), moved


def generative_split(sections: DataFrame) -> Column:
    """True for nodes under a generative root (F4); to be used on a section table: its path's first title decides."""
    return F.first(F.when(F.col("depth") == 1, F.col("generative")), ignorenulls=True).over(Window.partitionBy(F.element_at("path", 1)))
