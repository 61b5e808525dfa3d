"""The worked example of the mapping, combination and budgets."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import effects, vector
from tessera.operators import analysis, chunk, combine, context, mapping, process, render

SCORES = [(0.70, 0.10, 0.05), (0.20, 0.28, 0.10), (0.10, 0.65, 0.00), (0.25, 0.15, 0.10), (0.10, 0.20, 0.05), (0.00, 0.40, 0.10), (0.10, 0.10, 0.10), (0.35, 0.00, 0.10), (0.10, 0.00, 0.20), (0.05, 0.10, 0.20)]
LABELS = {0: "L0", 2: "L2", 5: "L5"}
REFS = {1: "L0", 3: "L2", 6: "L5"}


@pytest.fixture(scope="module")
def example(spark):
    chunks = spark.createDataFrame(
        [(1, k, "paragraph", f"c{k}", "x", ([], [LABELS[k]] if k in LABELS else [], [], [REFS[k]] if k in REFS else [], None, None)) for k in range(10)],
        "doc_id long, chunk_id int, type string, content string, parent_section string, metadata struct<hierarchy_path:array<string>,labels:array<string>,citations:array<string>,refs:array<string>,caption:string,source:string>",
    )
    scores = spark.createDataFrame([(1, c, s, v) for c, row in enumerate(SCORES) for s, v in enumerate(row)], "doc_id long, chunk_id int, node_idx int, score double")
    return chunks, scores


def placed(df):
    found = {}
    for r in df.orderBy("rank_in_node").collect():
        found.setdefault(r["node_idx"], []).append(r["chunk_id"])
    return found


def test_map_chunks(example):
    chunks, scores = example
    assert placed(mapping.map_chunks(chunks, scores)) == {0: [0, 1, 7], 1: [2, 3, 4, 5, 6], None: [8, 9]}
    assert placed(mapping.map_chunks(chunks, scores, literal=True)) == {0: [0, 7], 1: [2, 3, 4, 5, 6], None: [1, 8, 9]}


def test_model_pass(spark, example):
    chunks, scores = example
    sections = spark.createDataFrame([(k, f"S{k}") for k in range(3)], "node_idx int, path_key string")
    replies = spark.createDataFrame([(1, 8, " S2 "), (1, 9, "UNCATEGORIZED")], "doc_id long, chunk_id int, reply string")
    got = mapping.map_chunks(chunks, scores, sections, replies)
    # 8 is placed by the model; 9 has no second neighbour
    assert placed(got)[2] == [8] and placed(got)[None] == [9]
    contents = {r["node_idx"]: r["node_content"] for r in mapping.node_contents(chunks, got).collect()}
    assert contents[0] == "c0\n\nc1\n\nc7"


def test_nothing_to_map(example):
    chunks, scores = example
    assert mapping.map_chunks(chunks.limit(0), scores.limit(0)).count() == 0


def test_dynamic_subsections(spark):
    sections = spark.createDataFrame([("t", 0, ["T"], "T", None, 1, "T", [0], "p", "d", False, True)], "template string, node_idx int, path array<string>, path_key string, parent_idx int, depth int, title string, sort_key array<int>, prompt string, description string, generative boolean, dynamic_subsections boolean")
    titles = spark.createDataFrame([(0, "apples", 0), (0, "pears", 1)], "node_idx int, title string, ord int")
    chunks = spark.createDataFrame([(1, 0, "about pears"), (1, 1, "some apples"), (1, 2, "neither")], "doc_id long, chunk_id int, content string")
    assigned = chunks.select("doc_id", "chunk_id", F.lit(0).alias("node_idx"), F.lit(1.0).alias("assignment_score"), F.lit("semantic").alias("method"))
    made, moved = mapping.dynamic_subsections(sections, titles, assigned, chunks)
    assert [r["path_key"] for r in made.orderBy("node_idx").collect()] == ["T", "T -> apples", "T -> pears"]
    assert {r["chunk_id"]: r["node_idx"] for r in moved.collect()} == {0: 2, 1: 1, 2: 1}


def tree(spark, *nodes):
    return spark.createDataFrame([(1, p.split("/"), k, c) for p, k, c in nodes], "doc_id long, path array<string>, sort_key array<int>, content string")


def test_robust_combine(spark):
    base = tree(spark, ("A", [0], "a"), ("A/A1", [0, 0], "base"), ("B", [1], ""))
    aug = tree(spark, ("A", [0], "a2"), ("A/A1", [0, 0], "other"), ("A/A2", [0, 1], "new"), ("C", [1], ""), ("C/C1", [1, 0], "c1"))
    got = [("/".join(r["path"]), r["content"]) for r in combine.combine_robust(base, aug).orderBy("sort_key").collect()]
    assert got == [("A", "a"), ("A/A1", "base"), ("A/A2", "new"), ("B", ""), ("C", ""), ("C/C1", "c1")]
    woven = {"/".join(r["path"]): r["content"] for r in combine.combine_smart(base, aug).collect()}
    assert woven["A"] == "a\n\na2" and woven["C/C1"] == "c1" and len(woven) == 6
    parents = spark.createDataFrame([(1, "C", "B")], "doc_id long, path_key string, parent_path_key string")
    assert {"/".join(r["path"]) for r in combine.graft(base, aug, parents).collect()} == {"A", "A/A1", "A/A2", "B", "B/C", "B/C/C1"}


def test_counts_of_two_papers(spark):
    first = tree(spark, *[(t, [k], "x") for k, t in enumerate(["Abstract", "Introduction", *"abcdefghij", "Conclusion"])])
    second = tree(spark, *[(t, [k], "y") for k, t in enumerate(["Abstract", "Introduction", *"klmnopq", "Conclusion"])])
    assert combine.combine_merge(first, second).count() == 20
    assert combine.combine_append(first, second).count() == 23


@pytest.mark.parametrize(("limit", "length"), [(100, 72), (130, 130), (160, 141)])
def test_context_budget(spark, limit, length):
    docs = spark.createDataFrame([(1, 0, 0.9, "a" * 40), (1, 1, 0.9, "b" * 30), (1, 2, 0.5, "c" * 60), (1, 3, 0.1, "d" * 5), (1, 4, 1.0, "  ")], "q long, position long, relevance double, text string")
    assert len(context.build_context(docs, ["q"], max_length=limit).first()["context"]) == length


def test_single_long_document_is_cut(spark):
    docs = spark.createDataFrame([(1, 0, 0.9, "x" * 6000)], "q long, position long, relevance double, text string")
    got = context.build_context(docs, ["q"], max_length=500).first()["context"]
    assert len(got) == 500 and got.endswith("...")


def test_prune(spark):
    items = spark.createDataFrame([("k", 0, "a" * 50, 1.0, 0.2, 0), ("k", 1, "b" * 40, 0.5, 0.9, 5), ("k", 2, "c" * 30, 0.8, 0.5, 1)], "key string, position long, content string, importance_score double, relevance_score double, usage_count int")
    assert [r["position"] for r in context.prune(items, ["key"], 100).orderBy("kept_rank").collect()] == [1, 2]
    assert context.prune(items, ["key"], 120).count() == 3
    assert context.prune(items, ["key"], 30).count() == 0


def test_store_is_bounded(spark):
    rows = spark.createDataFrame([("k", i, f"text number {i} " * 5, "s", 0.1 * (i % 7), "t") for i in range(60)], "key string, seq long, content string, section_name string, importance_score double, context_type string")
    got = context.add_context(rows, 400).orderBy("seq").collect()
    store = context.ContextStore(max_length=400)
    for r, x in zip(got, range(60), strict=True):
        item = store.add(f"text number {x} " * 5, "s", 0.1 * (x % 7), "t")
        assert r["relevance_score"] == pytest.approx(item["relevance_score"]) and r["n_items"] == len(store.items) and r["total_chars"] <= 400


def test_quality_score(spark):
    pairs = spark.createDataFrame([(1, (1, 0, 0, 2, 0, 4, 9, 1000), (1, 1, 0, 2, 0, 3, 9, 1300))], "doc_id long, original struct<sections:long,subsections:long,subsubsections:long,figure:long,table:long,equation:long,chunks:long,chars:long>, processed struct<sections:long,subsections:long,subsubsections:long,figure:long,table:long,equation:long,chunks:long,chars:long>")
    assert analysis.scored_pairs(pairs, ["doc_id"]).first()["quality_score"] == pytest.approx(82.5)
    assert analysis.scored_pairs(pairs, ["doc_id"], augmented=True).first()["quality_score"] == pytest.approx(100.0)
    assert "Quality Score: 82.5/100" in analysis.report(analysis.scored_pairs(pairs, ["doc_id"]), ["doc_id"]).first()["report"]


def test_transitions(spark):
    nodes = spark.createDataFrame([(1, [t], [k], c) for k, (t, c) in enumerate([("a", "X"), ("b", ""), ("c", "Y"), ("d", "Z")])], "doc_id long, path array<string>, sort_key array<int>, processed_content string")
    assert [r["path"] for r in process.sibling_pairs(nodes).where("has_pair").collect()] == [["d"]]
    got = {r["path"][0]: r["processed_content"] for r in process.add_transitions(nodes, effects.EchoModel()).collect()}
    assert got["d"].endswith("\n\nZ") and got["c"] == "Y"


def test_parents_are_processed_first(spark):
    nodes = spark.createDataFrame([(1, ["A"], [0], "parent"), (1, ["A", "B"], [0, 0], "child"), (1, ["C"], [1], "")], "doc_id long, path array<string>, sort_key array<int>, content string")
    got = {tuple(r["path"]): r["processed_content"] for r in process.process_tree(nodes, effects.EchoModel()).collect()}
    assert "parent" in got["A",] and "Parent section:\nEdit the text of 'A'" in got["A", "B"] and got["C",] == ""


def test_render(spark):
    nodes = spark.createDataFrame([(1, ["A"], [0], "a"), (1, ["A", "B"], [0, 0], None), (1, ["C"], [1], "c")], "doc_id long, path array<string>, sort_key array<int>, processed_content string")
    orphans = spark.createDataFrame([(1, 5, "late"), (1, 3, "early")], "doc_id long, chunk_id int, content string")
    got = render.render(nodes, "latex", orphans).first()["document"]
    assert got.endswith("\\section{A}\na\n\\subsection{B}\n\\section{C}\nc\n\n\\section*{Uncategorized Content}\nearly\n\nlate\n\\end{document}")
    assert render.render(nodes, "markdown").first()["document"] == "# A\na\n## B\n# C\nc"
    assert '"title":"B"' in render.render(nodes, "json").first()["document"]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (3, [1.0, 0.0])], "g long, v array<double>")
    got = {r["g"]: r["coherence"] for r in vector.mean_pairwise_cosine(rows, ["g"], "v", 2).collect()}
    assert got[1] == pytest.approx((0 + 2 * 0.5**0.5) / 3) and got[2] == 1.0 and got[3] == pytest.approx(0.0)
    pairs = spark.createDataFrame([(1, "same text", "same text "), (2, "", "x"), (3, "a b", "c d"), (4, "a b", "a c")], "pair_id long, a string, b string")
    got = {r["pair_id"]: r["coherence"] for r in vector.text_coherence(pairs, "a", "b").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: pytest.approx(0.5)}
