"""The whole way of a document."""

from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions.effects import EchoModel
from tessera.plans.restructure import Options, analyse, restructure
from tessera.sources import templates

TEMPLATE = {
    "Summary": {"generative": True, "description": "overview"},
    "1. Coins": {"description": "digital coins and signatures", "subsections": {"1.1 Keys": {"description": "public keys and privacy"}}},
    "2. Network": {"description": "nodes broadcast blocks over the network"},
}
TEXT = "% --- A ---\nCoins are signatures and digital coins.\n% --- B ---\nThe network of nodes: nodes broadcast blocks.\n% --- C ---\nzebra\n% --- D ---\nprivacy by public keys"


def docs(spark, *texts):
    return spark.createDataFrame([(k, ".tex", t) for k, t in enumerate(texts)], "doc_id long, ext string, content string")


def test_restructure(spark):
    sections = templates.skeleton(spark, TEMPLATE)
    d = docs(spark, TEXT, "% --- X ---\nonly zebras")
    assert restructure(d, sections, options=Options(stage="chunk")).count() == 5
    mapped = {(r["doc_id"], r["chunk_id"]): (r["node_idx"], r["method"]) for r in restructure(d, sections, options=Options(stage="map")).collect()}
    assert mapped == {(0, 0): (1, "semantic"), (0, 1): (3, "semantic"), (0, 2): (None, "orphan"), (0, 3): (2, "semantic"), (1, 0): (None, "orphan")}
    got = {r["doc_id"]: r["document"] for r in restructure(d, sections, EchoModel(), Options(fmt="markdown", polish=False)).collect()}
    first = got[0]
    assert first.index("# Summary") < first.index("# 1. Coins") < first.index("## 1.1 Keys") < first.index("# 2. Network") < first.index("# Uncategorized Content\nzebra")
    assert "Coins are signatures" in first and got[1].endswith("# Uncategorized Content\nonly zebras")


def test_combined(spark):
    sections = templates.skeleton(spark, TEMPLATE)
    more = docs(spark, "% --- A ---\nmore about digital coins and signatures")
    for strategy, has in (("smart", True), ("robust", False)):
        got = restructure(docs(spark, TEXT), sections, EchoModel(), Options(polish=False), more, strategy).first()["document"]
        assert ("more about digital coins" in got) == has and "Coins are signatures" in got


def test_analysis(spark):
    same = analyse(docs(spark, TEXT), docs(spark, TEXT)).first()
    assert same["quality_score"] == 100.0 and "Quality Score: 100.0/100" in same["report"]
    less = analyse(docs(spark, TEXT), docs(spark, "% --- A ---\nx")).first()
    assert less["quality_score"] == 80.0


def test_command(spark, tmp_path):
    (tmp_path / "a.tex").write_text(TEXT)
    out = main([str(tmp_path / "a.tex"), "--out", str(tmp_path / "out"), "--no-polish"])
    text = "\n".join(r[0] for r in spark.read.text(out).collect())
    assert "\\begin{document}" in text and "zebra" in text
    folder = main([str(tmp_path / "a.tex"), "--out", str(tmp_path / "out"), "--stage", "chunk"])
    assert spark.read.parquet(f"{folder}/chunk").where(F.col("content") == "zebra").count() == 1


def test_embedder_and_thresholds(spark):
    """A run by an embedder: each chunk's section is that of the highest cosine of their vectors, from the threshold on."""
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.functions import effects
    from tessera.plans.restructure import Options, restructure
    from tessera.sources import templates

    body = "% --- Introduction ---\nDigital cash without a trusted third party.\n\nTransactions are chains of signatures.\n% --- Network ---\nNodes gossip transactions and blocks over the network.\n"
    docs = spark.createDataFrame([(1, ".tex", body)], "doc_id long, ext string, content string")
    embedder = effects.HashingEmbedder(64)
    sections = templates.skeleton(spark, "bitcoin_paper_hierarchical")
    how = Options(stage="map", embedder=embedder, threshold=0.1)
    got = {r["chunk_id"]: (r["node_idx"], r["assignment_score"]) for r in restructure(docs, sections, effects.EchoModel(), how).where("method <> 'neighbor'").collect()}
    chunks = {r["chunk_id"]: r["content"] for r in restructure(docs, sections, effects.EchoModel(), Options(stage="chunk")).collect()}
    rows = sections.orderBy("node_idx").select(F.coalesce("description", "title").alias("d")).collect()
    vectors = np.array(embedder.embed([r["d"] for r in rows]))
    for k, (node, score) in got.items():
        scores = np.round(vectors @ np.array(embedder.embed([chunks[k]])[0]), 9)
        assert abs(score - scores.max()) < 1e-8 and node == (int(scores.argmax()) if scores.max() >= 0.1 else None)
    split = restructure(docs, sections, effects.EchoModel(), Options(stage="chunk", split=True, split_threshold=10)).count()
    assert split >= len(chunks)
