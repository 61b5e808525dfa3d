"""The pipeline on the smallest tables and on awkward ones; its stages against brute force."""

import os
import re
import shutil
import zlib

import corpus_pipeline
from tessera.llm import decontaminate, mixing, simhash, toxicity

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 1").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert name == "mixing" or after.columns == docs.columns
        ids = {r["doc_id"] for r in after.collect()}
        assert ids <= before.keys()
        if name == "near_dedup":
            sets = {i: frozenset(simhash.shingle_list(t, 5)) for i, t in before.items()}
            near = {i: {j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
            for i in sets:  # every group keeps its smallest, and nothing else
                group, todo = {i}, [i]
                while todo:
                    todo += (more := near[todo.pop()] - group)
                    group |= more
                assert (i in ids) == (i == min(group))
        if name == "secrets":
            assert ids == before.keys()
            for r in after.collect():
                assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r["text"]) and r["n_chars"] == len(r["text"])
        if name == "toxicity":
            assert len(before) - len(ids) <= 2 * len(toxic) + 10
        docs = after
    assert docs.count() > 0


def test_run(spark, tmp_path):
    """The result has whole rows; a run into a folder of its own is taken up where it stopped, and gives the same."""
    got = corpus_pipeline.run(spark, DIR)
    assert got.count() > 0 and {"doc_id", "text", "lang", "source", "mix_epochs"} <= set(got.columns) and got.where("text is null").count() == 0
    folder = str(tmp_path / "kept")
    first = corpus_pipeline.run(spark, DIR, folder)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, got.collect()))
    shutil.rmtree(f"{folder}/mixing")
    before = {n: os.path.getmtime(f"{folder}/{n}/_SUCCESS") for n, _ in corpus_pipeline.STAGES[:-1]}
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR, folder).collect())) == sorted(map(tuple, got.collect()))
    assert before == {n: os.path.getmtime(f"{folder}/{n}/_SUCCESS") for n in before}


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _toxic double, _hash long, _found_id long, _found_hash long, secret_spans string, _rank int, _salt int, th string, spans string, n_words long, label long, _id string, score double"


def test_stages_on_odd_rows(spark):
    """Null and empty texts and ids, repeated rows, a very long text and columns with names that stages use themselves."""
    more = (0.25, 7, 8, 9, "s", 1, 2, "t", "p", 3, 4, "i", 0.5)
    rows = [(1, "The cat sat on the mat and looked.", "en", "a"), (1, "The cat sat on the mat and looked.", "en", "a"), (2, None, "en", None), (3, "", None, "b"), (None, "no id but token = abcdef123", "en", "b"), (5, "the " * 50_000 + "end", "de", "c"), (6, "token = abcdef123 here", "xx", "c")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *more) for r in rows], CLASH)
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = spark.createDataFrame(stage(spark, at, DIR).collect(), stage(spark, at, DIR).schema)
            assert at.columns[: len(docs.columns)] == docs.columns
            if at.count():
                assert {tuple(r[5:18]) for r in at.collect()} == {more}
        assert start is docs or at.count() == 0


def test_mix_against_brute_force(spark):
    """The rows that the last stage takes are those of the selection, whole."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = {r["doc_id"]: r["epochs"] for r in mixing.mix_documents(docs).collect()}
    got = mixing.mix_texts(docs).collect()
    assert {r["doc_id"]: r["mix_epochs"] for r in got} == want and len(got) == len(want)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in got)


def test_decontaminate_and_toxicity_against_plain_loops(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    found = {r["id"] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in stages["decontaminate"](spark, docs, DIR).collect()} == {r["doc_id"] for r in docs.collect()} - found
    texts, labels = toxicity.labelled_sample(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    model = toxicity.fit(texts, labels)
    want = {r["doc_id"] for r in docs.collect() if model.score([r["text"]])[0] < 0.5}
    assert {r["doc_id"] for r in stages["toxicity"](spark, docs, DIR).collect()} == want
