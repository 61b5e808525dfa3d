"""Includes, archives, named files, Word documents in the dispatcher, the command with two documents, model limits."""

import gzip
import io
import math
import tarfile
import time
import zipfile
from collections import Counter

import pytest

from tessera import __main__ as command
from tessera.errors import ModelError
from tessera.functions import effects, text, vector
from tessera.operators import chunk, context, process
from tessera.sources import files, named, sinks, templates


def resolved(spark, pairs):
    return {r["path"]: r["content"] for r in files.resolve_includes(spark.createDataFrame(pairs, "path string, content string")).collect()}


def test_includes(spark):
    """A diamond, a blank before the brace, a subfolder's own folder, fifteen levels, a cycle, a file that isn't there."""
    pairs = [("/t/root.tex", "[\\input{a}|\\include{b}]"), ("/t/a.tex", "a(\\input{shared})"), ("/t/b.tex", "b(\\input {shared})"), ("/t/shared.tex", "S")]
    pairs += [("/t/sub/main.tex", "\\input{parts/d}"), ("/t/sub/parts/d.tex", "d\\input{e}\\input{../up}"), ("/t/sub/parts/e.tex", "e"), ("/t/sub/up.tex", "u"), ("/t/e.tex", "wrong")]
    pairs += [(f"/deep/c{k}.tex", f"{k}\\input{{c{k + 1}}}") for k in range(15)] + [("/deep/c15.tex", "end")]
    pairs += [("/loop/x.tex", "x\\input{y}"), ("/loop/y.tex", "y\\input{x}"), ("/t/none.tex", "\\input{gone}")]
    got = resolved(spark, pairs)
    assert got["/t/root.tex"] == "[a(S)|b(S)]" and got["/t/sub/main.tex"] == "deu"
    assert got["/deep/c0.tex"] == "".join(map(str, range(15))) + "end"
    assert got["/loop/x.tex"] == "xy\\input{x}" and got["/t/none.tex"] == "\\input{gone}"


def tar_of(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "p.tar").write_bytes(tar_of([("src/a.tex", "A"), ("src/main.tex", "M \\input{a}"), ("x.txt", "no")]))
    (row,) = files.read_archived(spark, str(tmp_path / "*.tar")).collect()
    assert row["content"] == "M A" and row["path"].endswith("!/src/main.tex") and row["ext"] == ".tex"
    with pytest.raises(ValueError, match="more than 3"):
        files.tex_members(tar_of([("a.tex", "long")]), limit=3)


def test_word_documents_need_their_paragraphs(spark):
    docs = spark.createDataFrame([(1, ".docx", "x")], "doc_id long, ext string, content string")
    with pytest.raises(Exception, match="unsupported extension"):
        chunk.chunk_documents(docs).collect()
    paragraphs = spark.createDataFrame([(1, 0, "Heading 1", "T"), (1, 1, "Normal", "body")], "doc_id long, pos long, style string, text string")
    assert [r["content"] for r in chunk.chunk_documents(docs, paragraphs).collect()] == ["body"]


def test_deep_and_broken_trees(spark):
    rows = [(k, k - 1 if k else None, f"t{k}", 0) for k in range(20)] + [(100, 101, "lost", 0), (101, 100, "lost", 0)]
    nodes = spark.createDataFrame(rows, "id long, parent long, title string, ord int")
    got = {r["id"]: r["depth"] for r in templates.skeleton_of_table(nodes, "id", "parent", "title", "ord").collect()}
    assert got == {k: k + 1 for k in range(20)}
    with pytest.raises(ValueError, match="levels"):
        templates.skeleton_of_table(nodes, "id", "parent", "title", "ord", max_depth=5)


def test_regex_groups(spark):
    row = spark.createDataFrame([("a1 b22 c",)], "t string").select(text.find_groups(text.F.col("t"), r"([a-z])(\d*)").alias("g")).first()
    assert row["g"] == [["a", "1"], ["b", "22"], ["c", ""]]
    with pytest.raises(ValueError, match="find_all"):
        text.find_groups(text.F.col("t"), r"(a)")


def test_named_files(spark, tmp_path):
    doc = spark.createDataFrame([(1, "Grüße\n")], "doc_id long, document string")
    path = sinks.save_document_file(doc, str(tmp_path), "markdown")
    assert (tmp_path / "final_document.md").read_text() == "Grüße\n" and path.endswith("final_document.md")
    with pytest.raises(ValueError, match="one document"):
        sinks.save_document_file(doc.unionByName(doc), str(tmp_path))
    nodes = spark.createDataFrame([(["1. A b", "C"], "x"), (["D"], "")], "path array<string>, processed_content string")
    assert [n.rsplit("/", 1)[1] for n in sinks.save_node_files(nodes, str(tmp_path))] == ["1_A_b_C.tex"]
    assert (tmp_path / "processed_nodes" / "1_A_b_C.tex").read_text() == "x"


def test_named_sink(spark, tmp_path):
    """Files by the tasks that have them; two rows of a name, or a name outside the folder, leave what was there."""
    rows = spark.createDataFrame([(f"n{k}.tex", f"text {k}") for k in range(40)], "filename string, content string").repartition(5)
    at = tmp_path / "named"
    named.save_named(rows, str(at))
    assert {p.name: p.read_text() for p in at.iterdir()} == {f"n{k}.tex": f"text {k}" for k in range(40)}
    for bad in ([("x", "1"), ("x", "2"), ("y", "3")], [("../x", "1"), ("y", "2")], [(None, "1")]):
        with pytest.raises(Exception, match="two rows|not a file"):
            named.save_named(spark.createDataFrame(bad, "filename string, content string").repartition(2), f"file://{at}")
        assert len(list(at.iterdir())) == 40
    named.save_named(spark.createDataFrame([("n1.tex", "new"), ("z", None)], "filename string, content string"), str(at))
    assert len(list(at.iterdir())) == 41 and (at / "n1.tex").read_text() == "new" and (at / "z").read_text() == ""
    named.save_named(rows.limit(0), str(at))
    assert len(list(at.iterdir())) == 41
    named.save_named(rows.where("filename = 'n2.tex'"), str(at), "overwrite")
    assert [p.name for p in at.iterdir()] == ["n2.tex"]


def test_archive_of_many_members(spark, tmp_path):
    """Members come one by one, compressed or not, with their numbers; a member beyond the limit is an error."""
    body = tar_of([(f"d/{k}.tex", f"body {k} " * 500) for k in range(300)] + [("other.txt", "no")])
    (tmp_path / "big.tar").write_bytes(body)
    (tmp_path / "big.tar.gz").write_bytes(gzip.compress(body))
    rows = files.read_archives(spark, str(tmp_path / "*")).collect()
    assert len(rows) == 600 and {r["pos"] for r in rows} == set(range(300)) and all(r["content"] == f"body {r['pos']} " * 500 and r["path"] == f"d/{r['pos']}.tex" for r in rows)
    with pytest.raises(Exception, match="more than 10"):
        named.read_tars(spark, [str(tmp_path / "big.tar")], limit=10).collect()


def test_limits_of_a_call():
    class Slow:
        def call(self, messages, max_tokens, temperature):
            time.sleep(0.6 if messages[0]["content"] == "slow" else 0)
            return f"{max_tokens} {temperature}"

    model = effects.TimedModel(Slow(), 7, 0.5, 0.3)
    assert model.call([{"content": "fast"}]) == "7 0.5"
    with pytest.raises(ModelError, match="within 0.3"):
        model.call([{"content": "slow"}])


def test_single_node(spark):
    nodes = spark.createDataFrame([(1, ["A"], "old a"), (1, ["B"], "old b"), (2, ["B"], "b two")], "doc_id long, path array<string>, processed_content string")
    got = {(r["doc_id"], r["path"][0]): r["processed_content"] for r in process.process_node(nodes, ["B"], effects.EchoModel(), text.F.lit("the whole text")).collect()}
    assert got[1, "A"] == "old a" and got[1, "B"] == got[2, "B"] and "the whole text" in got[1, "B"] and "N/A" in got[1, "B"]


def word_file(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_command(spark, tmp_path):
    (tmp_path / "a.tex").write_text("% --- Introduction ---\nDigital cash needs trust in a third party to work at all.\n% --- Conclusion ---\nA system without trust was proposed here.\n")
    (tmp_path / "b.tex").write_text("% --- Introduction ---\nAttacks on chains are discussed in this second text.\n")
    word_file(tmp_path / "c.docx", ["First paragraph of a Word file.", "And the second one."])
    out = command.main([str(tmp_path / "a.tex"), "--source2", str(tmp_path / "b.tex"), "--combine", "smart", "--analysis", "--no-polish", "--out", str(tmp_path / "out"), "--max-tokens", "500", "--timeout", "20"])
    assert out.endswith("final_document.tex") and "\\begin{document}" in open(out).read()
    assert spark.read.json(out.rsplit("/", 1)[0] + "/analysis").count() == 1
    folder = command.main([str(tmp_path / "c.docx"), "--stage", "chunk", "--out", str(tmp_path / "out2")])
    assert [r["content"] for r in spark.read.parquet(f"{folder}/chunk").orderBy("chunk_id").collect()] == ["First paragraph of a Word file.\nAnd the second one."]


def test_pair_cosines_against_plain_loops(spark):
    texts = ["the cat the dog", "dog cat cat", "", None, "Straße STRASSE ünder_score x2", "x2 score"]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]

    def terms(t):
        return Counter("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())

    got = {r["i"]: r["similarity"] for r in vector.pair_similarity(spark.createDataFrame(pairs, "i long, a string, b string"), "a", "b").collect()}
    for i, a, b in pairs:
        x, y = terms(a), terms(b)
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        assert got[i] == pytest.approx(sum(x[t] * y[t] for t in x) / size if size else 0.0)


def test_context_store_against_plain_loops(spark):
    """Additions with their relevance and the state after them, by a store that is kept as plain lists."""
    rows = [(f"k{i % 2}", i, f"text number {i % 5} " * (3 + i % 4), "s", 0.1 * (i % 7), "t") for i in range(40)]
    got = {(r["key"], r["seq"]): r for r in context.add_context(spark.createDataFrame(rows, "key string, seq long, content string, section_name string, importance_score double, context_type string"), 300).collect()}
    stores = {"k0": [], "k1": []}
    for key, seq, body, _, importance, _ in rows:
        held = stores[key]
        shown = "\n\n".join(c[:200] + "..." if len(c) > 200 else c for c, _, _ in sorted(held, key=lambda h: -h[1]))
        x, y = Counter(body.split()), Counter(shown.replace("...", " ").split())
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        relevance = sum(x[t] * y[t] for t in x) / size if size else 0.0
        held.append((body, importance, relevance))
        if sum(len(c) for c, _, _ in held) > 300:
            kept, used = [], 0
            for h in sorted(held, key=lambda h: -(0.4 * h[1] + 0.4 * h[2])):
                used += len(h[0])
                if used > 300:
                    break
                kept.append(h)
            held[:] = kept
        r = got[key, seq]
        assert r["relevance_score"] == pytest.approx(relevance) and (r["n_items"], r["total_chars"]) == (len(held), sum(len(c) for c, _, _ in held))
