"""Chunkers on small documents, and the LaTeX parser by itself."""

import io
import zipfile

from pyspark.sql import functions as F

from tessera.operators import chunk, latex
from tessera.sources import files, templates


def docs(spark, *texts, ext=".tex"):
    return spark.createDataFrame([(k, f"f{k}{ext}", ext, t) for k, t in enumerate(texts)], "doc_id long, path string, ext string, content string")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("doc_id", "chunk_id").collect()]


def test_markdown(spark):
    got = chunk.chunk_markdown(docs(spark, "intro\n# A\na\n### C\nc\n## B\nb", None, "", ext=".md"))
    assert rows(got, "chunk_id", "parent_section", "content") == [(0, "Preamble", "intro"), (1, "A", "a"), (2, "A -> C", "c"), (3, "A -> B", "b")]
    assert got.orderBy("chunk_id").first()["metadata"]["hierarchy_path"] == []


def test_markers(spark):
    text = "before\n% --- One ---\nbody \\ref{x}\n\\begin{equation}\\label{x} e=1 \\end{equation}\n% --- Two ---\n  \n% --- Three ---\n\\section{S}t"
    got = chunk.chunk_tex(docs(spark, text))
    assert rows(got, "chunk_id", "type", "parent_section", "content") == [
        (0, "paragraph", "Preamble", "before"), (1, "paragraph", "One", "body \\ref{x}"), (2, "equation", "One", "\\begin{equation}\\label{x} e=1 \\end{equation}"), (3, "paragraph", "S", "t"),
    ]
    meta = {r["chunk_id"]: r["metadata"] for r in got.collect()}
    assert meta[1]["refs"] == ["x"] and meta[2]["labels"] == ["x"] and meta[0]["hierarchy_path"] == ["Preamble"]


def test_latex_parser():
    text = r"""\section{A} one % \begin{figure} no
\begin{figure}[h]\centering\includegraphics{x}\caption{The \textbf{best} one}\label{fig:a}\begin{center}\cite{a, b}\end{center}\end{figure}
two \subsection*{B} \begin{verbatim} \begin{figure} \section{no} \end{verbatim} three \end{stray} \citep{c}"""
    got = latex.parse(text)
    assert [(c["type"], c["path"]) for c in got] == [("paragraph", ["A"]), ("figure", ["A"]), ("paragraph", ["A"]), ("verbatim", ["A", "B"]), ("paragraph", ["A", "B"])]
    assert got[1]["caption"] == r"The \textbf{best} one"
    assert got[1]["labels"] == ["fig:a"] and got[1]["citations"] == ["a", "b"]
    assert got[4]["citations"] == ["c"]
    assert latex.parse(None) == [] == latex.parse("  \n")
    assert [c["type"] for c in latex.parse(r"a \begin{open} b")] == ["paragraph"]
    # every character outside sectioning commands is in exactly one chunk
    body = r"x \begin{a}\begin{b}y\end{b}\end{a} z \begin{a}q\end{a}"
    assert "".join(c["content"] for c in latex.parse(body)).replace(" ", "") == body.replace(" ", "")


def test_semantic_split(spark):
    one = spark.createDataFrame([("AAA BBB CCC",)], "c string")
    split = lambda *m: one.select(chunk.split_at_markers(F.col("c"), F.array(*[F.lit(x) for x in m]))).first()[0]
    assert split("CCC", "BBB", "zzz") == ["AAA", "BBB", "CCC"]
    assert split("AAA", "BBB") == ["AAA", "BBB CCC"]
    assert split("zzz") == ["AAA BBB CCC"]


def test_long_chunks_are_renumbered(spark):
    chunks = chunk.chunk_lines(docs(spark, "x" * 1500 + "\n" + "a" * 800 + "MARK" + "b" * 800 + "\nlast"))
    got = chunk.split_long_chunks(chunks, F.array(F.lit("MARK")))
    assert [(i, len(c)) for i, c in rows(got, "chunk_id", "content")] == [(0, 1500), (1, 800), (2, 804), (3, 4)]


def test_grouping(spark):
    got = chunk.group_by_section(chunk.chunk_tex(docs(spark, "% --- B ---\nx\n% --- A ---\ny\n% --- B ---\nz")))
    assert [(r["section"], r["position"], [c["content"] for c in r["chunks"]]) for r in got.orderBy("position").collect()] == [("B", 0, ["x", "z"]), ("A", 1, ["y"])]
    assert chunk.ungroup(got).count() == 3


def test_dispatch_refuses_other_files(spark):
    import pytest

    assert chunk.chunk_documents(docs(spark, "a", ext=".txt")).count() == 1
    with pytest.raises(Exception, match="unsupported extension"):
        chunk.chunk_documents(docs(spark, "a", ext=".pdf")).collect()


def test_preprocess(spark):
    text = "% comment\n% --- keep ---\n\n\n\n\\begin{abstract}a"
    got = spark.createDataFrame([(text,)], "t string").select(chunk.preprocess_tex(F.col("t"))).first()[0]
    assert got == "\n% --- keep ---\n\n% --- Abstract ---\n\\begin{abstract}a"


def make_docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(make_docx([(None, "before"), ("Heading1", "A"), (None, "one"), (None, "two"), ("Heading2", "B"), (None, "three"), ("Heading1", "C"), (None, "four")]))
    got = chunk.chunk_paragraph_table(files.read_docx(spark, str(tmp_path)))
    assert rows(got, "parent_section", "content") == [("", "before"), ("A", "one\ntwo"), ("A -> B", "three"), ("C", "four")]


def test_files_and_includes(spark, tmp_path):
    (tmp_path / "main.tex").write_text("a \\input{b} c \\include{gone}")
    (tmp_path / "b.tex").write_text("<\\input{c.tex}>")
    (tmp_path / "c.tex").write_text("C \\input{main}")
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in files.resolve_includes(files.read_texts(spark, str(tmp_path / "*.tex"))).collect()}
    assert got["main.tex"] == "a <C \\input{main}> c \\include{gone}"
    assert got["c.tex"].startswith("C a <\\input{c.tex}>")


def test_includes_in_several_places_and_deep(spark):
    rows_ = [("/d/a.tex", "<\\input{b}|\\input{c}>"), ("/d/b.tex", "B"), ("/d/c.tex", "C\\input{b}\\input{a}")]
    rows_ += [(f"/d/n{k}.tex", f"{k}\\input{{n{k + 1}}}" if k < 13 else "end") for k in range(14)]
    got = dict(files.resolve_includes(spark.createDataFrame(rows_, "path string, content string")).collect())
    assert got["/d/a.tex"] == "<B|CB\\input{a}>" and got["/d/n0.tex"] == "".join(map(str, range(13))) + "end"


def test_archive_is_read_in_memory(tmp_path):
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, body in (("../evil.tex", b"x"), ("paper.tex", b"y"), ("fig.png", b"z")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    assert files.tex_members((tmp_path / "a.tar.gz").read_bytes()) == [("../evil.tex", "x"), ("paper.tex", "y")]


def test_templates(spark):
    tree = templates.skeleton(spark, "bitcoin_paper_hierarchical")
    got = tree.orderBy("node_idx").collect()
    assert len(got) == 20 and templates.skeleton(spark, "unknown").count() == 15
    assert got[12]["path_key"] == "10. Security Analysis -> 10.1 Privacy Model" and got[12]["parent_idx"] == 11
    assert [r["node_idx"] for r in tree.orderBy("sort_key").collect()] == list(range(20))
    assert [r["title"] for r in got if r["generative"]] == ["Summary", "Abstract"]
    assert [r["title"] for r in got if r["dynamic_subsections"]] == ["14. System Tests"]
    assert len(templates.flatten({"A": {"subsections": {}}, "stray": "text"})) == 1


LATEX = r"""intro \label{a} \footnote{\cite{no}} {\ref{no}} $ \label{no} $ \[ \label{no} \] % \label{no}
\begin{verbatim}\label{no}\end{verbatim} \verb|\label{no}| \cite[p.~3]{x, y} \citep{z} \textbf{\label{no}}
\begin{figure}[h] \label{in} % \caption{no}
\begin{tabular}{c} \caption{no} \ref{deep} \end{tabular} \caption{real} \ref{r1} \end{figure} \section{S} after \ref{r2} 100\% \label{b} \$ \ref{r3}"""


def test_latex_tokens():
    """What stands in comments, verbatim text, groups, formulas and other commands' arguments is not taken; environments are."""
    assert latex.metadata(LATEX) == {"labels": ["a", "in", "b"], "citations": ["x", "y", "z"], "refs": ["deep", "r1", "r2", "r3"]}
    chunks = latex.parse(LATEX)
    assert [c["type"] for c in chunks] == ["paragraph", "verbatim", "paragraph", "figure", "paragraph"]
    assert [c["labels"] for c in chunks] == [["a"], [], [], ["in"], ["b"]] and [c["caption"] for c in chunks] == [None, None, None, "real", None] and chunks[4]["path"] == ["S"]
    text = "x {y $z$ \\verb+%+ % c\n\\begin{a}\\end{a}"
    assert [t[0] for t in latex.tokens(text)] == ["open", "math", "math", "verbatim", "comment", "begin", "end"]


def test_latex_table_function(spark):
    latex.register_latex(spark)
    docs = spark.createDataFrame([(1, LATEX), (2, "plain"), (3, None), (4, " ")], "doc_id long, content string")
    docs.createOrReplaceTempView("latex_docs")
    got = spark.sql("select doc_id, pos, type, labels, path, caption from latex_docs, lateral latex_chunks(content, array('P')) order by doc_id, pos").collect()
    want = [(d, n, c["type"], c["labels"], c["path"], c["caption"]) for d, t in ((1, LATEX), (2, "plain")) for n, c in enumerate(latex.parse(t, ["P"]))]
    assert [tuple(r) for r in got] == want
