"""Text functions on the worked examples."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text

ACADEMIC = "Well structured academic paragraphs present clear arguments with sufficient evidence, following one logical, coherent manner."


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "valid", "score"),
    [
        ("", False, 0.0),
        (None, False, 0.0),
        ("Hi", False, 0.2),
        ("abcdefghij klm", False, 0.3),
        ("test " * 100, False, 0.4),
        ("Invalid content: xyz abc def.", False, 0.1),
        ("One two. Three four. Five six.", False, 0.3),
        ("Machine learning algorithms require large datasets for training and validation.", True, 0.937),
        ("Data science combines statistics, programming, and domain expertise.", True, 0.904),
    ],
)
def test_content_quality(spark, value, valid, score):
    got = one(spark, value, text.content_quality(F.col("t")))
    assert got["is_valid"] == valid
    assert got["score"] == pytest.approx(score, abs=1e-9)


def test_quality_of_a_long_text_is_one(spark):
    assert one(spark, ACADEMIC, text.content_quality(F.col("t")))["score"] == pytest.approx(1.0)


def test_format_chain(spark):
    body = "### A\n#### B\n**b** *i*\n- x"
    assert one(spark, body, text.enforce_format(F.col("t"), "latex", literal=True))["fixed"] == "\\section{A}\n\\section{# B}\n\\textbf{b} \\textit{i}\n\\item x"
    got = one(spark, body, text.enforce_format(F.col("t"), "latex"))
    assert got["fixed"] == "\\section{A}\n\\subsection{B}\n\\textbf{b} \\textit{i}\n\\item x"
    assert got["issues"] == []


def test_format_issues(spark):
    assert any("textbf" in m for m in one(spark, "This is **bold** text", text.format_issues(F.col("t"), "latex")))
    assert one(spark, "\\section{A} \\textbf{b}", text.format_issues(F.col("t"), "markdown")) == ["INVALID: Use ### not \\section{}", "INVALID: Use **text** not \\textbf{}"]
    assert one(spark, "anything", text.format_issues(F.col("t"), "json")) == []


def test_summary(spark):
    assert one(spark, "short", text.section_summary(F.col("t"))) == "short"
    assert one(spark, None, text.section_summary(F.col("t"))) == ""
    long_ = ". ".join(f"sentence number {k}" for k in range(40))
    assert one(spark, long_, text.section_summary(F.col("t"))) == "sentence number 0. sentence number 20. sentence number 39"
    assert len(one(spark, "x" * 4500, text.section_summary(F.col("t")))) == 503


@pytest.mark.parametrize(("value", "reason"), [("% Error: something went wrong", "error"), ("  ", "short"), (None, "none"), ("Error: bad thing", "error"), ("% API error x", "error"), (" a fine answer ", None)])
def test_response(spark, value, reason):
    got = one(spark, value, text.validate_response(F.col("t")))
    assert got["reason"] == reason
    assert got["ok"] == (reason is None)
    if reason is None:
        assert got["text"] == value.strip()


def test_small_functions(spark):
    assert one(spark, "abc 123 def 456", text.find_all(F.col("t"), r"\d+")) == ["123", "456"]
    assert one(spark, "Critique\nfinal polished version:  Done.", text.polished_part(F.col("t"))) == "Done."
    assert one(spark, "no mark", text.polished_part(F.col("t"))) == "no mark"
    assert one(spark, '"A" -> B', text.path_of_reply(F.col("t"))) == ["A", "B"]
    assert one(spark, "ROOT", text.path_of_reply(F.col("t"))) == []
    assert one(spark, " a, b ,,c", text.comma_list(F.col("t"))) == ["a", "b", "c"]
    assert one(spark, '["a","b"]', text.json_titles(F.col("t"))) == ["a", "b"]
    assert one(spark, "{text_content}", text.render_prompt("dynamic_subsection_identifier", parent_section_title=F.lit("{text_content}"), text_content=F.col("t"))).count("{text_content}") == 2
    assert spark.range(1).select(text.safe_filename(F.array(F.lit("1. A b"), F.lit("1.1 C")))).first()[0] == "1_A_b_11_C.tex"


def test_valid_chunk(spark):
    rows = spark.createDataFrame([(None, None, None), ("p", "x", None), ("p", " ", "s"), ("p", "x", "s")], "type string, content string, parent_section string")
    assert [r[0] for r in rows.select(text.valid_chunk(F.col("type"), F.col("content"), F.col("parent_section"))).collect()] == [False, False, False, True]
