"""LaTeX bodies to typed chunks (P6): a tokenizer of our own and a vectorised function around it.

Sectioning commands set the path, each top-level environment is a chunk, everything between is a paragraph.  All of it works
on one stream of tokens, in which comments, verbatim text, groups and formulas are kinds of their own.  An environment that is never
closed, and a stray ``\\end``, are plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Commands that open a section, with their level.
LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3}
CITES = ("cite", "citep", "citet")
VERBATIM = ("verbatim", "verbatim*", "lstlisting", "minted", "comment")
_TOKEN = re.compile(r"\\(?P<edge>begin|end)\s*\{(?P<env>[^{}]*)\}|\\(?P<command>[a-zA-Z]+\*?|[^a-zA-Z])|(?P<comment>%[^\n]*)|(?P<open>\{)|(?P<close>\})|(?P<math>\$\$?)", re.S)

ITEM = "struct<type:string,content:string,path:array<string>,labels:array<string>,citations:array<string>,refs:array<string>,caption:string>"


def group_end(text: str, at: int) -> int:
    """Place after the group that opens at ``at``; the end of the text if it isn't closed."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        depth += (c == "{") - (c == "}")
        at += 1
        if not depth:
            return at
    return len(text)


def argument(text: str, at: int) -> tuple[str, int] | None:
    """Content and end of the braced argument after optional ones; None if there is none."""
    while (m := re.compile(r"\s*\[[^\]]*\]").match(text, at)) is not None:
        at = m.end()
    m = re.compile(r"\s*\{").match(text, at)
    if m is None:
        return None
    end = group_end(text, m.end() - 1)
    return text[m.end() : end - 1 if end <= len(text) and text[end - 1] == "}" else end], end


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """The text's tokens (kind, name, start, end): begin, end, command, comment, verbatim, open, close, math.

    A verbatim environment and what ``\\verb`` shows are one token each, an environment's name belongs to its begin and end;
    text that is none of these has no token.
    """
    at = 0
    while (m := _TOKEN.search(text, at)) is not None:
        at = m.end()
        if m["edge"] == "begin" and m["env"] in VERBATIM and (close := text.find(f"\\end{{{m['env']}}}", at)) >= 0:
            at = close + len(m["env"]) + 6
            yield "verbatim", m["env"], m.start(), at
        elif m["edge"]:
            yield m["edge"], m["env"], m.start(), at
        elif m["command"] in ("verb", "verb*"):
            mark = text[at : at + 1]
            close = text.find(mark, at + 1) if mark else -1
            at = close + 1 if close >= 0 else at
            yield "verbatim", "", m.start(), at
        elif m["command"] in ("(", "[", ")", "]"):
            yield "math", m["command"], m.start(), at
        elif m["command"]:
            yield "command", m["command"], m.start(), at
        else:
            kind = next(k for k in ("comment", "open", "close", "math") if m[k])
            yield kind, m[kind], m.start(), at


def top_level(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, name, start, end) of the sectioning commands and environments that stand outside any environment."""
    stack, past = [], 0
    for kind, name, start, end in tokens(text):
        if start < past:
            continue
        if kind == "verbatim" and name and not stack:
            yield "env", name, start, end
        elif kind == "begin":
            stack.append((name, start))
        elif kind == "end":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    first = stack[k][1]
                    del stack[k:]
                    if not stack:
                        yield "env", name, first, end
                    break
        elif kind == "command" and name.rstrip("*") in LEVELS and not stack and (found := argument(text, end)) is not None:
            past = found[1]
            yield "sec", name.rstrip("*"), start, past


def _unclosed(text: str) -> int | None:
    """Start of the first environment that is opened at the top and never closed."""
    stack = []
    for kind, name, start, _ in tokens(text):
        if kind == "begin":
            stack.append((name, start))
        elif kind == "end":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
    return stack[0][1] if stack else None


def _open_commands(text: str, names: set[str], nested: bool) -> Iterator[tuple[str, str]]:
    """(name, argument) of these commands outside groups, arguments of other commands, formulas, comments and verbatim text;
    those inside environments only if ``nested``."""
    groups = environments = past = 0
    formula = ""
    for kind, name, start, end in tokens(text):
        if start < past:
            continue
        if kind == "open":
            groups += 1
        elif kind == "close":
            groups = max(0, groups - 1)
        elif kind == "math":
            closing = {"(": ")", "[": "]"}.get(name, name)
            formula = "" if formula and name == formula else formula or ("" if name in (")", "]") else closing)
        elif kind in ("begin", "end"):
            environments = max(0, environments + (1 if kind == "begin" else -1))
        elif kind == "command" and name in names and not groups and not formula and (nested or not environments) and (found := argument(text, end)) is not None:
            past = found[1]
            yield name, found[0].strip("{}")


def metadata(text: str) -> dict:
    """Labels, citations and references of a piece, in order (P6c); of its own and of environments in it, not of what is
    an argument of another command or stands in a group, a formula, a comment or verbatim text."""
    found = {"labels": [], "citations": [], "refs": []}
    for name, value in _open_commands(text, {"label", "ref", *CITES}, nested=True):
        if name == "label":
            found["labels"].append(value.strip())
        elif name == "ref":
            found["refs"].append(value.strip())
        else:
            found["citations"] += [c.strip() for c in value.split(",")]
    return found


def caption(body: str) -> str | None:
    """The caption that is a direct child of an environment (P6d)."""
    return next((value for _, value in _open_commands(body, {"caption", "caption*"}, nested=False)), None)


def parse(text: str | None, path: list[str] | None = None) -> list[dict]:
    """Chunks of a body, in order; ``path`` is where it starts.  Null and blank bodies have none."""
    text = text or ""
    path = list(path or [])
    out: list[dict] = []

    def paragraph(piece: str):
        if piece.strip():
            out.append({"type": "paragraph", "content": piece.strip(), "path": list(path), **metadata(piece), "caption": None})

    at = 0
    pieces = list(top_level(text))
    if (open_at := _unclosed(text)) is not None and not pieces:
        pieces = [(k, n, a + open_at + 1, b + open_at + 1) for k, n, a, b in top_level(text[open_at + 1 :])]
    for kind, name, start, end in pieces:
        paragraph(text[at:start])
        at = end
        if kind == "sec":
            level = LEVELS[name]
            title = argument(text, re.compile(r"\\[a-z]+\*?").match(text, start).end())[0].strip("{}").strip()
            path = [*path[: level - 1], title]
        else:
            whole = text[start:end]
            inner = whole[whole.index("}") + 1 : whole.rindex("\\end")]
            inside = inner if name not in VERBATIM else ""
            out.append({"type": name, "content": whole, "path": list(path), **metadata(inside), "caption": caption(inside)})
    paragraph(text[at:])
    return out


def parse_latex(body: Column, path: Column) -> Column:
    """Array of chunk structs of a LaTeX body that starts under ``path``."""

    @F.pandas_udf(f"array<{ITEM}>")
    def run(bodies: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([parse(b, list(p) if p is not None else []) for b, p in zip(bodies, paths, strict=True)])

    return run(body, path)


class LatexChunks:
    """A table function: chunks of a LaTeX body, one row each."""

    def eval(self, body: str, path: list[str] | None = None):
        for n, c in enumerate(parse(body, path)):
            yield n, c["type"], c["content"], c["path"], c["labels"], c["citations"], c["refs"], c["caption"]


ROWS = "pos int, type string, content string, path array<string>, labels array<string>, citations array<string>, refs array<string>, caption string"


def register_latex(spark: SparkSession, name: str = "latex_chunks") -> None:
    """Makes the table function known to SQL: ``select * from docs, lateral latex_chunks(content, array())``."""
    spark.udtf.register(name, F.udtf(LatexChunks, returnType=ROWS))
