"""Scalar text functions as Column expressions: formats, responses, summaries, prompts, quality.

Patterns use ``(?md)`` so that ``^`` and ``$`` know only the line feed; ``\\s`` is ASCII white space.  Null texts give null
unless a function says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- basics -----------------------------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, or all of one group."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def find_groups(text: Column, pattern: str) -> Column:
    """All matches of a pattern with several groups, each as the array of its groups (X6); a group that took no part is ""."""
    groups = re.compile(pattern).groups
    if groups < 2:
        raise ValueError("find_all is for patterns with fewer than two groups")
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(1, groups + 1)]
    return F.transform(F.arrays_zip(*each), lambda x: F.array(*[F.coalesce(x[f"g{k}"], F.lit("")) for k in range(1, groups + 1)]))


def first_or_null(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


# --- output formats (X1-X3) -------------------------------------------------------------------------------------------
# The rewriting rules of a format in their order, and the patterns that its output must not have.
REWRITES = {
    "latex": [
        (r"(?md)^#{3}\s*(.+)$", r"\\section{$1}"),
        (r"(?md)^#{4}\s*(.+)$", r"\\subsection{$1}"),
        (r"\*\*([^*]+)\*\*", r"\\textbf{$1}"),
        (r"\*([^*]+)\*", r"\\textit{$1}"),
        (r"(?md)^-\s+(.+)$", r"\\item $1"),
    ],
    "markdown": [
        (r"\\section\{([^}]+)\}", r"### $1"),
        (r"\\subsection\{([^}]+)\}", r"#### $1"),
        (r"\\textbf\{([^}]+)\}", r"**$1**"),
        (r"\\textit\{([^}]+)\}", r"*$1*"),
    ],
    "json": [],
}
ISSUES = {
    "latex": [
        (r"(?md)^#{1,6}\s", "INVALID: Use \\section{} not ###"),
        (r"\*\*([^*]+)\*\*", "INVALID: Use \\textbf{} not **text**"),
        (r"\*([^*]+)\*", "INVALID: Use \\textit{} not *text*"),
        (r"(?md)^-\s", "INVALID: Use \\begin{itemize} not - lists"),
        (r"```", "INVALID: Use \\begin{verbatim} not ```"),
    ],
    "markdown": [
        (r"\\section\{", "INVALID: Use ### not \\section{}"),
        (r"\\textbf\{", "INVALID: Use **text** not \\textbf{}"),
        (r"\\begin\{itemize\}", "INVALID: Use - lists not \\begin{itemize}"),
    ],
    "json": [],
}
FORMATS = tuple(REWRITES)


def rewrite_format(text: Column, fmt: str = "latex", literal: bool = False) -> Column:
    """Text brought to a format.

    Four hashes become a subsection; with ``literal`` the rule for three comes first and takes them, as its order says.
    """
    rules = list(REWRITES[fmt])
    if fmt == "latex" and not literal:
        rules[0], rules[1] = rules[1], rules[0]
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def format_issues(text: Column, fmt: str = "latex") -> Column:
    """Messages of the patterns that a text has, in the order of the rules."""
    found = [F.when(_holds(text, p), F.lit(message)) for p, message in ISSUES[fmt]]
    return F.filter(F.array(*found), lambda m: m.isNotNull()) if found else F.array().cast("array<string>")


def _holds(text: Column, pattern: str) -> Column:
    """Whether a text has a pattern.  A search for the characters that every match has goes first, on the text's bytes; a
    pattern that is nothing else needs no more."""
    needed, plain = _literal(pattern)
    there = F.contains(text, F.lit(needed)) if needed else None
    return there if plain else text.rlike(pattern) if there is None else there & text.rlike(pattern)


def _literal(pattern: str) -> tuple[str, bool]:
    """The characters that a pattern's matches begin with, after flags and an anchor, and whether that is all of it."""
    rest, out = re.sub(r"^(\(\?[a-z]+\))?\^?", "", pattern), []
    anchored = rest != pattern
    while m := re.match(r"\\([^a-zA-Z0-9])|([^\\.\[\](){}*+?|^$])", rest):
        after = rest[m.end() :]
        if after[:1] in ("*", "?") or after[:2] == "{0":
            break
        out.append(m[1] or m[2])
        rest = after
        if rest[:1] in ("+", "{"):
            break
    return "".join(out), not anchored and not rest


def enforce_format(text: Column, fmt: str = "latex", literal: bool = False) -> Column:
    """struct(fixed, issues): the rewritten text and what is still wrong with it."""
    fixed = rewrite_format(text, fmt, literal)
    return F.struct(fixed.alias("fixed"), format_issues(fixed, fmt).alias("issues"))


SYSTEM_PROMPTS = {
    "latex": "Answer in LaTeX only: sectioning commands, \\textbf, \\textit and list environments, never Markdown.",
    "markdown": "Answer in Markdown only: headings with #, ** and * for emphasis, - for lists, never LaTeX commands.",
    "json": "Answer with one valid JSON value and nothing else.",
}


def system_prompt(fmt: str) -> str:
    return SYSTEM_PROMPTS[fmt]


# --- responses of models (X4, X10, X9, X13) ---------------------------------------------------------------------------
#: Starts that mark a response as an error, in lower case.
ERROR_PREFIXES = ("% error", "% api error", "error:")


def validate_response(text: Column, least: int = 10, strict: bool = False) -> Column:
    """struct(ok, text, reason): the stripped response, or why it is refused; ``strict`` raises instead."""
    body = strip(text)
    low = F.lower(body)
    failed = low.startswith(ERROR_PREFIXES[0])
    for prefix in ERROR_PREFIXES[1:]:
        failed = failed | low.startswith(prefix)
    reason = F.when(text.isNull(), "none").when(F.length(body) < least, "short").when(failed, "error")
    if strict:
        body = F.when(reason.isNull(), body).otherwise(F.raise_error(F.concat(F.lit("response refused: "), reason)).cast("string"))
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), body).alias("text"), reason.alias("reason"))


def polished_part(response: Column) -> Column:
    """What follows ``Final Polished Version:``, stripped; the response itself if nothing does."""
    found = strip(F.regexp_extract(response, r"(?is)Final Polished Version:\s*(.*)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), response)


def path_of_reply(reply: Column) -> Column:
    """Titles of a reply like ``"A -> B"`` (X9); ``ROOT`` gives none."""
    parts = F.transform(F.split(F.replace(strip(reply), F.lit('"'), F.lit("")), "->"), strip)
    return F.when(F.upper(strip(reply)) == "ROOT", F.array().cast("array<string>")).otherwise(F.filter(parts, lambda p: p != ""))


def comma_list(text: Column) -> Column:
    """Trimmed parts between commas, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")


def json_titles(reply: Column) -> Column:
    """A JSON list of strings, or null."""
    return F.from_json(reply, "array<string>")


# --- windows and names (X11, X12) -------------------------------------------------------------------------------------


def head(text: Column, n: int, dots: bool = False) -> Column:
    cut = F.left(text, F.lit(n))
    return F.when(F.length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text) if dots else cut


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def safe_filename(path: Column, extension: str = ".tex") -> Column:
    """File name of a path of titles: blanks to underscores, no dots, joined by underscores (X11)."""
    clean = F.transform(path, lambda t: F.replace(F.replace(t, F.lit(" "), F.lit("_")), F.lit("."), F.lit("")))
    return F.concat(F.array_join(clean, "_"), F.lit(extension))


def session_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


# --- summaries (X7) ---------------------------------------------------------------------------------------------------


def section_summary(text: Column) -> Column:
    """A short form: up to 200 characters as they are; first, middle and last sentence of longer texts."""
    body = strip(F.coalesce(text, F.lit("")))
    parts = F.split(body, r"\. ")
    n = F.size(parts)
    few = head(body, 500, dots=True)
    many = head(F.concat_ws(". ", F.element_at(parts, 1), F.try_element_at(parts, F.expr("1") * (F.floor(n / 2) + 1).cast("int")), F.element_at(parts, -1)), 400, dots=True)
    return F.when(F.length(body) <= 200, body).when(n <= 3, few).otherwise(many)


# --- prompts (X8) -----------------------------------------------------------------------------------------------------
#: Prompts by name; fields stand in braces.
PROMPTS = {
    "content_weaving": "Rewrite the section '{section_name}' as one text that keeps everything of the original and works in what is new.\n\nOriginal:\n{original_content}\n\nNew:\n{augmentation_content}\n",
    "structure_grafting_location": 'Name the parent under which a new section belongs, as a path with "->", or ROOT.\n\nOutline:\n{tree_summary}\n\nNew section: {new_section_title}\n{new_section_description}\n',
    "hierarchical_refactor": r"Edit the text of '{node_path}' for clarity; keep commands, environments, \cite and \ref as they are. Return the text only." + "\n\nDocument:\n{global_context}\n\nParent section:\n{parent_context}\n\nText:\n{node_content}\n",
    "self_critique_and_refine": "Criticise the text of '{node_path}' briefly, then give it improved.\n\nText:\n{refactored_text}\n\nCritique:\n\nFinal Polished Version:\n",
    "term_extraction": "List the 10 to 15 chief technical terms of the text, comma-separated.\n\n{full_text_excerpt}\n",
    "term_standardization": "Use these terms consistently: {key_terms_list}\n\nReturn the text only:\n{text_content}\n",
    "section_transition": "Write one sentence that leads from '{prev_section_title}' to '{current_section_title}'.\n\n...{prev_section_ending}\n\n{current_section_beginning}...\n",
    "semantic_split_paragraph": "Give the first 5 to 7 words of each sentence that begins a new topic, but not of the first, separated by |||---|||.\n\n{text_content}\n",
    "llm_map_chunk_to_section": "Name the section the text belongs to by its full path, or UNCATEGORIZED.\n\nSections:\n{section_details}\n\nText:\n{chunk_content}\n",
    "dynamic_subsection_identifier": "List the titles of the sub-topics of '{parent_section_title}' as a JSON list of strings.\n\n{text_content}\n",
}


def render_prompt(name: str, **fields: Column) -> Column:
    """A prompt with its fields filled in; each field is replaced once, in the order of the prompt, never inside a value."""
    parts: list[Column] = []
    rest = PROMPTS[name]
    while rest:
        found = [(at, f) for f in fields if (at := rest.find("{" + f + "}")) >= 0]
        if not found:
            parts.append(F.lit(rest))
            break
        at, field = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(fields[field], F.lit(""))]
        rest = rest[at + len(field) + 2 :]
    return F.concat(*parts)


# --- quality (Q1, A11, F3) --------------------------------------------------------------------------------------------
#: Patterns of meaningless content, in lower case.
MEANINGLESS = ("xyz abc def", "lorem ipsum", "test test test", "invalid content", "placeholder text")


def word_diversity(text: Column) -> Column:
    """Distinct words over words; 0 without words."""
    w = words(text)
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)


def content_quality(text: Column) -> Column:
    """struct(is_valid, score): the first rule that holds decides; else a weighted score, valid from 0.6 (Q1)."""
    from tessera.functions.vector import let

    return let(strip(F.coalesce(text, F.lit(""))), lambda body: let(words(body), lambda w: let(F.array(F.size(w), F.size(F.array_distinct(w))), lambda n: _quality(body, F.get(n, 0), F.get(n, 1)))))


def _quality(body: Column, n: Column, distinct: Column) -> Column:
    """The quality of a stripped text with n words."""
    from tessera.functions.vector import let

    low = F.lower(body)
    meaningless = low.contains(MEANINGLESS[0])
    for pattern in MEANINGLESS[1:]:
        meaningless = meaningless | low.contains(pattern)
    sentences = F.filter(F.split(body, r"\."), lambda s: s.rlike(r"\S"))
    # the sentences' words: those of the text with its points as gaps
    length = F.size(words(F.regexp_replace(body, r"\.", " ")))
    few = let(F.size(sentences), lambda k: (k > 0) & (length / F.greatest(k, F.lit(1)) < 3))
    score = F.least(F.length(body) / 100, F.lit(1.0)) * 0.3 + distinct / F.greatest(n, F.lit(1)) * 0.3 + F.when(body.rlike("[.!?]"), 1.0).otherwise(0.5) * 0.2 + F.when(distinct >= 5, 1.0).otherwise(0.5) * 0.2
    refused = F.when(body == "", 0.0).when(F.length(body) < 10, 0.2).when(n < 3, 0.3).when(distinct / F.greatest(n, F.lit(1)) < 0.3, 0.4).when(meaningless, 0.1).when(few, 0.3)
    return F.struct((refused.isNull() & (score >= 0.6)).alias("is_valid"), F.coalesce(refused, score).alias("score"))


def valid_chunk(type_: Column, content: Column, parent_section: Column) -> Column:
    """A chunk has a type, a parent section and content that isn't blank."""
    return F.coalesce(type_.isNotNull() & parent_section.isNotNull() & content.rlike(r"\S"), F.lit(False))
