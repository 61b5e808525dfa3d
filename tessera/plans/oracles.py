"""DuckDB SQL for the named queries that SQL can express.  Column names and rounding are those of the queries."""

from __future__ import annotations

from tessera.functions.text import PROMPTS
from tessera.operators.analysis import KEPT
from tessera.operators.process import CONTEXT
from tessera.operators.render import FOOTERS, HEADERS, ORPHANS
from tessera.plans.inputs import EDGES_SQL, ITEMS_SQL, TREES_SQL, VECTORS_SQL
from tessera.sources.templates import TEMPLATES, flatten


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


NOT_BLANK = r"'[^ \t\n\x0B\f\r]'"
TURN_TEXT = "select conv_id as doc_id, string_agg('{0}' || role || '{1}' || chr(10) || text, chr(10) order by turn) as content from conversations group by conv_id"
ORACLES: dict[str, str] = {}

# --- chunks -----------------------------------------------------------------------------------------------------------
ORACLES["chunk_paragraphs"] = f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as chunk_id, {strip("line")} as content, 'Preamble' as parent_section from lines where regexp_matches(line, {NOT_BLANK})"""
_SECTIONS = f"""docs as ({TURN_TEXT.format("% --- ", " ---")}),
parts as (select doc_id, list_concat([null], list_transform(regexp_extract_all(content, '% --- (.+?) ---', 1), lambda x: {strip("x")})) as names, string_split_regex(content, '% --- (.+?) ---') as bodies from docs),
secs as (select doc_id, unnest(range(len(bodies))) as sec_pos, names, bodies from parts),
found as (select doc_id, sec_pos::int as sec_pos, names[sec_pos + 1] as section, {strip("bodies[sec_pos + 1]")} as body from secs)"""
ORACLES["section_marker_split"] = f"with {_SECTIONS} select * from found where body <> ''"
ORACLES["section_marker_chunks"] = f"with {_SECTIONS} select doc_id, (row_number() over (partition by doc_id order by sec_pos) - 1)::int as chunk_id, 'paragraph' as type, body as content, coalesce(section, 'Preamble') as parent_section from found where body <> ''"
ORACLES["chunks_grouped_by_section"] = """with g as (select conv_id as doc_id, role as section, min(turn) as first, count(*) as n_chunks, string_agg(turn::varchar, ',' order by turn) as chunk_ids from conversations group by all)
select doc_id, section, (row_number() over (partition by doc_id order by first) - 1)::int as position, n_chunks, chunk_ids from g"""
ORACLES["ungrouped_chunks"] = "select conv_id as doc_id, role as section, turn::int as chunk_id, text as content from conversations"
ORACLES["paragraph_table_chunks"] = f"""with recursive p as (select conv_id as doc_id, turn as pos, text, case when role = 'user' then turn % 3 + 1 else 0 end as level, row_number() over (partition by conv_id order by turn) as k from conversations),
f as (select doc_id, k, pos, text, level, case when level > 0 then [trim(text)] else []::varchar[] end as path, case when level > 0 then 1 else 0 end as grp from p where k = 1
  union all select p.doc_id, p.k, p.pos, p.text, p.level, case when p.level > 0 then list_concat(f.path[1:p.level - 1], [trim(p.text)]) else f.path end, f.grp + case when p.level > 0 then 1 else 0 end from f join p on p.doc_id = f.doc_id and p.k = f.k + 1),
b as (select doc_id, grp, any_value(path) as path, {strip("string_agg(text, chr(10) order by pos)")} as content from f where level = 0 group by doc_id, grp)
select doc_id, (row_number() over (partition by doc_id order by grp) - 1)::int as chunk_id, content, array_to_string(path, ' -> ') as parent_section from b where content <> ''"""
ORACLES["markdown_chunks"] = f"""with recursive p as (select conv_id as doc_id, turn, {strip("text")} as body, role, turn % 3 + 1 as level, row_number() over (partition by conv_id order by turn) as k from conversations),
f as (select doc_id, k, body, [role] as path from p where k = 1 union all select p.doc_id, p.k, p.body, list_concat(f.path[1:p.level - 1], [p.role]) from f join p on p.doc_id = f.doc_id and p.k = f.k + 1)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_id, body as content, array_to_string(path, ' -> ') as parent_section from f where body <> ''"""
ORACLES["long_chunk_split"] = f"""with m as (select doc_id, text, length(text) as n, floor(length(text) / 3)::int as t from documents),
c as (select doc_id, text, list_sort(list_filter([strpos(text, {strip("substr(text, t * 2, 20)")}), strpos(text, {strip("substr(text, t, 20)")})], lambda p: p > 0)) as cuts, n from m where n > 1500 ),
b as (select doc_id, text, list_concat([1], cuts, [n + 1]) as bounds from c),
s as (select doc_id, text, bounds, unnest(range(1, len(bounds))) as i from b),
parts as (select doc_id, i, {strip("substr(text, bounds[i]::int, (bounds[i + 1] - bounds[i])::int)")} as content from s)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_id, content from parts where content <> ''
union all select doc_id, 0, text from m where n <= 1500"""
_MARK = [(r"\\begin\{abstract\}", "Abstract"), (r"\\section\*?\{[Ii]ntroduction\}", "Introduction"), (r"\\section\*?\{.*?[Mm]ethod", "Methods"), (r"\\section\*?\{.*?[Rr]esult", "Results"), (r"\\section\*?\{.*?[Dd]iscussion\}", "Discussion"), (r"\\section\*?\{.*?[Cc]onclusion\}", "Conclusion"), (r"\\begin\{thebibliography\}", "References")]


def marked(x: str) -> str:
    for pattern, name in _MARK:
        x = f"regexp_replace({x}, '(?i)({pattern})', '% --- {name} ---' || chr(10) || '\\1', 'g')"
    return x


_TEX = r"'% note ' || turn::varchar || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || '\section{Introduction}' || chr(10) || '% --- kept ---' || chr(10) || text"
_CLEAN = f"array_to_string(list_transform(string_split({_TEX}, chr(10)), lambda x: case when x like '\\%%' escape '\\' and x not like '\\% ---%' escape '\\' then '' else x end), chr(10))"
ORACLES["tex_preprocess"] = f"select conv_id, turn, {marked(rf"regexp_replace({_CLEAN}, '\n[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*\n', chr(10) || chr(10), 'g')")} as content from conversations"
ORACLES["section_markers"] = "select conv_id, turn, " + marked(r"(['\begin{abstract}', '\section*{Our METHODS}', '\section{Results of it}', '\section{Conclusion}', '\begin{thebibliography}'])[turn % 5 + 1] || chr(10) || text") + " as content from conversations"

# --- templates and trees ----------------------------------------------------------------------------------------------
ORACLES["skeleton_flatten"] = """select 'r' || r_regionkey as id, r_name as path_key, 1 as depth, r_regionkey::varchar as sort_key from region
union all select 'n' || n_nationkey, r_name || ' -> ' || n_name, 2, r_regionkey || '.' || n_nationkey from nation join region on n_regionkey = r_regionkey
union all select 'c' || c_custkey, r_name || ' -> ' || n_name || ' -> ' || c_name, 3, r_regionkey || '.' || n_nationkey || '.' || c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
_NODES = f"""{TREES_SQL},
nodes as (select r_regionkey as doc_id, [r_name] as path, [0] as sk, '' as content from region
  union all select n_regionkey, [r_name, n_name], [0, n_nationkey], n_name from nation join region on n_regionkey = r_regionkey
  union all select n_regionkey, [r_name, n_name, c_mktsegment], [0, n_nationkey, row_number() over (partition by n_nationkey order by c_mktsegment)], count(*)::varchar
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_regionkey, r_name, n_name, n_nationkey, c_mktsegment)"""
ORACLES["tree_outline"] = f"with {_NODES} select doc_id, string_agg(repeat('  ', len(path) - 1) || '- ' || path[-1], chr(10) order by sk) as text from nodes group by doc_id"

# --- mapping ----------------------------------------------------------------------------------------------------------
_BEST = "best as (select doc_id, chunk_id, node_idx, score from (select *, row_number() over (partition by doc_id, chunk_id order by score desc, node_idx) as k from scores) where k = 1)"
ORACLES["map_argmax"] = f"with {VECTORS_SQL}, {_BEST} select doc_id, chunk_id, node_idx, round(score, 6) as score from best"
ORACLES["map_orphans"] = f"with {VECTORS_SQL}, {_BEST} select case when score >= 0.3 then 'semantic' else 'orphan' end as method, case when score >= 0.3 then node_idx else -1 end as node_idx, count(*) as n, round(max(score), 6) as best from best group by all"
ORACLES["reference_edges"] = """with l as (select l_orderkey as doc_id, l_partkey % 7 as label, max(l_linenumber - 1)::int as dst from lineitem group by all)
select distinct r.l_orderkey as doc_id, (r.l_linenumber - 1)::int as src, l.dst from lineitem r join l on l.doc_id = r.l_orderkey and l.label = r.l_suppkey % 7"""
ORACLES["map_second"] = f"""with {VECTORS_SQL}, ranked as (select *, row_number() over (partition by doc_id, chunk_id order by score desc, node_idx) as k from scores)
select a.doc_id, a.chunk_id, a.node_idx, b.node_idx as second_idx, round(b.score, 6) as second_score, round(a.score - b.score, 6) as margin from ranked a left join ranked b on b.doc_id = a.doc_id and b.chunk_id = a.chunk_id and b.k = 2 where a.k = 1"""
_TIMES = f"""with {VECTORS_SQL.replace("scores as materialized", "plain as materialized")}, {EDGES_SQL},
first as (select doc_id, chunk_id, node_idx, score from (select *, row_number() over (partition by doc_id, chunk_id order by score desc, node_idx) as k from plain) where k = 1),
times as (select e.doc_id, e.src as chunk_id, b.node_idx, count(*) as times from edges e join first b on b.doc_id = e.doc_id and b.chunk_id = e.dst where b.score >= 0.3 group by all)"""
ORACLES["graph_boost"] = f"""{_TIMES},
scores as (select s.doc_id, s.chunk_id, s.node_idx, case when times > 0 then least(1.0, score + 0.5 * times) else score end as score from plain s left join times t using (doc_id, chunk_id, node_idx)),
{_BEST} select doc_id, chunk_id, node_idx, round(score, 6) as score from best"""
ORACLES["graph_corrections"] = f"{_TIMES} select doc_id, chunk_id, node_idx, times, round(least(1.0, score + 0.5 * times), 6) as score from times join plain using (doc_id, chunk_id, node_idx)"
_PLACED = f"{VECTORS_SQL}, {_BEST}, {EDGES_SQL}, placed as (select doc_id, chunk_id, case when score >= 0.15 then node_idx end as node_idx from best)"
_NEAR = """near as (select doc_id, chunk_id, a as node_idx from (select *, lag(node_idx) over w as a, lead(node_idx) over w as b, lag(chunk_id) over w as ia, lead(chunk_id) over w as ib from placed window w as (partition by doc_id order by chunk_id))
  where node_idx is null and a = b and ia = chunk_id - 1 and ib = chunk_id + 1)"""
_FAR = "far as (select e.doc_id, e.src as chunk_id, arg_min(p.node_idx, e.ref_pos) as node_idx from edges e join placed o on o.doc_id = e.doc_id and o.chunk_id = e.src and o.node_idx is null join placed p on p.doc_id = e.doc_id and p.chunk_id = e.dst and p.node_idx is not null group by e.doc_id, e.src)"
ORACLES["neighbor_rescue"] = f"with {_PLACED}, {_NEAR} select * from near"
ORACLES["graph_rescue"] = f"with {_PLACED}, {_FAR} select * from far"
ORACLES["cohesion"] = f"""with {_PLACED}, {_NEAR}, {_FAR}
select p.doc_id, p.chunk_id, coalesce(p.node_idx, n.node_idx, f.node_idx, -1) as node_idx, case when p.node_idx is not null then 'semantic' when n.node_idx is not null then 'neighbor' when f.node_idx is not null then 'graph' else 'orphan' end as method
from placed p left join near n using (doc_id, chunk_id) left join far f using (doc_id, chunk_id)"""
ORACLES["model_rescue"] = f"""with {_PLACED} select p.doc_id, p.chunk_id, coalesce(p.node_idx, case when p.chunk_id % 2 = 0 then c.node_idx end, -1)::int as node_idx,
case when p.node_idx is not null then 'semantic' when p.chunk_id % 2 = 0 and c.node_idx is not null then 'llm' else 'orphan' end as method from placed p left join cent c on c.node_idx = p.doc_id"""


def counts(source: str, key: str, text: str, name: str) -> str:
    return rf"{name} as (select {key} as id, term, count(*) as tf from (select {key}, unnest(list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as term from {source}) group by all)"


ORACLES["text_map"] = f"""with t as (select conv_id * 1000 + turn as id, text from conversations), {counts("t", "id", "text", "a")}, {counts("benchmark", "item_id", "text", "b")},
na as (select id, sqrt(sum(tf * tf)) as n from a group by id), nb as (select id, sqrt(sum(tf * tf)) as n from b group by id),
s as (select a.id, b.id as node, sum(a.tf * b.tf) / (any_value(na.n) * any_value(nb.n)) as score from a join b using (term) join na on na.id = a.id join nb on nb.id = b.id group by a.id, b.id),
best as (select * from (select *, row_number() over (partition by id order by score desc, node) as k from s) where k = 1)
select t.id // 1000 as doc_id, (t.id % 1000)::int as chunk_id, case when score >= 0.3 then node else -1 end::int as node_idx, round(coalesce(score, 0), 6) as score, case when score >= 0.3 then 'semantic' else 'orphan' end as method from t left join best using (id)"""
ORACLES["node_contents"] = "select conv_id as doc_id, (turn % 2)::int as node_idx, string_agg(text, chr(10) || chr(10) order by turn) as node_content from conversations group by conv_id, turn % 2"

# --- text functions ---------------------------------------------------------------------------------------------------


def rewritten(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"
    return x


_LATEX = [(r"(?m)^#{4}\s*(.+)$", r"\\subsection{\1}"), (r"(?m)^#{3}\s*(.+)$", r"\\section{\1}"), (r"\*\*([^*]+)\*\*", r"\\textbf{\1}"), (r"\*([^*]+)\*", r"\\textit{\1}"), (r"(?m)^-\s+(.+)$", r"\\item \1")]
_MARKDOWN = [(r"\\section\{([^}]+)\}", r"### \1"), (r"\\subsection\{([^}]+)\}", r"#### \1"), (r"\\textbf\{([^}]+)\}", r"**\1**"), (r"\\textit\{([^}]+)\}", r"*\1*")]
ORACLES["format_enforce_latex"] = "select doc_id, " + rewritten("'### Title' || chr(10) || '- item' || chr(10) || text", _LATEX) + " as fixed from documents"
ORACLES["format_enforce_markdown"] = "select doc_id, " + rewritten(r"'\section{A} \subsection{B} \textbf{c} \textit{d}' || chr(10) || text", _MARKDOWN) + " as fixed from documents"
ORACLES["format_issues"] = r"""select doc_id, array_to_string(list_filter([case when regexp_matches(text, '(?m)^#{1,6}\s') then 'INVALID: Use \section{} not ###' end, case when regexp_matches(text, '\*\*([^*]+)\*\*') then 'INVALID: Use \textbf{} not **text**' end,
  case when regexp_matches(text, '\*([^*]+)\*') then 'INVALID: Use \textit{} not *text*' end, case when regexp_matches(text, '(?m)^-\s') then 'INVALID: Use \begin{itemize} not - lists' end, case when regexp_matches(text, '```') then 'INVALID: Use \begin{verbatim} not ```' end], lambda x: x is not null), '; ') as latex_issues,
array_to_string(list_filter([case when regexp_matches(text, '\\section\{') then 'INVALID: Use ### not \section{}' end, case when regexp_matches(text, '\\textbf\{') then 'INVALID: Use **text** not \textbf{}' end, case when regexp_matches(text, '\\begin\{itemize\}') then 'INVALID: Use - lists not \begin{itemize}' end], lambda x: x is not null), '; ') as markdown_issues from documents"""
ORACLES["content_quality"] = f"""with b as (select doc_id, {strip("coalesce(text, '')")} as t from documents), w as (select *, {words("t")} as ws, list_filter(string_split(t, '.'), lambda s: regexp_matches(s, {NOT_BLANK})) as ss from b),
n as (select *, len(ws) as n, len(list_distinct(ws)) as dn, list_sum(list_transform(ss, lambda s: len({words("s")}))) as sl from w),
r as (select *, case when t = '' then 0.0 when length(t) < 10 then 0.2 when n < 3 then 0.3 when dn::double / n < 0.3 then 0.4
  when contains(lower(t), 'xyz abc def') or contains(lower(t), 'lorem ipsum') or contains(lower(t), 'test test test') or contains(lower(t), 'invalid content') or contains(lower(t), 'placeholder text') then 0.1
  when len(ss) > 0 and sl::double / len(ss) < 3 then 0.3 end as refused,
  least(length(t) / 100.0::double, 1.0) * 0.3 + dn::double / greatest(n, 1) * 0.3 + case when regexp_matches(t, '[.!?]') then 1.0 else 0.5 end * 0.2 + case when dn >= 5 then 1.0 else 0.5 end * 0.2 as s from n)
select doc_id, refused is null and s >= 0.6 as is_valid, round(coalesce(refused::double, s::double), 6) as score from r"""
ORACLES["section_summary"] = f"""with b as (select doc_id, {strip("coalesce(text, '')")} as t from documents), p as (select *, string_split(t, '. ') as ss from b),
m as (select *, array_to_string([ss[1], ss[len(ss) // 2 + 1], ss[len(ss)]], '. ') as j from p)
select doc_id, case when length(t) <= 200 then t when len(ss) <= 3 then case when length(t) > 500 then left(t, 500) || '...' else t end when length(j) > 400 then left(j, 400) || '...' else j end as summary from m"""
ORACLES["response_validation"] = f"""with b as (select conv_id, turn, {strip("case when turn % 4 = 0 then '  % Error: ' || text when turn % 4 = 1 then left(text, 9) else ' ' || text || chr(10) end")} as t from conversations),
r as (select *, case when length(t) < 10 then 'short' when lower(t) like '\\% error%' escape '\\' or lower(t) like '\\% api error%' escape '\\' or lower(t) like 'error:%' then 'error' else '' end as reason from b)
select conv_id, turn, reason = '' as ok, case when reason = '' then t else '' end as text, reason from r""".replace("\\\\", "\\")
ORACLES["regex_matches"] = r"select doc_id, len(regexp_extract_all(text, '\d+'))::bigint as n, array_to_string(regexp_extract_all(text, '\d+'), ',') as found from documents"
_P1, _P2 = PROMPTS["term_extraction"].split("{full_text_excerpt}")
ORACLES["prompts_and_replies"] = f"""select conv_id, turn, {strip("text")} as polished, role || '|b' || turn::varchar as path,
array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: {strip("x")}), lambda x: x <> ''), '|') as parts, case when length(text) > 30 then left(text, 30) || '...' else text end as start, right(text, 30) as ending,
{q(_P1)} || left(text, 4000) || {q(_P2)} as prompt from conversations"""
ORACLES["file_names"] = """with f as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p from pages), n as (select page_id, regexp_extract(p, '([^/]*)$', 1) as n from f), m as (select page_id, case when n like '%.tex' then n else n || '.tex' end as filename from n)
select page_id, filename, '1_A_b_Part_' || page_id::varchar || '.tex' as safe, replace(filename, '.tex', '_preprocessed.tex') as preprocessed from m"""
ORACLES["main_files"] = """with m as (select l_orderkey as archive, l_linenumber as pos, l_partkey % 5 = 0 as usual, case when l_partkey % 5 = 0 then 'src/main.tex' else 'src/x' || l_partkey::varchar || '.tex' end as path from lineitem)
select archive, path as main from (select *, row_number() over (partition by archive order by usual desc, pos, path) as k from m) where k = 1"""
ORACLES["include_resolution"] = r"select '/t/r' || n_regionkey || '.tex' as path, string_agg('<' || n_name || ' \input{r' || n_regionkey || '}>', '+' order by n_nationkey) || '\include{gone}' as content from nation group by n_regionkey"
ORACLES["session_ids"] = "select o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') as session_id from orders"

# --- similarity -------------------------------------------------------------------------------------------------------
_PAIRS = "pairs as (select a.doc_id as pair_id, a.text as a, b.text as b from documents a join documents b on b.doc_id = a.doc_id + 1)"


def similarity(pairs: str, a: str, b: str) -> str:
    return f"""{counts(pairs, "pair_id", a, "ta")}, {counts(pairs, "pair_id", b, "tb")}, na as (select id, sqrt(sum(tf * tf)) as n from ta group by id), nb as (select id, sqrt(sum(tf * tf)) as n from tb group by id),
dots as (select ta.id, sum(ta.tf * tb.tf) as d from ta join tb using (id, term) group by ta.id),
sims as (select p.*, coalesce(d / (na.n * nb.n), 0.0) as similarity from {pairs} p left join dots on dots.id = pair_id left join na on na.id = pair_id left join nb on nb.id = pair_id)"""


ORACLES["preservation_batch"] = f"with {_PAIRS}, {similarity('pairs', 'a', 'b')} select pair_id, round(similarity, 6) as similarity, round(similarity, 6) >= 0.75 as is_valid from sims"
ORACLES["validation_stats"] = f"with {_PAIRS}, {similarity('pairs', 'a', 'b')}, r as (select round(similarity, 6) as s from sims) select count(*) as total, count_if(s >= 0.75) as passed, count_if(s < 0.75) as failed, round(avg(s), 6) as average_similarity, round(avg((s >= 0.75)::int), 6) as success_rate from r"
ORACLES["text_coherence"] = f"""with {_PAIRS}, chosen as (select pair_id, a, case when pair_id % 3 = 0 then a || ' ' when pair_id % 3 = 1 then '' else b end as b from pairs), {similarity('chosen', 'a', 'b')}
select pair_id, round(case when {strip("a")} = '' or {strip("b")} = '' then 0.0 when {strip("a")} = {strip("b")} then 1.0 else similarity end, 6) as coherence from sims"""
ORACLES["running_mean"] = "select user_id, event_id, round(avg(value) over (partition by user_id order by event_id rows unbounded preceding), 6) as running_mean from events"
ORACLES["coherence_by_label"] = """with v as (select label, vec_id, embedding::double[] as e from embeddings), n as (select label, count(*) as n from v group by label),
p as (select a.label, avg(list_cosine_similarity(a.e, b.e)) as c from v a join v b on a.label = b.label and a.vec_id < b.vec_id group by a.label) select label, n, round(case when n < 2 then 1.0 else c end, 6) as coherence from n left join p using (label)"""
_NOW = "timestamp '2024-01-30 12:00:00'"
_REC = f"greatest(0.1, 1 - (epoch_us({_NOW}) - epoch_us(timestamp)) / 3.6e9 / 24)"
ORACLES["item_scores"] = f"with {ITEMS_SQL} select position, round({_REC}, 6) as recency, round(relevance_score * 0.6 + importance_score * 0.3 + {_REC} * 0.1, 6) as combined, round(importance_score * 0.4 + relevance_score * 0.4 + least(usage_count / 10.0, 0.2), 6) as retention from items"

# --- context ----------------------------------------------------------------------------------------------------------
ORACLES["build_context"] = f"""with pairs as (select doc_id as pair_id, b.item_id, d.text, b.text as query from documents d join benchmark b on b.item_id = regexp_extract(source, '[0-9]+')::bigint), {similarity('pairs', 'text', 'query')},
r as (select *, length(text) as l, row_number() over w as k, sum(length(text)) over (w rows unbounded preceding) + 2 * (row_number() over w - 1) as s from sims where regexp_matches(text, {NOT_BLANK}) window w as (partition by item_id order by round(similarity, 6) desc, pair_id)),
o as (select *, sum((s > 2000)::int) over (partition by item_id order by k rows unbounded preceding) as over_ from r),
p as (select *, case when over_ = 0 then text when over_ = 1 and s > 2000 and 2000 - (s - l) > 50 then left(text, (2000 - (s - l))::int) || '...' end as part from o),
j as (select item_id, string_agg(part, chr(10) || chr(10) order by k) as c from p where part is not null group by item_id)
select item_id, case when length(c) > 2000 then left(c, 1997) || '...' else c end as context from j"""
ORACLES["context_prune"] = f"""with {ITEMS_SQL}, r as (select *, importance_score * 0.4 + relevance_score * 0.4 + least(usage_count / 10.0::double, 0.2) as ret, sum(length(content)) over (partition by user_id) as total from items),
k as (select *, sum(length(content)) over (partition by user_id order by ret desc, position rows unbounded preceding) as s, row_number() over (partition by user_id order by ret desc, position) as rk, row_number() over (partition by user_id order by position) as came from r)
select user_id, position, case when total <= 400 then came else rk end as kept_rank from k where total <= 400 or s <= 400"""
ORACLES["relevant_context"] = f"""with {ITEMS_SQL}, r as (select *, row_number() over (partition by user_id order by relevance_score * 0.6 + importance_score * 0.3 + {_REC} * 0.1 desc, position) as k from items)
select user_id, string_agg('[' || upper(context_type) || case when coalesce(section_name, '') <> '' then ' (' || section_name || ')' else '' end || ']: ' || left(content, 300), chr(10) || chr(10) order by k) as context, count(*) as n_items from r where k <= 5 group by user_id"""
ORACLES["document_context"] = f"with {ITEMS_SQL} select user_id, string_agg(case when length(content) > 200 then left(content, 200) || '...' else content end, chr(10) || chr(10) order by importance_score desc, position) as context from items group by user_id"
ORACLES["context_stats"] = f"with {ITEMS_SQL} select user_id, round(avg(relevance_score), 6) as avg_relevance, count(*) as n_items, sum(length(content))::bigint as total_chars from items group by user_id"
ORACLES["section_index"] = f"with {ITEMS_SQL} select user_id, section_name, string_agg(position::varchar, ',' order by position) as positions from items where section_name <> '' group by all"

# --- analysis ---------------------------------------------------------------------------------------------------------


def element_counts(where: str, name: str) -> str:
    kind = "(['figure', 'table', 'equation', 'paragraph'])[l_linenumber % 4 + 1]"
    return f"""{name} as (select l_orderkey as doc_id, count(distinct l_returnflag) as sections, count(distinct l_returnflag || '>' || l_linestatus) as subsections, 0::bigint as subsubsections, count_if({kind} = 'figure') as figure, count_if({kind} = 'table') as "table",
count_if({kind} = 'equation') as equation, count(*) as chunks, sum(length(l_linenumber::varchar))::bigint as chars from lineitem {where} group by l_orderkey)"""


_OP = f"{element_counts('', 'o')}, {element_counts("where l_returnflag <> 'R'", 'p')}"


def rate(e: str) -> str:
    return f'case when o."{e}" > 0 then p."{e}" / o."{e}"::double * 100 when p."{e}" = 0 then 100.0::double else 0.0::double end'


ORACLES["element_counts"] = f"with {element_counts('', 'o')} select * from o"
ORACLES["preservation_report"] = f"with {_OP} " + " union all ".join(f'select doc_id, {q(e)} as element, o."{e}" as original, p."{e}" as processed, round({rate(e)}, 6) as rate from o join p using (doc_id)' for e in ("sections", "figure", "table", "equation"))
_CHANGE = "case when o.chars > 0 then (p.chars - o.chars) / o.chars::double * 100 else 0.0 end"
ORACLES["structure_change"] = f"with {_OP} select doc_id, round({_CHANGE}, 6) as char_change_percent, o.sections as original_sections, p.sections as processed_sections, o.subsections + o.subsubsections as original_depth, p.subsections + p.subsubsections as processed_depth from o join p using (doc_id)"
_SCORE = "greatest(0.0, least(100.0, 100.0 - " + " - ".join(f"case when {rate(e)} < 95 then (1 - {rate(e)} / 100) * 10 else 0.0 end" for e in ("equation", "figure", "table")) + f" - case when abs({_CHANGE}) > 25 then 20.0 else 0.0 end + case when p.subsections + p.subsubsections > o.subsections + o.subsubsections then 5.0 else 0.0 end))"
ORACLES["quality_score"] = f"with {_OP} select doc_id, round({_SCORE}::double, 6) as quality_score from o join p using (doc_id)"
_LINE = " || chr(10) || ".join(f"printf('| {e.capitalize():<9} | %-8d | %-9d | %.1f%%              |', o.\"{e}\", p.\"{e}\", ({rate(e)})::double)" for e in ("sections", "figure", "table", "equation"))
ORACLES["quality_report"] = f"""with {_OP} select doc_id, '# Document Processing Analysis Report' || chr(10) || '---' || chr(10) || printf('**Overall Quality Score: %.1f/100**', ({_SCORE})::double) || chr(10) || chr(10) || '## 1. Content Preservation Analysis' || chr(10)
|| '| Element   | Original | Processed | Preservation Rate |' || chr(10) || '|-----------|----------|-----------|-------------------|' || chr(10) || {_LINE} || chr(10) || chr(10) || '## 2. Structural & Size Analysis' || chr(10)
|| printf('- **Character Count Change:** %+.1f%%', ({_CHANGE})::double) || chr(10) || printf('- **Section Count:** %d -> %d', o.sections, p.sections) || chr(10) || printf('- **Subsection/Depth Count:** %d -> %d', o.subsections + o.subsubsections, p.subsections + p.subsubsections) as report from o join p using (doc_id)"""
ORACLES["contribution_report"] = "select md5(text) as chunk_id, count(distinct source) as n_sections, left(min(text), 100) || '...' as excerpt from documents group by md5(text)"
ORACLES["contribution_summary"] = "with c as (select md5(text) as m, count(distinct source) as n from documents group by 1) select count(*) as n_chunks, count_if(n > 1) as n_reused, (select count(distinct source) from documents) as n_sections from c"
ORACLES["preserved_elements"] = " union all ".join(
    f"select conv_id, turn, {q(e)} as element, len(regexp_extract_all('\\begin{{itemize}}' || text || '```', {q(p)}))::bigint as original, len(regexp_extract_all(text || '```', {q(p)}))::bigint as final, len(regexp_extract_all('\\begin{{itemize}}' || text || '```', {q(p)})) = len(regexp_extract_all(text || '```', {q(p)})) as preserved from conversations"
    for e, p in KEPT.items()
)

# --- combining --------------------------------------------------------------------------------------------------------
_WOVEN = "w as (select b.doc_id, b.path_key, case when b.content <> '' and a.content <> '' then b.content || chr(10) || chr(10) || a.content else b.content end as content, coalesce(b.content <> '' and a.content <> '', false) as woven from base b left join aug a using (doc_id, path_key))"
_NEW = "n as (select * from aug a where not exists (select 1 from base b where b.doc_id = a.doc_id and b.path_key = a.path_key))"
ORACLES["combine_robust"] = f"with {TREES_SQL}, {_NEW} select * from base union all select * from n"
ORACLES["combine_merge"] = f"with {TREES_SQL}, {_NEW}, {_WOVEN} select doc_id, path_key, content from w union all select * from n"
ORACLES["combine_append"] = f"with {TREES_SQL} select doc_id, 'Part I - ' || path_key as path_key, content from base union all select doc_id, 'Part II - ' || path_key, content from aug"
ORACLES["tree_overlap"] = f"with {TREES_SQL} select * from base b where exists (select 1 from aug a where b.doc_id = a.doc_id and b.path_key = a.path_key)"
ORACLES["tree_only_new"] = f"with {TREES_SQL}, {_NEW} select * from n"
ORACLES["tree_weave"] = f"with {TREES_SQL}, {_WOVEN} select * from w"
ORACLES["tree_graft"] = """with nat as (select *, coalesce(lead(n_name) over w, first_value(n_name) over w) as to_name, coalesce(lead(n_nationkey) over w, first_value(n_nationkey) over w) as to_key from nation window w as (partition by n_regionkey order by n_nationkey)),
seg as (select n_nationkey, c_mktsegment as leaf, count(*)::varchar as content from customer join nation on c_nationkey = n_nationkey group by all),
sup as (select n_nationkey, case when s_suppkey % 3 = 0 then 'BUILDING' else 'S' || (s_suppkey % 3)::varchar end as leaf, count(*)::varchar as content from supplier join nation on s_nationkey = n_nationkey group by all),
old as (select *, row_number() over (partition by n_nationkey order by leaf) as k from seg),
new as (select * from (select *, row_number() over (partition by n_nationkey order by leaf) as k from sup) x where not exists (select 1 from seg where seg.n_nationkey = x.n_nationkey and seg.leaf = x.leaf)),
r as (select n_regionkey as doc_id, n_name as path_key, n_name as content, [n_nationkey::bigint] as sk from nation
  union all select n_regionkey, n_name || ' -> ' || leaf, content, [n_nationkey, k] from old join nat using (n_nationkey)
  union all select n_regionkey, case when leaf = 'S1' then to_name else n_name end || ' -> ' || leaf, content, [case when leaf = 'S1' then to_key else n_nationkey end, k + 1000000] from new join nat using (n_nationkey))
select doc_id, path_key, content, row_number() over (partition by doc_id order by sk, path_key) as place from r"""

# --- rendering and processing -----------------------------------------------------------------------------------------


def heading(fmt: str) -> str:
    if fmt == "markdown":
        return "repeat('#', len(path)) || ' ' || path[-1]"
    return "'\\' || (['section', 'subsection', 'subsubsection', 'paragraph'])[least(len(path), 4)] || '{' || path[-1] || '}'"


def rendered(fmt: str, tail: str) -> str:
    parts = f"string_agg({heading(fmt)} || case when content <> '' then chr(10) || content else '' end, chr(10) order by sk)"
    header = f"{q(HEADERS[fmt])} || chr(10) || " if HEADERS[fmt] else ""
    footer = f" || chr(10) || {q(FOOTERS[fmt])}" if FOOTERS[fmt] else ""
    return f"body as (select doc_id, {parts} as b from nodes group by doc_id) select doc_id, {header}b{tail}{footer} as document from body"


ORACLES["render_latex"] = f"with {_NODES}, orphans as (select s_suppkey % 5 as doc_id, string_agg(s_name, chr(10) || chr(10) order by s_suppkey) as rest from supplier group by 1), " + rendered("latex", f" || coalesce(chr(10) || {q(ORPHANS['latex'])} || chr(10) || rest, '')") + " left join orphans using (doc_id)"
ORACLES["render_markdown"] = f"with {_NODES}, " + rendered("markdown", "")
ORACLES["render_json"] = f"""with {_NODES} select doc_id, '[' || string_agg('{{"title":"' || path[-1] || '","depth":' || len(path)::varchar || ',"content":"' || content || '"}}', ',' order by sk) || ']' as document from nodes group by doc_id"""
ORACLES["full_text"] = f"with {_NODES} select doc_id, string_agg(content, chr(10) || chr(10) order by sk) || chr(10) || chr(10) as text from nodes where content <> '' group by doc_id"
ORACLES["transitions"] = "with n as (select conv_id as doc_id, turn, case when role = 'system' then '' else text end as t from conversations) select doc_id, turn, coalesce(t <> '' and lag(t) over (partition by doc_id order by turn) <> '', false) as has_pair from n"
ORACLES["circuit_breaker"] = """with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 as t, case event_type when 'error' then 'fail' when 'view' then 'allow' else 'success' end as outcome, row_number() over (partition by user_id order by event_id) as k from events),
f as (select user_id, event_id, k, t, outcome, true as allowed, false as open, 0 as failures, case when outcome = 'fail' then 1 else 0 end as n, false as o, null::double as l from e where k = 1
  union all select x.user_id, x.event_id, x.k, x.t, x.outcome, a, f.o, f.n,
    case when not a or x.outcome = 'allow' then f.n when x.outcome = 'fail' then f.n + 1 else 0 end,
    case when not a or x.outcome = 'allow' then f.o when x.outcome = 'fail' then f.o or f.n + 1 >= 2 else false end,
    case when not a or x.outcome = 'allow' then f.l when x.outcome = 'fail' then case when f.n + 1 >= 2 then x.t else f.l end else null end
  from f join e x on x.user_id = f.user_id and x.k = f.k + 1, lateral (select not f.o or coalesce(x.t - f.l >= 86400, false) as a))
select user_id, event_id, outcome, allowed, open, failures from f"""


# --- models that echo, files, streams ---------------------------------------------------------------------------------
def filled(name: str, **fields: str) -> str:
    """A prompt with SQL expressions in its fields, cut as the echo cuts it."""
    parts, rest = [], PROMPTS[name]
    while rest:
        found = [(at, f) for f in fields if (at := rest.find("{" + f + "}")) >= 0]
        if not found:
            parts.append(q(rest))
            break
        at, field = min(found)
        parts += [q(rest[:at]), f"coalesce({fields[field]}, '')"]
        rest = rest[at + len(field) + 2 :]
    return f"left({' || '.join(parts)}, 8192)"


def refactored(parent: str) -> str:
    return rewritten(filled("hierarchical_refactor", node_path="array_to_string(n.path, ' -> ')", global_context=q(CONTEXT), parent_context=parent, node_content="n.content"), _LATEX)


ORACLES["process_tree"] = f"""with {_NODES}, one as (select n.doc_id, n.path, case when content <> '' then {refactored("''")} else '' end as p from nodes n where len(path) = 1),
two as (select n.doc_id, n.path, case when content <> '' then {refactored("u.p")} else '' end as p from nodes n left join one u on u.doc_id = n.doc_id and u.path = n.path[1:1] where len(n.path) = 2),
three as (select n.doc_id, n.path, case when content <> '' then {refactored("u.p")} else '' end as p from nodes n left join two u on u.doc_id = n.doc_id and u.path = n.path[1:2] where len(n.path) = 3)
select doc_id, array_to_string(path, ' -> ') as path_key, p as processed_content, '' as issues from (from one union all from two union all from three)"""
ORACLES["process_node"] = f"""with {_NODES}, whole as (select doc_id, string_agg(content, chr(10) || chr(10) order by sk) || chr(10) || chr(10) as text from nodes where content <> '' group by doc_id)
select n.doc_id, array_to_string(n.path, ' -> ') as path_key, case when n.path = ['ASIA'] then {rewritten(filled("hierarchical_refactor", node_path="array_to_string(n.path, ' -> ')", global_context=q(CONTEXT), parent_context="'N/A'", node_content="text"), _LATEX)} else n.content end as processed_content
from nodes n join whole using (doc_id)"""
_TERMS = f"list_filter(list_transform(string_split({filled('term_extraction', full_text_excerpt='left(text, 4000)')}, ','), lambda x: {strip('x')}), lambda x: x <> '')"
ORACLES["polish"] = f"""with {_NODES}, whole as (select doc_id, string_agg(content, chr(10) || chr(10) order by sk) || chr(10) || chr(10) as text from nodes where content <> '' group by doc_id),
terms as (select doc_id, {_TERMS} as terms from whole),
said as (select n.doc_id, n.path, n.sk, case when content <> '' and len(terms) > 0 then {filled("term_standardization", key_terms_list="array_to_string(terms, ', ')", text_content="content")} else content end as t from nodes n left join terms using (doc_id)),
pairs as (select *, lag(t) over w as before, lag(path[-1]) over w as title from said window w as (partition by doc_id, path[:-2] order by sk))
select doc_id, array_to_string(path, ' -> ') as path_key, case when before <> '' and t <> '' then {filled("section_transition", prev_section_title="title", prev_section_ending="right(before, 300)", current_section_title="path[-1]", current_section_beginning="left(t, 300)")} || chr(10) || chr(10) || t else t end as processed_content from pairs"""
ORACLES["latex_chunks"] = rf"""with d as (select doc_id, {strip("left(text, 200)")} as a, {strip("text")} as b from documents),
c as (select doc_id, 0 as k, 'paragraph' as type, a as content, 'A' as parent_section, '' as labels, '' as refs, '' as caption from d
union all select doc_id, 1, 'figure', '\begin{{figure}}\caption{{c}}\label{{f}}' || doc_id || '\end{{figure}}', 'A', 'f', '', 'c' from d
union all select doc_id, 2, 'paragraph', 'see \ref{{f}}', 'A', '', 'f', '' from d
union all select doc_id, 3, 'paragraph', b, 'A -> B', '', '', '' from d)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_id, type, parent_section, content, labels, refs, caption from c where content <> ''"""
ORACLES["mapped_groups"] = ORACLES["text_map"]
_MAPPED = """mapped as (select p.doc_id, p.chunk_id, coalesce(p.node_idx, n.node_idx, f.node_idx, -1) as node_idx, case when p.node_idx is not null then 'semantic' when n.node_idx is not null then 'neighbor' when f.node_idx is not null then 'graph' else 'orphan' end as method
from placed p left join near n using (doc_id, chunk_id) left join far f using (doc_id, chunk_id))"""
ORACLES["map_whole"] = f"""with {VECTORS_SQL.replace("scores as materialized", "plain as materialized")}, edges as (select a.doc_id, a.chunk_id as src, b.chunk_id as dst, 0 as ref_pos from v a join v b on a.doc_id = b.doc_id and b.chunk_id = (a.chunk_id * 7 + 3) % 11),
first as (select doc_id, chunk_id, node_idx, score from (select *, row_number() over (partition by doc_id, chunk_id order by score desc, node_idx) as k from plain) where k = 1),
times as (select e.doc_id, e.src as chunk_id, b.node_idx, count(*) as n from edges e join first b on b.doc_id = e.doc_id and b.chunk_id = e.dst where b.score >= 0.45 group by all),
scores as (select s.doc_id, s.chunk_id, s.node_idx, case when n > 0 then least(1.0, score + 0.5 * n) else score end as score from plain s left join times t using (doc_id, chunk_id, node_idx)),
{_BEST}, placed as (select doc_id, chunk_id, case when score >= 0.15 then node_idx end as node_idx from best), {_NEAR}, {_FAR}, {_MAPPED}
select doc_id, chunk_id, node_idx, method, case when case when method = 'neighbor' then lag(method) over w else method end = 'graph' then 2 else 0 end as rank_group, case when method = 'neighbor' then chunk_id - 1 else chunk_id end as anchor
from mapped window w as (partition by doc_id order by chunk_id)"""
ORACLES["regex_groups"] = r"""with f as (select doc_id, regexp_extract_all(text, '([A-Z])([a-z]+)', 1) as a, regexp_extract_all(text, '([A-Z])([a-z]+)', 2) as b from documents)
select doc_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || '+' || b[i]), ',') as found from f"""
ORACLES["node_files"] = f"with {_NODES} select array_to_string(list_transform(path, lambda x: replace(replace(x, ' ', '_'), '.', '')), '_') || '.tex' as filename, content from nodes where content <> ''"
ORACLES["final_documents"] = "select document from (" + ORACLES["render_json"] + ")"
ORACLES["session_log"] = "select strftime(o_orderdate, '%Y%m') as session_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as ts, 'order ' || o_orderkey as message from orders"
ORACLES["stage_checkpoint"] = f"with {_NODES} select doc_id, array_to_string(path, ' -> ') as path_key, content from nodes"
ORACLES["latest_documents"] = "select lpad(max(event_id)::varchar, 12, '0') as session_id, 'u' || user_id || '/' || event_type as path, arg_max(props, event_id) as content from events group by user_id, event_type"
ORACLES["section_details"] = f"with {_NODES} select doc_id, string_agg('- ' || array_to_string(path, ' -> ') || ': ' || content, chr(10) order by sk) as text from nodes group by doc_id"
ORACLES["breaker_stream"] = "select user_id, event_id, outcome, allowed, failures from (" + ORACLES["circuit_breaker"] + ")"
ORACLES["validation_stream"] = "select event_type as key, count(*) as total, count_if(value >= 50) as passed, round(avg(value), 6) as average_similarity from events group by event_type"

_SECTIONS = ", ".join(f"({r[1]}, {q(r[3])}, {'null' if r[4] is None else r[4]}::int, {r[5]}, {q(r[6])}, {str(r[10]).lower()}, {str(r[11]).lower()}, {q(r[9] or '')})" for r in flatten(TEMPLATES["bitcoin_paper_hierarchical"]))
ORACLES["template_skeleton"] = f"""with tpl as (select * from (values {_SECTIONS}) t(node_idx, path_key, parent_idx, depth, title, generative, dynamic_subsections, description)),
t as (select conv_id * 1000 + turn as id, text from conversations), {counts("t", "id", "text", "a")}, {counts("tpl", "node_idx", "description", "b")},
na as (select id, sqrt(sum(tf * tf)) as n from a group by id), nb as (select id, sqrt(sum(tf * tf)) as n from b group by id),
s as (select a.id, b.id as node, sum(a.tf * b.tf) / (any_value(na.n) * any_value(nb.n)) as score from a join b using (term) join na on na.id = a.id join nb on nb.id = b.id group by a.id, b.id),
best as (select * from (select *, row_number() over (partition by id order by score desc, node) as k from s) where k = 1 and score >= 0.05),
n as (select node, count(*) as n_chunks from best group by node)
select tpl.* exclude (description), coalesce(n_chunks, 0) as n_chunks from tpl left join n on n.node = tpl.node_idx"""
ORACLES["recombined"] = f"with {_NODES}, p as (select doc_id, array_to_string(path, ' -> ') as path_key, case when path[1] like 'A%' then 0 else 1 end as part, sk from nodes) select doc_id, path_key, part, row_number() over (partition by part order by doc_id, sk) as place from p"
ORACLES["content_weave"] = f"""with {TREES_SQL}, more as (select doc_id, path_key, case when path_key not like '% -> %' then 'more of it' else content end as content from aug),
w as (select b.doc_id, b.path_key, b.content, a.content as other, coalesce(b.content <> '' and a.content <> '', false) as woven from base b left join more a using (doc_id, path_key))
select doc_id, path_key, case when woven then {filled("content_weaving", section_name="string_split(path_key, ' -> ')[-1]", original_content="content", augmentation_content="other")} else content end as content, woven from w"""
ORACLES["graft_replies"] = f"""with {TREES_SQL}, {_NEW}, b as (select n_regionkey as doc_id, n_name as own, lag(n_name) over (partition by n_regionkey order by n_nationkey) as before from nation)
select doc_id, path_key, coalesce(before, '') as parent_path_key from n join b using (doc_id) where own = string_split(path_key, ' -> ')[1]"""
ORACLES["dynamic_subsections"] = f"""with titles as (select (item_id % 4)::int as node, text, row_number() over (order by item_id % 4, item_id) + 3 as new_idx from benchmark),
t as (select conv_id * 1000 + turn as id, text, (turn % 4)::int as node from conversations), {counts("t", "id", "text", "a")}, {counts("titles", "new_idx", "text", "b")},
na as (select id, sqrt(sum(tf * tf)) as n from a group by id), nb as (select id, sqrt(sum(tf * tf)) as n from b group by id),
s as (select a.id, b.id as new_idx, sum(a.tf * b.tf) / (any_value(na.n) * any_value(nb.n)) as score from a join b using (term) join na on na.id = a.id join nb on nb.id = b.id group by a.id, b.id),
every as (select t.id, titles.new_idx, coalesce(score, 0.0) as score from t join titles using (node) left join s on s.id = t.id and s.new_idx = titles.new_idx),
best as (select * from (select *, row_number() over (partition by id order by score desc, new_idx) as k from every) where k = 1)
select id // 1000 as doc_id, (id % 1000)::int as chunk_id, new_idx::int as node_idx, round(score, 6) as score from best"""
_ONCE = filled("hierarchical_refactor", node_path="path_key", global_context=q(CONTEXT), parent_context="''", node_content="content")
ORACLES["self_critique"] = f"""with {_NODES}, n as (select doc_id, array_to_string(path, ' -> ') as path_key, content from nodes where len(path) = 2)
select doc_id, path_key, {rewritten(filled("self_critique_and_refine", node_path="path_key", refactored_text=_ONCE), _LATEX)} as text from n"""


# --- the context store, event by event --------------------------------------------------------------------------------
def _terms(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda v: v <> '')"


def _cosine(a: str, b: str) -> str:
    """The cosine of the counts of two lists of terms."""
    times = lambda terms: f"len(list_filter({terms}, lambda v: v = w))"
    square = lambda terms: f"list_sum(list_transform(map_values(list_histogram({terms})), lambda v: v::bigint * v::bigint))"
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: {times(a)} * {times(b)})) / nullif(sqrt({square(a)} * {square(b)}), 0), 0.0)"


def _store(kind: str, limit: int) -> str:
    """The recursive table ``st``: each user's store after each event (k); ``kind`` says which events are queries."""
    item = "struct(c varchar, s varchar, i double, t varchar, a double, u int, r double)"
    shown = "array_to_string(list_transform(list_sort(list_transform(st.items, lambda x, n: {'n': -x.i, 'k': n, 'c': x.c})), lambda z: case when length(z.c) > 200 then left(z.c, 200) || '...' else z.c end), chr(10) || chr(10))"
    ranked = "list_sort(list_transform(q.items, lambda x, n: {'n': -(x.i * 0.4 + x.r * 0.4 + least(x.u / 10.0::double, 0.2)), 'k': n, 'x': x}))"
    best = f"list_sort(list_transform(st.items, lambda x, n: {{'n': -({_cosine('e.terms', _terms('x.c'))} * 0.6 + x.i * 0.3 + greatest(0.1, 1 - (e.at - x.a) / 3600 / 24) * 0.1), 'k': n, 'x': x}}))[:5]"
    line = "'[' || upper(z.x.t) || case when z.x.s <> '' then ' (' || z.x.s || ')' else '' end || ']: ' || left(z.x.c, 300)"
    return f"""{ITEMS_SQL}, e as (select *, {_terms("content")} as terms, sum((kind = 'add' and section_name <> '')::int) over (partition by user_id, section_name, kind order by position) as seen from
  (select *, {kind} as kind, epoch_us(timestamp) / 1e6 as at, row_number() over (partition by user_id order by position) as k from items)),
st as (select user_id, 0::bigint as k, []::{item}[] as items, null::double as relevance, null::varchar as context from (select distinct user_id from e)
  union all select e.user_id, e.k, case when e.kind = 'ask' or list_sum(list_transform(q.items, lambda x: length(x.c))) <= {limit} then q.items
      else list_transform(list_filter(p.l, lambda z, n: list_sum(list_transform(p.l[:n], lambda y: length(y.x.c))) <= {limit}), lambda z: z.x) end,
    case when e.kind = 'add' then r.r end, case when e.kind = 'ask' then array_to_string(list_transform({best}, lambda z: {line}), chr(10) || chr(10)) end
  from st join e on e.user_id = st.user_id and e.k = st.k + 1, lateral (select {shown} as b) b, lateral (select case when b.b = '' then 0.0 else {_cosine("e.terms", _terms("b.b"))} end as r) r,
    lateral (select case when e.kind = 'ask' then list_transform(st.items, lambda x: {{'c': x.c, 's': x.s, 'i': x.i, 't': x.t, 'a': x.a, 'u': x.u + 1, 'r': x.r}}::{item})
      else list_append(st.items, {{'c': e.content, 's': e.section_name, 'i': e.importance_score, 't': e.context_type, 'a': e.at, 'u': 0, 'r': r.r}}::{item}) end as items) q, lateral (select {ranked} as l) p),
o as (select e.user_id, e.position, e.kind, st.relevance, st.context, len(st.items) as n_items, coalesce(list_sum(list_transform(st.items, lambda x: length(x.c))), 0)::bigint as total_chars,
  coalesce(list_sum(list_transform(st.items, lambda x: x.u)), 0)::bigint as uses, case when e.kind = 'add' and e.section_name <> '' then e.seen::bigint end as in_section from st join e on e.user_id = st.user_id and e.k = st.k)"""


ORACLES["store_answers"] = f"""with recursive {_store("case when position % 5 = 4 then 'ask' else 'add' end", 300)}
select user_id, position as event_id, kind, round(relevance, 6) as relevance_score, context, n_items, total_chars, uses, in_section from o"""
ORACLES["store_stream"] = ORACLES["store_answers"]
ORACLES["add_context"] = f"with recursive {_store(q('add'), 2000)} select user_id::varchar as key, position as seq, round(relevance, 6) as relevance_score, n_items, total_chars from o"
