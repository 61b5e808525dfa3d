"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Candidates are found with regular expressions in whole texts.  Their values are hashed and counted over the whole corpus by
distinct repositories and distinct owners: a value that several owners or many repositories have is a widely copied example,
one that belongs to a single owner, stands in few repositories and looks random is taken for live.  Base kinds are always reported; a bare token (``OWNED``) is reported
only if it is owner-specific and live-looking, which no single document can tell.

Only documents with a candidate take part in the joins, and values are counted in three steps, each with a partial
aggregation, so a value that a third of all documents share is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, let, running, salted_join, sized, table

#: Base kinds, in order: pattern, and the least length of what the match (or its value) must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
VALUE = r"""^(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds that the method adds: bare tokens of 20 or more characters, and key blocks.
OWNED = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_.-])"
KEYBLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "keyblock", "owned")

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, value) for the leftmost non-overlapping matches, in code points.

    The text between matches, from a split with the same pattern, gives the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct((F.length(gap) + F.length(m)).alias("end"), m.alias("value")))
    placed = running(steps, lambda x, y: F.struct((x["end"] + F.coalesce(y["end"], F.lit(0))).alias("end"), x["value"].alias("value")))
    spans = F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), (s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Base spans of a non-null text; an assignment's value is what follows its separator, and needs 6 characters."""
    assign = F.transform(spans_of(text, ASSIGN, "assign"), lambda s: s.withField("value", F.regexp_replace(s["value"], VALUE, "")))
    assign = F.filter(assign, lambda s: F.length(s["value"]) >= 6)
    return F.concat(assign, spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex"))


def _mixed(value: Column) -> Column:
    """Has at least 4 digits and 4 letters of which some are upper case or only hex digits: looks random, not like a word."""
    return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4) & ~value.rlike("([A-Za-z0-9])\\1\\1\\1")


def extra_spans(text: Column, base: Column) -> Column:
    """Candidates of the method's own kinds that no base span overlaps.

    Base spans come at their starts, candidates at their ends; the greatest end so far tells whether one reaches into them.
    """
    own = F.concat(spans_of(text, KEYBLOCK, "keyblock"), F.filter(spans_of(text, OWNED, "owned"), lambda s: _mixed(s["value"])))
    event = lambda at, side, reach, s: F.struct(at.alias("at"), F.lit(side).alias("side"), reach.alias("reach"), s.alias("span"))
    events = F.concat(F.transform(base, lambda b: event(b["start"], 1, b["end"], b)), F.transform(own, lambda s: event(s["end"], 0, F.lit(-1), s)))
    swept = running(F.array_sort(events), lambda x, y: F.struct(x["at"].alias("at"), x["side"].alias("side"), F.greatest(x["reach"], F.coalesce(y["reach"], F.lit(-1))).alias("reach"), x["span"].alias("span")))
    return F.transform(F.filter(swept, lambda e: (e["side"] == 0) & (e["reach"] <= e["span"]["start"])), lambda e: e["span"])


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Rows (id, th, repo, owner, spans) of the documents with a candidate; th: hash of the text.

    Of a span's text only its SHA-256 (``value``) and whether it looks random (``random``) leave the task that read it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    gate = F.col("text").rlike(r"(?i)(?:pass(?:word|wd)|secret|token|api_?key)[\"']?\x20*[:=]|AKIA|PRIVATE KEY|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}")
    found = rows.where(gate).withColumn("base", base_spans(F.col("text"))).withColumn("spans", F.concat("base", extra_spans(F.col("text"), F.col("base"))))
    sealed = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value"), (_mixed(s["value"]) | (s["kind"] == "keyblock")).alias("random")))
    return found.where(F.size("spans") > 0).select("id", F.xxhash64("text").alias("th"), "repo", "owner", sealed.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Rows (value, repos, owners): distinct repositories and owners of each candidate value over the whole corpus."""
    each = found.select("repo", "owner", F.explode("spans.value").alias("value"))
    by_owner = each.distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repos: int = 20) -> DataFrame:
    """Rows (id, th, spans) of the documents with a reported span.

    spans: array of (kind, start, end, value, repos, owners, verdict), verdict ``example`` (more than ``max_owners`` owners or
    ``max_repos`` repositories), else ``live`` (random-looking, or a key block) or ``weak``; value: the SHA-256 of its text.  Null and empty texts have no
    span.  Equal rows (id and text) give one row.  A null owner or repository counts as one.
    """
    found = cut(candidates(docs, id_col, text_col, repo_col, owner_col))
    shared = ownership(found)
    each = found.dropDuplicates(["id", "th"]).select("id", "th", F.explode("spans").alias("s")).withColumn("value", F.col("s.value"))
    example = (F.col("owners") > max_owners) | (F.col("repos") > max_repos)
    verdict = F.when(example, "example").when(_mixed(F.col("s.value")) | (F.col("s.kind") == "keyblock"), "live").otherwise("weak")
    # a value that many copy is dealt
    judged = salted_join(each, shared, "value").select("id", "th", F.struct("s.kind", "s.start", "s.end", "s.value", "repos", "owners", verdict.alias("verdict")).alias("s"))
    judged = judged.where((F.col("s.kind") != "owned") | (F.col("s.verdict") == "live"))
    return judged.groupBy("id", "th").agg(F.collect_list("s").alias("spans"))


def with_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "secret_spans", **how) -> DataFrame:
    """``docs`` with a column of spans, null where there are none; a column of that name is replaced, others stay."""
    docs = docs.drop(spans_col)
    key, found_id, found_key = (fresh(c, docs) for c in ("_hash", "_found_id", "_found_hash"))
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = sized(find_secrets(docs, id_col, text_col, **how).select(F.col("id").alias(found_id), F.col("th").alias(found_key), F.col("spans").alias(spans_col)))
    return rows.join(found, F.col(id_col).eqNullSafe(F.col(found_id)) & (F.col(key) == F.col(found_key)), "left").drop(found_id, key, found_key)


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _judged(verdict: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secret spans of every document; each document is a repository, each source an owner."""
    found = find_secrets(table(spark, sf_dir, "documents")).select(
        "id",
        "th",
        *[_number(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[_judged(v).alias(f"n_{v}") for v in ("live", "example")],
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found["id"]) & (docs["th"] == found["th"]), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return rows.select("doc_id", *numbers, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_example")])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verdicts: tuple[str, ...] = ("live", "weak", "example"), **how) -> DataFrame:
    """``docs`` with each reported span of these verdicts replaced by ``[kind]``; other columns, whatever their names, and
    rows stay as they are.  Of spans that overlap the first has its name there.  A null text stays null."""
    name = fresh("secret_spans", docs)
    rows = with_secrets(docs, id_col, text_col, spans_col=name, **how)
    text = F.col(text_col)
    chosen = F.transform(F.filter(name, lambda s: s["verdict"].isin(*verdicts)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["end"].alias("reach")))
    swept = running(F.array_sort(chosen), lambda x, y: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.greatest(x["reach"], F.coalesce(y["reach"], F.lit(0))).alias("reach")))

    def changed(spans: Column) -> Column:
        # what stands before a span begins where those before it have reached to
        at = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["reach"]))
        pieces = F.zip_with(spans, F.slice(at, 1, F.size(spans)), lambda s, a: F.when(s["start"] >= a, F.concat(text.substr(a + 1, s["start"] - a), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), text.substr(F.element_at(at, -1) + 1, F.length(text)))

    return rows.withColumn(text_col, F.when(F.size(name) > 0, let(swept, changed)).otherwise(text)).select(*docs.columns)
