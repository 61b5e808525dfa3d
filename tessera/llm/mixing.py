"""Mixing sources to target weights by hierarchical budgets; DataFrame functions only.

Leaves are (domain, language, source).  A budget of tokens goes down the tree: each node's share is split among its children
in proportion to their weights, and no child gets more than the tokens below it times ``max_epochs``.  What a child can't
take goes to its siblings (their common level rises until the budget is used up); only what all of them can't take is missing
to the parent, and was given to the parent's siblings, since a parent's limit is the sum of its children's.

A leaf's budget is filled with whole epochs and the prefix of one more: documents in the order of a seeded hash of epoch and
id, up to the last one with which the running sum of tokens is within the budget.  The running sum is taken in two steps, over
ranges of the hash and inside them, so that a leaf with a third of all documents isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, sized, table

LEVELS = ("domain", "lang", "source")
WORDS = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def leaf_budgets(supply: DataFrame, total: int, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """``supply`` (domain, lang, source, tokens; one row a leaf) with a long ``budget`` for each leaf.

    ``weights``: by level and name, 1 where a name isn't given.  A weight of 0 or less gives no budget.
    """
    rows = supply.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    parent: list[str] = []
    rows = rows.withColumn("budget", F.lit(float(total)))
    for level in LEVELS:
        given = weights.get(level, {})
        weight = F.lit(1.0)
        for name, w in given.items():
            weight = F.when(F.col(level) == name, F.lit(float(w))).otherwise(weight)
        here = [*parent, level]
        nodes = rows.groupBy(*here).agg(F.sum("cap").alias("c"), F.first("budget").alias("b")).withColumn("w", F.greatest(weight, F.lit(0.0))).withColumn("c", F.when(F.col("w") > 0, F.col("c")).otherwise(0.0))
        ratio = F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(0.0)
        order = Window.partitionBy(*parent, "one").orderBy("ratio", level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*parent, "one")
        nodes = nodes.withColumn("one", F.lit(1)).withColumn("ratio", ratio)
        nodes = nodes.withColumn("left", F.col("b") - F.coalesce(F.sum("c").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        # the level at which what is left is used up by those not yet full: the greatest of these
        nodes = nodes.withColumn("height", F.max(F.when(F.col("rest") > 1e-12, F.greatest(F.col("left"), F.lit(0.0)) / F.col("rest")).otherwise(0.0)).over(whole))
        nodes = nodes.select(*here, F.least(F.col("w") * F.col("height"), F.col("c")).alias("budget"))
        rows = rows.drop("budget").join(nodes, here)
        parent = here
    return rows.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def _position(seed: int, epoch: Column) -> Column:
    """A document's place in its leaf's epoch: md5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))


def select_mix(docs: DataFrame, total: int | None = None, share: float = 0.5, weights: dict[str, dict[str, float]] | None = None, max_epochs: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (id, th, domain, lang, source, n_tokens, epochs, budget) of the documents that the mix takes, epochs times each;
    th: hash of the text.

    ``total``: tokens to take; if None, ``share`` of all tokens.  Null languages, sources and domains are "" leaves of their
    own.  Texts without tokens are never taken.  Repeated rows are documents of their own; those of one id stand together.
    """
    domain = F.lit("all") if domain is None else domain
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), text(domain).alias("domain"), text(F.col(lang_col)).alias("lang"), text(F.col(source_col)).alias("source"), n_tokens(F.col(text_col)).alias("n_tokens")))
    supply = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    if total is None:
        total = int((rows.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0) * share)
    budgets = leaf_budgets(supply, total, weights or {}, max_epochs)
    budgets = cut(budgets.select(*LEVELS, "budget", F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest")))
    # leaves are few beside documents; the optimiser broadcasts them if they are small
    placed = rows.where("n_tokens > 0").join(budgets, list(LEVELS)).withColumn("at", _position(seed, F.col("full"))).withColumn("range", F.substring("at", 1, 3))
    ranges = placed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("own"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    # ranges wholly within the prefix, or wholly beyond it, need no order inside
    joined = placed.join(ranges, [*LEVELS, "range"])
    inside = Window.partitionBy(*LEVELS, "range").orderBy("at", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = joined.withColumn("sum", F.col("before") + F.sum("n_tokens").over(inside))
    taken = summed.withColumn("epochs", F.col("full") + (F.col("sum") <= F.col("rest")).cast("long")).where("epochs > 0")
    return taken.select("id", "th", *LEVELS, "n_tokens", F.col("epochs").cast("long").alias("epochs"), "budget")


#: Target weights of the query and of the pipeline: shares of three domains, English and German favoured.
DOMAINS = 3
WEIGHTS = {"domain": {"d0": 5.0, "d1": 3.0, "d2": 2.0}, "lang": {"en": 4.0, "de": 2.0}}
SHARE = 0.5
MAX_EPOCHS = 4
SEED = 42


def domain_of(source: str = "source") -> Column:
    """Documents carry no domain; theirs is a hash of the source."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit(""))), 1, 1)) - 1
    return F.concat(F.lit("d"), (digit % DOMAINS).cast("string"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, without their texts."""
    found = select_mix(docs, share=SHARE, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED, domain=domain_of())
    return found.withColumnRenamed("id", "doc_id").drop("th")


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, with mix_domain, mix_tokens, mix_epochs (how often each is taken) and
    mix_budget (of its leaf) beside their own columns; columns of these names are replaced.

    Rows that are equal in id, text and leaf are taken alike, by the fewest epochs of any.  An empty table gives no rows.
    """
    added = {"domain": "mix_domain", "n_tokens": "mix_tokens", "epochs": "mix_epochs", "budget": "mix_budget"}
    docs = docs.drop(*added.values())
    how = {"share": SHARE, "weights": WEIGHTS, "max_epochs": MAX_EPOCHS, "seed": SEED, "domain": domain_of()} | how
    keys = {c: fresh(f"_{c}", docs) for c in ("id", "th", "lang", "source")}
    taken = select_mix(docs, id_col=id_col, text_col=text_col, **how).groupBy("id", "th", *LEVELS, "n_tokens", "budget").agg(F.min("epochs").alias("epochs"))
    taken = sized(taken.select(*[F.col(c).alias(n) for c, n in (keys | added).items()]))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    same = F.col(id_col).eqNullSafe(F.col(keys["id"])) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(keys["th"]))
    same = same & (own(how.get("lang_col", "lang")) == F.col(keys["lang"])) & (own(how.get("source_col", "source")) == F.col(keys["source"]))
    return docs.join(taken, same).select(*docs.columns, *added.values())


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The documents of a mix of half of all tokens, with how often each is taken."""
    return mix_documents(table(spark, sf_dir, "documents"))


def _level_sql(level: str, parent: list[str], source: str, name: str) -> str:
    here = ", ".join([*parent, level])
    by = f"partition by {', '.join(parent)}" if parent else ""
    weight = "1.0"
    for value, w in WEIGHTS.get(level, {}).items():
        weight = f"case when {level} = '{value}' then {float(w)}::double else {weight}::double end"
    return f"""{name}_n as (select {here}, sum(cap) as c, any_value(budget) as b, {weight}::double as w from {source} group by {here}),
{name}_r as (select *, b - coalesce(sum(c) over ({by} order by c / w, {level} rows between unbounded preceding and 1 preceding), 0) as l,
  sum(w) over ({by}) - coalesce(sum(w) over ({by} order by c / w, {level} rows between unbounded preceding and 1 preceding), 0) as r from {name}_n),
{name}_h as (select *, max(case when r > 1e-12 then greatest(l, 0.0) / r else 0.0 end) over ({by}) as height from {name}_r),
{name} as (select s.* exclude (budget), least(h.w * h.height, h.c) as budget from {source} s join {name}_h h using ({here}))"""


def oracle() -> str:
    """DuckDB SQL for ``op7_mixing``."""
    chars = " \\t\\n\\x0B\\f\\r"
    return f"""with docs as (select doc_id, 'd' || ((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % {DOMAINS})::varchar as domain,
  coalesce(lang, '') as lang, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^{chars}]+'))::bigint as n_tokens from documents),
leaf0 as (select domain, lang, source, sum(n_tokens)::bigint as tokens from docs group by all having sum(n_tokens) > 0),
leaf as (select *, (tokens * {MAX_EPOCHS})::double as cap, floor((select sum(n_tokens) from docs) * {SHARE})::double as budget from leaf0),
{_level_sql("domain", [], "leaf", "a")},
{_level_sql("lang", ["domain"], "a", "b")},
{_level_sql("source", ["domain", "lang"], "b", "c")},
budgets as (select domain, lang, source, tokens, floor(budget + 1e-6)::bigint as budget from c),
placed as (select d.*, b.budget, b.budget // b.tokens as f, b.budget % b.tokens as rest, md5('{SEED}:' || (b.budget // b.tokens)::varchar || ':' || doc_id::varchar) as place
  from docs d join budgets b using (domain, lang, source) where n_tokens > 0),
summed as (select *, sum(n_tokens) over (partition by domain, lang, source order by place, n_tokens rows unbounded preceding) as s from placed)
select doc_id, domain, lang, source, n_tokens, (f + case when s <= rest then 1 else 0 end)::bigint as epochs, budget
from summed where f + case when s <= rest then 1 else 0 end > 0"""
