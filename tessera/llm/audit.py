"""Interactions of filters: what each of a set of filters removes, alone, after others and in every order.

Each document gets the mask of the filters that it fails.  The masks' counts of a part are all that the audit needs.  With
c(m) documents of mask m, the number that the filters in S remove is the corner x = 1 on S, 0 elsewhere, of the removal
polynomial

    f(x) = sum over m of c(m) * (1 - product over i in m of (1 - x_i)) = sum over T of a(T) * product over i in T of x_i,

whose coefficient a(T) is, with a sign, the number of documents that fail all of T.  Steps of an order are differences of
corners.  A filter's Shapley value is the integral of its partial derivative along the diagonal, sum of a(T) / |T| over the T
that hold it: rationals over the common denominator of all sizes, kept as integers.  Polynomials of good and of toxic
documents give what each step costs and gains.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Fixed values of the five filters, A to E; E is that of copies.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, r"[#$%&*|]"
NAMES = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: fewer than 100 words; under 80 % of them distinct; over 10 % capitals of all code points; holds a mark."""

    def of(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))

        def bits(w: Column) -> Column:
            few, n = F.size(w) < LEAST_WORDS, F.size(w).cast("long")
            repeats = 100 * F.size(F.array_distinct(w)).cast("long") < LEAST_DISTINCT * n
            capitals = 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(t).cast("long")
            tests = [few, repeats, capitals, t.rlike(MARKS)]
            return sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0)).cast("int")

        return F.get(F.transform(F.array(words), bits), 0)

    return F.get(F.transform(F.array(F.coalesce(text, F.lit(""))), of), 0)


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, 1 if any label of their id says so; a null id has no label."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(id_col)).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    named = rows.where(F.col(id_col).isNotNull()).join(marks, id_col, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    return named.unionByName(rows.where(F.col(id_col).isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def mask_counts(docs: DataFrame, labels: DataFrame, part: Column | None = None, mask: Column | None = None, copies: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, mask, n, n_good, n_toxic) of all documents.

    ``mask``: bits of a text's own failures (of ``text_mask`` by default); bit ``copies`` is set here, for a text that a smaller
    id has.  Texts are told apart by their SHA-256, and only that leaves the task that read them.  Of a text all rows but those
    of its smallest id fail: so rows are counted by text first, however many copies there are, and no text's rows meet in one
    task.  A row without an id is no copy.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")) if part is None else part
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("th"), (text_mask(text) if mask is None else mask).alias("mask"))
    # equal rows first, so that a much repeated one is one row before the labels come
    rows = rows.groupBy("id", "part", "th", "mask").agg(F.count(F.lit(1)).alias("n"))
    group = ["th", "mask", "part", "good", "toxic"]
    known = F.col("id").isNotNull()
    by_text = labelled(rows, labels).groupBy(*group, "id").agg(F.sum("n").alias("n")).groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("named"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"),
    )
    first = F.min("least").over(Window.partitionBy("th"))  # a text has a row for each part and label
    stay = F.when(F.col("least") == first, F.col("at_least")).otherwise(0) + F.col("n") - F.col("named")
    split = by_text.withColumn("stay", F.coalesce(stay, F.col("n"))).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("stay").alias("n")), F.struct((F.col("mask") + (1 << copies)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))).alias("m"))
    return split.where("m.n > 0").groupBy("part", "m.mask").agg(F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("n_good"), F.sum(F.col("m.n") * F.col("toxic")).alias("n_toxic"))


def removal_polynomials(counts: DataFrame, filters: int = len(NAMES)) -> DataFrame:
    """Rows (part, term, n, a, a_good, a_toxic): the coefficients of each part's removal polynomials.

    A term is a set of filters as bits; that of none has coefficient 0, and ``n``, the documents of the part.
    """
    terms = F.filter(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), lambda t: t.bitwiseAND(F.col("mask")) == t)
    each = counts.withColumn("term", F.explode(terms))
    sign = F.when(F.col("term") == 0, 0).otherwise(F.when(F.bit_count("term") % 2 == 1, 1).otherwise(-1))
    return each.groupBy("part", "term").agg(F.sum(F.when(F.col("term") == 0, F.col("n")).otherwise(0)).alias("n"), *[F.sum(sign * F.col(c)).alias(a) for c, a in (("n", "a"), ("n_good", "a_good"), ("n_toxic", "a_toxic"))])


def corners(polynomials: DataFrame, filters: int = len(NAMES)) -> DataFrame:
    """Rows (part, chosen, docs, gone, gone_good, gone_toxic): the polynomials at each corner, a set of filters as bits."""
    above = F.filter(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), lambda s: s.bitwiseAND(F.col("term")) == F.col("term"))
    each = polynomials.withColumn("chosen", F.explode(above))
    return each.groupBy("part", "chosen").agg(F.sum("n").alias("docs"), F.sum("a").alias("gone"), F.sum("a_good").alias("gone_good"), F.sum("a_toxic").alias("gone_toxic"))


def shapley(polynomials: DataFrame, filters: int = len(NAMES)) -> DataFrame:
    """Rows (part, filter, numerator, denominator): the integral of each partial derivative along the diagonal, exact.

    The denominator is the least common one of 1 to the number of filters.
    """
    common = math.lcm(*range(1, filters + 1))
    member = F.explode(F.filter(F.sequence(F.lit(0), F.lit(filters - 1)), lambda i: F.expr("term").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0))
    each = polynomials.where("term > 0").withColumn("filter", member)
    share = F.lit(common) / F.bit_count("term")  # whole
    return each.groupBy("part", "filter").agg(F.sum(F.col("a") * share.cast("long")).alias("numerator")).withColumn("denominator", F.lit(common).cast("long"))


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part,
    order of the filters and step, from the counts of masks.

    ``shapley`` is the filter's value times the number of orders.  A part has one row of corners and one of values, both of
    fixed size; parts are dealt over tasks.
    """
    k = len(names)
    orders = math.factorial(k)
    polynomials = cut(removal_polynomials(counts, k))
    corner = corners(polynomials, k).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("chosen", "docs", "gone", "gone_good", "gone_toxic"))).alias("c"))
    # every part has a value for every filter: 0 where no document fails it
    value = shapley(polynomials, k).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filter", (F.col("numerator") * orders / F.col("denominator")).cast("long").alias("v")))).alias("s"))
    order = F.explode(F.split(F.lit(",".join(map("".join, permutations(names)))), ","))
    rows = corner.join(value, "part", "left").withColumn("filter_order", order).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), letter) - 1)
    earlier = F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    rows = rows.withColumns({"b": F.aggregate(earlier, F.lit(0), lambda bits, c: bits + bit_of(c)), "bit": bit_of(letter), "i": F.instr(F.lit(names), letter) - 1})
    bit = F.col("bit")
    full = (1 << k) - 1
    at = lambda chosen, what: F.get("c", chosen)[what]
    after = F.col("b") + bit
    removed = at(after, "gone") - at(F.col("b"), "gone")
    return rows.select(
        "part", "filter_order", "step", (at(F.lit(0), "docs") - at(after, "gone")).alias("kept"), removed.alias("removed"), (at(bit, "gone") - removed).alias("redundant"),
        (at(F.lit(full), "gone") - at(F.lit(full) - bit, "gone")).alias("unique_fails"), (at(after, "gone_good") - at(F.col("b"), "gone_good")).alias("good_lost"),
        (at(after, "gone_toxic") - at(F.col("b"), "gone_toxic")).alias("toxic_lost"), F.coalesce(F.try_element_at("s", F.col("i")), F.lit(0)).cast("long").alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The audit of the five filters over whole texts, by language.

    Null and empty texts are texts without words, and equal; a null language is the part "".  Rows without an id are no copies
    and carry no label; rows that repeat an id and text are each counted, and none of them is a copy of another.  Labels of an
    id that repeats count once.  An empty table gives no rows.
    """
    return audit(mask_counts(docs, labels, **how))


def op12_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    """DuckDB SQL for ``op12_audit``: every document's first failing filter in every order, counted."""
    space = " \\t\\n\\x0B\\f\\r"
    fails = ", ".join(f"('{c}', {c.lower()})" for c in NAMES)
    return f"""with marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by 1),
texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') as w from documents),
d as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, len(w) < {LEAST_WORDS} as a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) as b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) as c, regexp_matches(t, '{MARKS}') as d, coalesce(doc_id > min(doc_id) over (partition by t), false) as e
  from texts left join marks using (doc_id)),
masks as (select part, a, b, c, d, e, count(*) as n, sum(good) as g, sum(toxic) as x from d group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (select p.l || q.l || r.l || s.l || t.l as o from letters p, letters q, letters r, letters s, letters t where len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps as (select o, unnest(range(1, 6)) as k from orders),
failed as (select m.*, list_filter([case when a then 'A' end, case when b then 'B' end, case when c then 'C' end, case when d then 'D' end, case when e then 'E' end], lambda v: v is not null) as f from masks m),
placed as (select part, o, k, n, g, x, list_contains(f, o[k]) as fails, len(list_filter(f, lambda v: strpos(o, v) < k)) > 0 as gone, len(f) as many from failed, steps),
sums as (select part, o as filter_order, k as step, sum(case when not gone and not fails then n else 0 end) as kept, sum(case when not gone and fails then n else 0 end) as removed,
  sum(case when gone and fails then n else 0 end) as redundant, sum(case when fails and many = 1 then n else 0 end) as unique_fails,
  sum(case when not gone and fails then g else 0 end) as good_lost, sum(case when not gone and fails then x else 0 end) as toxic_lost from placed group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter_order[step]))::bigint as shapley from sums"""
