"""Fill-in-the-middle: texts cut at unit boundaries and put together with the middle last.

Units (lines) are rows: a text's matches are exploded with their ordinals, a window's running sum of their lengths says where
each ends, and requests to cut after a unit are joined to those by its ordinal.  The two offsets of a text go back to it, and
the parts are substrings.  Neither units nor texts but only lengths, ordinals and hashes are shuffled, until the offsets
meet the texts: as a broadcast while they are small, else in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, sized, table

UNIT = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Share of texts that are transformed, and of those the share with the suffix first, in hundredths.
RATE, SPM = 100, 50


def draws(id_: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers below 2^32 from an id: the first digits of the SHA-256 of seed and id.  A null id counts as ""."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two hashes of a row's id and text: rows equal in these are cut alike.  A null id is one of its own."""
    row = [F.col(id_col).cast("long"), F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))]
    return [F.xxhash64(*row).alias("h1"), F.xxhash64(F.lit(1), *row).alias("h2")]


KEY = ["h1", "h2"]


def unit_ends(docs: DataFrame, unit: str = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (h1, h2, ordinal, end): for every unit of every different row its ordinal from 1 and where it ends, in code points.

    Equal rows are one before the sums, however often a row is repeated.
    """
    units = F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(unit), F.lit(0)))
    each = docs.select(*_key(docs, id_col, text_col), F.col(text_col)).select(*KEY, units.alias("at", "unit")).select(*KEY, (F.col("at") + 1).alias("ordinal"), F.length("unit").cast("long").alias("size"))
    once = each.groupBy(*KEY, "ordinal").agg(F.first("size").alias("size"))
    order = Window.partitionBy(*KEY).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return once.select(*KEY, "ordinal", F.sum("size").over(order).alias("end"))


def cut_requests(docs: DataFrame, unit: str = UNIT, seed: int = SEED, rate: int = RATE, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (h1, h2, which, ordinal): after which unit the prefix (1) and the middle (2) of a text end, for those transformed."""
    h = draws(F.col(id_col), seed)
    n = F.regexp_count(F.col(text_col), F.lit(unit)).cast("long")
    wanted = docs.where(_cuttable(F.col(text_col), marks) & (h[2] % 100 < rate))
    rows = wanted.select(*_key(docs, id_col, text_col), (h[0] % (n + 1)).alias("a"), (h[1] % (n + 1)).alias("b"))
    asked = F.explode(F.array(F.struct(F.lit(1).alias("which"), F.least("a", "b").alias("ordinal")), F.struct(F.lit(2).alias("which"), F.greatest("a", "b").alias("ordinal"))))
    return rows.distinct().select(*KEY, asked.alias("r")).select(*KEY, "r.which", F.col("r.ordinal").cast("int").alias("ordinal"))


def _cuttable(text: Column, marks: tuple[str, str, str]) -> Column:
    """Not empty, and none of the marks is in it, so that what is made can be taken apart again."""
    inside = F.lit(False)
    for m in marks:
        inside = inside | F.contains(text, F.lit(m))
    return F.coalesce((F.length(text) > 0) & ~inside, F.lit(False))


def offsets(docs: DataFrame, **how) -> DataFrame:
    """Rows (h1, h2, prefix, middle): lengths of the two parts in code points."""
    shared = {k: v for k, v in how.items() if k in ("unit", "id_col", "text_col")}
    asked = cut_requests(docs, **how)
    met = asked.where("ordinal > 0").join(unit_ends(docs, **shared), [*KEY, "ordinal"]).select(*KEY, "which", "end")
    ends = met.unionByName(asked.where("ordinal = 0").select(*KEY, "which", F.lit(0).cast("long").alias("end")))
    at = lambda k: F.max(F.when(F.col("which") == k, F.col("end")))
    return ends.groupBy(*KEY).agg(at(1).alias("prefix"), (at(2) - at(1)).alias("middle"))


def fill_in_middle(docs: DataFrame, unit: str = UNIT, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_units, form (plain, psm or spm), prefix_chars, middle_chars and output; columns of these names are replaced.

    ``unit``: a pattern whose matches, left to right, are the whole text.  ``rate``, ``spm``: hundredths of texts that are
    transformed, and of those that have the suffix first.  A plain text is its own output and has no lengths.  Null texts
    count as empty ones, which have no units and are plain; a null id draws like the id "".  Rows equal in id and text are
    cut alike, each with its row; an empty table gives no rows.
    """
    added = ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    docs = docs.drop(*added)
    how = dict(unit=unit, id_col=id_col, text_col=text_col)
    found = sized(offsets(docs, seed=seed, rate=rate, marks=marks, **how))
    names = {c: fresh(f"_{c}", docs) for c in [*KEY, "prefix", "middle"]}
    found = found.select(*[F.col(c).alias(n) for c, n in names.items()])
    keys = dict(zip(KEY, _key(docs, id_col, text_col), strict=True))
    same = (F.col(names["h1"]) == keys["h1"]) & (F.col(names["h2"]) == keys["h2"])
    rows = docs.join(found, same, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    p, m = F.col(names["prefix"]), F.col(names["middle"])
    h = draws(F.col(id_col), seed)
    form = F.when(p.isNull(), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumns({"n_units": F.coalesce(F.regexp_count(text, F.lit(unit)), F.lit(0)).cast("long"), "form": form, "prefix_chars": p, "middle_chars": m})
    begin, end = p.cast("int"), (p + m).cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), begin), F.substring(text, begin + 1, m.cast("int")), F.substring(text, end + 1, F.length(text))
    a, b, c = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(a, prefix, b, suffix, c, middle)).otherwise(F.concat(b, suffix, a, prefix, c, middle))
    return rows.withColumn("output", output).drop(*names.values())


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made from; marks occur once each, since texts with marks stay plain."""
    p, s, m = map(F.lit, marks)
    between = lambda first, then: F.split_part(F.split_part(output, first, F.lit(2)), then, F.lit(1))
    psm = F.concat(between(p, s), F.split_part(output, m, F.lit(2)), between(s, m))
    spm = F.concat(between(p, m), F.split_part(output, m, F.lit(2)), between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_infill(spark, sf_dir: str) -> DataFrame:
    """How every document is cut and put together, with hashes of the output and of the text that it gives back."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL for ``op13_infill``: lists of a text's units, sliced."""
    p, s, m = MARKS
    h = ", ".join(f"('0x' || substr(d, {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))
    return f"""with t as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as d from documents),
n as (select *, len(u)::bigint as n, {h} from t),
f as (select *, case when t = '' or contains(t, '{p}') or contains(t, '{s}') or contains(t, '{m}') or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM} then 'spm' else 'psm' end as form,
  least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from n),
c as (select *, coalesce(array_to_string(u[:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:], ''), '') as suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{p}' || pre || '{s}' || suf || '{m}' || mid else '{s}' || suf || '{p}' || pre || '{m}' || mid end) as output_sha256, sha256(t) as restored_sha256 from c"""
