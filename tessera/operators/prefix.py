"""Running sums of groups of any size, in two levels.

Rows are dealt by ranges of group and order, so that a group with a third of all rows lies in as many ranges as it needs; each
range of a group is summed by itself, and gets what the ranges before it have in total.  Only columns that the sums need
should be in the rows: what belongs to the kept ones is fetched afterwards, by ``fetch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.materialize import materialized


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], number: str = "_n") -> DataFrame:
    """``rows`` with inclusive running sums (new name: column) and the row's number from 1, in each group by ``order``.

    Nulls add nothing.  Rows equal in group and order stand in some fixed order.  The rows are written once, since their range
    must not change between the two levels.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = [*order, F.col("_tie")]
    dealt = materialized(dealt.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    groups = [F.col(c) for c in by]
    totals = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_range_rows"), *[F.sum(v).alias(f"_range_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    before = totals.select(*[F.col(c).alias(f"_range_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_range_at"), F.coalesce(F.sum("_range_rows").over(earlier), F.lit(0)).alias("_range_rows"), *[F.sum(f"_range_{n}").over(earlier).alias(f"_range_{n}") for n in sums])
    inside = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({number: F.row_number().over(inside), **{n: F.sum(v).over(inside) for n, v in sums.items()}})
    same = F.col("_range") == F.col("_range_at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_range_by{k}"))
    whole = summed.join(before, same)
    add = {n: F.when(F.col(f"_range_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_range_{n}")).otherwise(F.col(n) + F.col(f"_range_{n}")) for n in sums}
    return whole.withColumns({number: (F.col(number) + F.col("_range_rows")).cast("long"), **add}).select(*rows.columns, number, *sums)


def fetch(kept: DataFrame, source: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """``kept`` (unique in ``keys`` but for equal rows) with columns ``extra`` of the rows of ``source`` that have its keys.

    Rows of ``source`` with equal keys are taken to be equal; one of them is used.
    """
    wanted = kept.select(*[F.col(k).alias(f"_wanted{i}") for i, k in enumerate(keys)]).distinct()
    found = source.join(wanted, _same(keys, "_wanted"), "left_semi").dropDuplicates(keys).select(*[F.col(k).alias(f"_found{i}") for i, k in enumerate(keys)], *extra)
    return kept.join(found, _same(keys, "_found")).drop(*[f"_found{i}" for i in range(len(keys))])


def _same(keys: list[str], name: str) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{name}{i}"))
    return same
