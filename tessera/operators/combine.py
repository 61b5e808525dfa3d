"""Two trees of sections combined.

A tree is a table (doc_id, path, sort_key, content); its key is (doc_id, path).  Existing siblings keep their order, new
ones follow in the order of the tree they come from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import PATH_SEPARATOR

#: Added to the place of a new sibling, so that it follows every old one.
AFTER = 1_000_000


def _keyed(tree: DataFrame) -> DataFrame:
    return tree.select("doc_id", "path", "sort_key", "content").withColumn("path_key", F.array_join("path", PATH_SEPARATOR))


def _with_new(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base and new nodes in one tree: a new node's place has the base's numbers as far as the base has its ancestors."""
    prefixes = new.select("doc_id", "path_key", "content", "path", F.posexplode("sort_key").alias("k", "own")).withColumn("at", F.array_join(F.slice("path", F.lit(1), F.col("k") + 1), PATH_SEPARATOR))
    known = base.select("doc_id", F.col("path_key").alias("at"), F.element_at("sort_key", -1).alias("place"))
    placed = prefixes.join(known, ["doc_id", "at"], "left").withColumn("n", F.coalesce("place", F.col("own") + AFTER))
    rebuilt = placed.groupBy("doc_id", "path_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias("sort_key"), F.first("path").alias("path"), F.first("content").alias("content"))
    return base.select("doc_id", "path", "sort_key", "content").unionByName(rebuilt.select("doc_id", "path", "sort_key", "content"))


def combine_robust(base: DataFrame, aug: DataFrame) -> DataFrame:
    """Everything of the base as it is, and the nodes that only the other tree has."""
    b, a = _keyed(base), _keyed(aug)
    return _with_new(b, a.join(b, ["doc_id", "path_key"], "left_anti"))


def overlapping(base: DataFrame, aug: DataFrame) -> DataFrame:
    """Nodes of the base that the other tree has too."""
    return _keyed(base).join(_keyed(aug), ["doc_id", "path_key"], "left_semi").drop("path_key")


def only_new(base: DataFrame, aug: DataFrame) -> DataFrame:
    """Nodes that only the other tree has."""
    return _keyed(aug).join(_keyed(base), ["doc_id", "path_key"], "left_anti").drop("path_key")


def default_weave(base: Column, aug: Column) -> Column:
    return F.concat(base, F.lit("\n\n"), aug)


def weave(base: DataFrame, aug: DataFrame, how: Callable[[Column, Column], Column] = default_weave) -> DataFrame:
    """The base with the content of both trees woven where both have some (J9, B2); ``woven`` marks those nodes."""
    a = _keyed(aug).where("content <> ''").select("doc_id", "path_key", F.col("content").alias("_a"))
    rows = _keyed(base).join(a, ["doc_id", "path_key"], "left")
    both = F.coalesce(F.col("content") != "", F.lit(False)) & F.col("_a").isNotNull()
    return rows.select("doc_id", "path", "sort_key", F.when(both, how(F.col("content"), F.col("_a"))).otherwise(F.col("content")).alias("content"), both.alias("woven"))


def graft(base: DataFrame, aug: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """The base with each new subtree inserted under the parent named for its root.

    ``parents``: (doc_id, path_key, parent_path_key) for roots of new subtrees; ``ROOT``, no entry or a path that the base
    doesn't have leave it where it stood.
    """
    b, a = _keyed(base), _keyed(aug)
    new = a.join(b, ["doc_id", "path_key"], "left_anti")
    if parents is None:
        return _with_new(b, new)
    chosen = parents.join(b.select("doc_id", F.col("path_key").alias("parent_path_key"), F.col("path").alias("to"), F.col("sort_key").alias("to_key")), ["doc_id", "parent_path_key"]).select("doc_id", F.col("path_key").alias("root_key"), "to", "to_key")
    # In the other tree's order a subtree is a range: a new node whose parent isn't new begins one, and all new nodes up to
    # the next such are below it.
    above = new.select("doc_id", F.col("path_key").alias("_up"))
    begun = new.withColumn("_up", F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), PATH_SEPARATOR)).join(above.withColumn("_below", F.lit(True)), ["doc_id", "_up"], "left")
    order = Window.partitionBy("doc_id").orderBy("sort_key", "path_key").rowsBetween(Window.unboundedPreceding, 0)
    root = lambda value: F.last(F.when(F.col("_below").isNull(), value), ignorenulls=True).over(order)
    top = begun.select("doc_id", "path_key", root(F.col("path_key")).alias("root_key"), root(F.size("path") - 1).alias("k"))
    moved = new.join(top, ["doc_id", "path_key"]).join(chosen, ["doc_id", "root_key"], "left")
    path = F.when(F.col("to").isNotNull(), F.concat("to", F.slice("path", F.col("k") + 1, F.size("path")))).otherwise(F.col("path"))
    key = F.when(F.col("to").isNotNull(), F.concat("to_key", F.slice("sort_key", F.col("k") + 1, F.size("sort_key")))).otherwise(F.col("sort_key"))
    return _with_new(b, moved.select("doc_id", path.alias("path"), key.alias("sort_key"), "content").withColumn("path_key", F.array_join("path", PATH_SEPARATOR)))


def combine_smart(base: DataFrame, aug: DataFrame, how: Callable[[Column, Column], Column] = default_weave, parents: DataFrame | None = None) -> DataFrame:
    """Woven where both have content, new structures grafted (B1)."""
    return graft(weave(base, aug, how).drop("woven"), aug, parents)


def combine_merge(base: DataFrame, aug: DataFrame) -> DataFrame:
    """Full outer merge by path (J14): contents of both one after the other, base first; new sections at the end."""
    return combine_smart(base, aug)


def combine_append(base: DataFrame, aug: DataFrame, first: str = "Part I - ", second: str = "Part II - ") -> DataFrame:
    """Both trees one after the other, their top titles prefixed (U4)."""
    renamed = lambda t, prefix, step: t.select("doc_id", F.concat(F.array(F.concat(F.lit(prefix), F.element_at("path", 1))), F.slice("path", 2, F.size("path"))).alias("path"), F.concat(F.array(F.element_at("sort_key", 1) + step), F.slice("sort_key", 2, F.size("sort_key"))).alias("sort_key"), "content")
    return renamed(base, first, 0).unionByName(renamed(aug, second, AFTER))


def recombine(generative: DataFrame, main: DataFrame) -> DataFrame:
    """Generative nodes before the others."""
    return generative.withColumn("part", F.lit(0)).unionByName(main.withColumn("part", F.lit(1)))
