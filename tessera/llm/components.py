"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on narrow rows; no node's neighbours are gathered into one row, and nothing
but a checksum reaches the driver.  Lineage is cut with a checkpoint after every round, which also counts: a round is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checksum, counted, salted_join, tidy


#: Edges of a partition.
ROWS = 100_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node with a link; root is the smallest node reachable.

    Loops and repeated links are harmless; links with a null end are ignored; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and u is not null and v is not null").distinct()
    edges, seen = counted(edges, **checksum("u", "v"))
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a star's centre has all its rows in one group: its least is repeated and they are dealt
        large = salted_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        # the edges never get more by much: as many partitions as they need, else each round leaves files for all
        edges, now = counted(small.select("e.u", "e.v").where("u > v").distinct().coalesce(1 + seen["n"] // ROWS), **checksum("u", "v"))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tidy(edges.sparkSession)
    node, root = F.col("u").alias("node"), F.col("v").alias("root")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(node, root).unionByName(roots)
