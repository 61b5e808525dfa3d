"""Tables that the named queries start from, made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.schema import PATH_SEPARATOR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


def conversation_texts(spark, d, line: str) -> DataFrame:
    """Rows (doc_id, content): a conversation's turns, each after a line that names its role; ``line`` has %s for the role."""
    before, after = line.split("%s")
    turns = table(spark, d, "conversations").withColumn("t", F.concat(F.lit(before), "role", F.lit(after), F.lit("\n"), "text"))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("content"))


def turn_chunks(spark, d) -> DataFrame:
    """Conversations as chunks: the role is the section."""
    none = F.array().cast("array<string>")
    meta = F.struct(F.array("role").alias("hierarchy_path"), none.alias("labels"), none.alias("citations"), none.alias("refs"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("source"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_id"), F.lit("paragraph").alias("type"), F.col("text").alias("content"), F.col("role").alias("parent_section"), meta.alias("metadata"))


def line_chunks(spark, d) -> DataFrame:
    """Orders as documents, their lines as chunks that have a label and a reference each."""
    none = F.array().cast("array<string>")
    label = lambda c: F.array(F.concat(F.lit("p"), (F.col(c) % 7).cast("string")))
    meta = F.struct(F.array("l_returnflag", "l_linestatus").alias("hierarchy_path"), label("l_partkey").alias("labels"), none.alias("citations"), label("l_suppkey").alias("refs"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("source"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("figure", "table", "equation", "paragraph")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("chunk_id"), kind.alias("type"), F.col("l_linenumber").cast("string").alias("content"), F.lit("x").alias("parent_section"), meta.alias("metadata"))


#: SQL of ``vectors`` and ``centroids``.
VECTORS_SQL = """v as (select label as doc_id, (row_number() over (partition by label order by vec_id) - 1)::int as chunk_id, vec_id, embedding::double[] as e from embeddings),
dims as (select label, unnest(range(1, 65)) as i, embedding from embeddings),
cent as materialized (select label as node_idx, list(a order by i) as c from (select label, i, avg(embedding[i]::double) as a from dims group by all) group by all),
scores as materialized (select doc_id, chunk_id, node_idx, list_cosine_similarity(e, c) as score from v, cent)"""


def vectors(spark, d) -> DataFrame:
    """Vectors as chunks, a document for each label."""
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("doc_id"), number.cast("int").alias("chunk_id"), "vec_id", "embedding")


def centroids(spark, d) -> DataFrame:
    """The mean vector of each label's vectors, as sections."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    return means.groupBy(F.col("label").cast("int").alias("node_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("embedding"))


def vector_scores(spark, d):
    """Scores of the vectors with the mean vectors."""
    from tessera.operators.dense import DenseScores

    return DenseScores(vectors(spark, d), centroids(spark, d))


EDGES_SQL = "edges as (select doc_id, chunk_id as src, (chunk_id * 7 + 3) % 11 as dst, 0 as ref_pos from v)"


def vector_edges(spark, d) -> DataFrame:
    """References between the vectors of a label: each to one of the first."""
    return vectors(spark, d).select("doc_id", F.col("chunk_id").alias("src"), ((F.col("chunk_id") * 7 + 3) % 11).cast("int").alias("dst"), F.lit(0).alias("ref_pos"))


#: SQL of ``trees``: base (customers) and aug (suppliers), as doc_id, path_key, content.
TREES_SQL = """base as (select n_regionkey as doc_id, n_name as path_key, n_name as content from nation
  union all select n_regionkey, n_name || ' -> ' || c_mktsegment, count(*)::varchar from customer join nation on c_nationkey = n_nationkey group by n_regionkey, n_name, c_mktsegment),
aug as (select n_regionkey as doc_id, n_name as path_key, '' as content from nation
  union all select n_regionkey, n_name || ' -> ' || case when s_suppkey % 3 = 0 then 'BUILDING' else 'S' || (s_suppkey % 3)::varchar end, count(*)::varchar from supplier join nation on s_nationkey = n_nationkey
  group by n_regionkey, n_name, case when s_suppkey % 3 = 0 then 'BUILDING' else 'S' || (s_suppkey % 3)::varchar end)"""


def trees(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two trees a region: nations with the segments of their customers, and with groups of their suppliers."""
    nation = table(spark, d, "nation")

    def tree(leaves: DataFrame, content) -> DataFrame:
        roots = nation.select(F.col("n_regionkey").alias("doc_id"), F.array("n_name").alias("path"), F.array("n_nationkey").alias("sort_key"), content.alias("content"))
        grouped = leaves.groupBy("n_regionkey", "n_name", "n_nationkey", "leaf").agg(F.count(F.lit(1)).cast("string").alias("content"))
        place = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("leaf"))
        return roots.unionByName(grouped.select(F.col("n_regionkey").alias("doc_id"), F.array("n_name", "leaf").alias("path"), F.array("n_nationkey", place).alias("sort_key"), "content"))

    customers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("leaf", F.col("c_mktsegment"))
    suppliers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers = suppliers.withColumn("leaf", F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").otherwise(F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string"))))
    return tree(customers, F.col("n_name")), tree(suppliers, F.lit(""))


def keyed(tree: DataFrame) -> DataFrame:
    return tree.select("doc_id", F.array_join("path", PATH_SEPARATOR).alias("path_key"), "content")


ITEMS_SQL = """items as (select user_id, event_id as position, props as content, event_type as section_name, least(1.0, abs(value) / 100) as importance_score, 'kind' || (event_id % 3)::varchar as context_type,
  ts as timestamp, (event_id % 5)::int as usage_count, (event_id % 10) / 10.0::double as relevance_score from events)"""


def context_items(spark, d) -> DataFrame:
    """Events as context items, a store for each user."""
    return table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("position"), F.col("props").alias("content"), F.col("event_type").alias("section_name"), F.least(F.lit(1.0), F.abs("value") / 100).alias("importance_score"),
        F.concat(F.lit("kind"), (F.col("event_id") % 3).cast("string")).alias("context_type"), F.col("ts").alias("timestamp"), (F.col("event_id") % 5).cast("int").alias("usage_count"), ((F.col("event_id") % 10) / 10).alias("relevance_score"),
    )


def region_nodes(spark, d) -> DataFrame:
    """A tree a region: the region, its nations, and each nation's customers by segment."""
    base, _ = trees(spark, d)
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("doc_id"), F.array("r_name").alias("path"), F.array(F.lit(0)).alias("sort_key"), F.lit("").alias("processed_content"))
    below = base.join(region.select("doc_id", F.element_at("path", 1).alias("r")), "doc_id").select("doc_id", F.concat(F.array("r"), "path").alias("path"), F.concat(F.array(F.lit(0)), "sort_key").alias("sort_key"), F.col("content").alias("processed_content"))
    return region.unionByName(below)
