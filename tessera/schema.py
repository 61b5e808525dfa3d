"""Schemas of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType(
    [T.StructField("hierarchy_path", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("citations", T.ArrayType(T.StringType())), T.StructField("refs", T.ArrayType(T.StringType()))]
    + [T.StructField("caption", T.StringType()), T.StructField("source", T.StringType())]
)
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("content", T.StringType())])
CHUNKS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("chunk_id", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("content", T.StringType()), T.StructField("parent_section", T.StringType()), T.StructField("metadata", METADATA)]
)
SKELETON = T.StructType(
    [T.StructField("template", T.StringType()), T.StructField("node_idx", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("path_key", T.StringType()), T.StructField("parent_idx", T.IntegerType()), T.StructField("depth", T.IntegerType())]
    + [T.StructField("title", T.StringType()), T.StructField("sort_key", T.ArrayType(T.IntegerType())), T.StructField("prompt", T.StringType()), T.StructField("description", T.StringType())]
    + [T.StructField("generative", T.BooleanType()), T.StructField("dynamic_subsections", T.BooleanType())]
)
SCORES = "doc_id long, chunk_id int, node_idx int, score double"
EDGES = "doc_id long, src int, dst int, ref_pos int"
#: Separates the titles of a path, for display and for matching.
PATH_SEPARATOR = " -> "
