"""Section templates as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.materialize import materialized
from tessera.schema import PATH_SEPARATOR, SKELETON

DEFAULT = "bitcoin_paper"
# The titles of the two templates, with the flags of their nodes.
FLAT_TITLES = [
    "Summary", "Abstract", "1. Introduction", "2. Transactions", "3. Timestamp Server", "4. Proof-of-Work", "5. Network", "6. Incentive", "7. Reclaiming Disk Space",
    "8. Simplified Payment Verification", "9. Combining and Splitting Value", "10. Privacy", "11. Major and Minor Assumptions", "12. Calculations", "13. Conclusion",
]
TREE_TITLES = {
    "Summary": {"generative": True}, "Abstract": {"generative": True}, "1. Introduction": {}, "2. Transactions": {}, "3. Timestamp Server": {}, "4. Proof-of-Work": {}, "5. Network": {}, "6. Incentive": {},
    "7. Reclaiming Disk Space": {}, "8. Simplified Payment Verification": {}, "9. Combining and Splitting Value": {},
    "10. Security Analysis": {"subsections": {"10.1 Privacy Model": {}, "10.2 Attack Vector Calculations": {}}},
    "11. Assumptions": {"subsections": {"11.1 Major Assumptions": {}, "11.2 Minor Assumptions": {}}},
    "12. Conclusion": {}, "13. References": {}, "14. System Tests": {"dynamic_subsections": True},
}

#: What a section is about, by the words of its title; used to compare chunks with sections.
TOPICS = {
    "summary": "overview of the whole document, its problem and its solution",
    "abstract": "short formal summary of the paper",
    "introduction": "background of commerce on the internet, trust in financial institutions, the need for electronic payment without a third party",
    "transactions": "an electronic coin as a chain of digital signatures and its transfer between owners",
    "timestamp": "double spending and a distributed timestamp server that publishes hashes of blocks",
    "proof": "proof of work by hashing with a nonce, one vote for each processor",
    "network": "steps of running the network: broadcasting transactions, collecting blocks, the longest chain",
    "incentive": "rewards of nodes: new coins and transaction fees",
    "disk": "pruning of spent transactions with a Merkle tree to save disk space",
    "verification": "verifying payments without a full node, with block headers",
    "combining": "transactions of several inputs and outputs that combine and split value",
    "security": "security of the system against attackers",
    "privacy": "privacy by anonymous public keys",
    "calculations": "probability that an attacker catches up, Poisson density and random walk",
    "assumptions": "assumptions about honest nodes, network and participants",
    "conclusion": "summary of the proposal and its benefits",
    "references": "citations of earlier work",
    "tests": "test cases of the system with set-up, actions and expected results",
}


def _topic(title: str) -> str:
    low = title.lower()
    return next((topic for word, topic in TOPICS.items() if word in low), title)


def _node(title: str, extra: dict) -> dict:
    return {
        "prompt": f"Edit the text of the section {title}; keep all technical content.",
        "description": _topic(title),
        **{k: v for k, v in extra.items() if k != "subsections"},
        "subsections": {t: _node(t, e) for t, e in extra.get("subsections", {}).items()},
    }


TEMPLATES: dict[str, list | dict] = {
    "bitcoin_paper": [{"section": t, **{k: v for k, v in _node(t, {}).items() if k != "subsections"}} for t in FLAT_TITLES],
    "bitcoin_paper_hierarchical": {t: _node(t, e) for t, e in TREE_TITLES.items()},
}


def flatten(template: list | dict, name: str = "") -> list[tuple]:
    """Rows of ``schema.SKELETON``, in depth-first order (T1); lists are templates of depth 1, other values than nodes are passed over."""
    if isinstance(template, list):
        template = {n["section"]: n for n in template}
    rows: list[tuple] = []

    def visit(level: dict, path: list[str], key: list[int], parent: int | None):
        for k, (title, node) in enumerate(level.items()):
            if not isinstance(node, dict):
                continue
            own = [*path, title]
            at = len(rows)
            rows.append((name, at, own, PATH_SEPARATOR.join(own), parent, len(own), title, [*key, k], node.get("prompt"), node.get("description"), bool(node.get("generative")), bool(node.get("dynamic_subsections"))))
            visit(node.get("subsections") or {}, own, [*key, k], at)

    visit(template, [], [], None)
    return rows


def skeleton(spark: SparkSession, template: str | list | dict = DEFAULT, path: str | None = None) -> DataFrame:
    """A template as a table; an unknown name gives the default one (S8).  ``path``: a JSON file with templates by name."""
    known = TEMPLATES | (json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {})
    name = template if isinstance(template, str) else "custom"
    body = known.get(template, known[DEFAULT]) if isinstance(template, str) else template
    return spark.createDataFrame(flatten(body, name), SKELETON)


def skeleton_of_table(nodes: DataFrame, id_col: str, parent_col: str, title_col: str, order_col: str, max_depth: int = 1000) -> DataFrame:
    """Rows (id, path, path_key, depth, sort_key) of a tree given by parents (null: root), level by level.

    Nodes that no root reaches (a parent that isn't there, a cycle) are left out; more than ``max_depth`` levels are an error.
    """
    base = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(title_col).alias("title"), F.col(order_col).cast("int").alias("ord"))
    level = base.where("parent is null").select("id", F.array("title").alias("path"), F.array("ord").alias("sort_key"))
    found = level
    for _ in range(max_depth):
        level = base.join(level.withColumnRenamed("id", "parent"), "parent").select("id", F.concat("path", F.array("title")).alias("path"), F.concat("sort_key", F.array("ord")).alias("sort_key"))
        level = materialized(level)
        if level.isEmpty():
            break
        found = found.unionByName(level)
    else:
        raise ValueError(f"the tree has more than {max_depth} levels")
    return found.select("id", "path", F.array_join("path", PATH_SEPARATOR).alias("path_key"), F.size("path").alias("depth"), "sort_key")


def ordered_text(df: DataFrame, by: list[str], order: str, text: Column, separator: str) -> DataFrame:
    """Rows (by, text): texts of a group in order, joined."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), separator).alias("text"))


def outline(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Indented titles of each tree (T4)."""
    return ordered_text(nodes, by, "sort_key", F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.lit("- "), F.element_at("path", -1)), "\n")


def section_details(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Paths and descriptions of each tree's nodes, for prompts (T5)."""
    return ordered_text(nodes, by, "sort_key", F.concat(F.lit("- "), F.col("path_key"), F.lit(": "), F.coalesce("description", F.lit(""))), "\n")
