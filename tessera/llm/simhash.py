"""SimHash near-duplicates, found by a generalised pigeonhole.

Fingerprints of 64 bits are linked when at most ``tau`` bits differ.  The 64 bits are split into ``m`` groups, correlated
bits together, and group i gets a threshold T_i >= -1 with sum(T) = tau - m + 1: two fingerprints within ``tau`` bits then
agree in some group up to T_i bits (-1: the group isn't searched).  ``plan_partitions`` chooses m and T by dynamic
programming on the number of key rows and the candidate pairs expected from the bit statistics of the whole table.

A group with threshold t is searched with one mask for each choice of t of its bits to leave out; fingerprints that share
a masked value are candidates and are verified by counting bits inside the join condition.  A masked value shared by more
than ``hot`` fingerprints isn't compared in pairs: its members are keyed by every mask that leaves out ``tau`` of the other
bits, so that each key holds at most 2**tau fingerprints, all of them links.  That is linear in the group and loses none.

Equal fingerprints are one node throughout, so copies are never expanded into pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, salted_join, sized, small_batches, table, tidy
from tessera.llm.components import connected_components

BITS = 64
_CHUNK = 1 << 16


def shingle_list(text: str | None, k: int) -> list[bytes]:
    """Space-joined k-word shingles of the text, A-Z lower-cased, repeats included; fewer words: one shingle; none: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(k)), strict=False)]


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """64 bits as a signed integer; a bit is 1 if set in over half the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    shingles = shingle_list(text, k)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK]
        hashes = np.fromiter((digest(s, seed) for s in part), dtype=">u8", count=len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles)).view(">i8")[0]) if shingles else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp): one for each row of ``docs``.  Null and empty texts have fingerprint 0."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k, seed) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bit_statistics(nodes: DataFrame, rows_per_task: int = 200_000) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all rows of ``nodes`` (fp).

    Small partitions are read together, so that the number of Python tasks follows the rows.
    """

    def count(batches):
        both, n = np.zeros((BITS, BITS), dtype=np.float64), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            for at in range(0, len(bits), 1 << 20):
                part = bits[at : at + (1 << 20)]
                both += part.T @ part
            n += len(bits)
        if n:
            r, c = np.triu_indices(BITS)
            yield pd.DataFrame({"r": r, "c": c, "n": both[r, c].astype(np.int64), "rows": n})

    tasks = -(-nodes.count() // rows_per_task)
    rows = nodes.select("fp").coalesce(max(1, tasks)).mapInPandas(count, "r int, c int, n long, rows long").groupBy("r", "c").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    together = np.zeros((BITS, BITS))
    for x in rows:
        together[x["r"], x["c"]] = together[x["c"], x["r"]] = x["n"]
    return (rows[0]["rows"] if rows else 0), together


def _agreement(n: int, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that two random fingerprints agree in a bit, and in both of two bits."""
    p11 = (together + 0.5) / (n + 2)
    p1 = np.diag(p11)
    p10, p01 = np.clip(p1[:, None] - p11, 1e-9, 1), np.clip(p1[None, :] - p11, 1e-9, 1)
    p00 = np.clip(1 - p11 - p10 - p01, 1e-9, 1)
    return p1**2 + (1 - p1) ** 2, p11**2 + p10**2 + p01**2 + p00**2


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64/m bits; each grows by the bit most correlated with it."""
    p1 = np.clip(np.diag(together) / max(n, 1), 1e-6, 1 - 1e-6)
    sd = np.sqrt(p1 * (1 - p1))
    corr = np.abs((together / max(n, 1) - np.outer(p1, p1)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        own = [max(free, key=lambda b: (corr[b, list(free)].sum(), -b))]
        free -= set(own)
        while len(own) < width:
            nearest = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(nearest)
            free.discard(nearest)
        groups.append(sorted(own))
    return groups


def _log2_collision(group: list[int], single: np.ndarray, pair: np.ndarray) -> float:
    """log2 of the probability that two random fingerprints agree in the whole group, by a tree of the strongest pairs."""
    total = sum(log2(single[b]) for b in group)
    inside, outside = {group[0]}, set(group[1:])
    while outside:
        gain, b = max((log2(pair[a, b] / (single[a] * single[b])), b) for a in inside for b in outside)
        total += max(gain, 0.0)
        inside.add(b)
        outside.discard(b)
    return min(total, 0.0)


def plan_partitions(n: int, together: np.ndarray, tau: int, row_cost: float = 1.0, pair_cost: float = 0.05) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, at the least expected cost over all m up to tau + 1."""
    single, pair = _agreement(n, together)
    best = (float("inf"), [])
    for m in range(1, tau + 2):
        groups = group_bits(n, together, m)

        def cost(group: list[int], t: int, single=single, pair=pair) -> float:
            if t < 0:
                return 0.0
            masks = comb(len(group), t)
            alike = 2.0 ** (_log2_collision(group, single, pair) * (len(group) - t) / len(group))
            return masks * (n * row_cost + n * n / 2 * alike * pair_cost)

        states = {0: (0.0, [])}  # sum of T so far -> least cost and the thresholds
        for group in groups:
            after: dict[int, tuple[float, list[int]]] = {}
            costs = {t: cost(group, t) for t in range(-1, tau + 1)}
            for used, (spent, ts) in states.items():
                for t, more in costs.items():
                    at = (spent + more, [*ts, t])
                    if used + t not in after or at < after[used + t]:
                        after[used + t] = at
            states = after
        if (found := states.get(tau - m + 1)) and found[0] < best[0]:
            best = (found[0], list(zip(groups, found[1], strict=True)))
    return best[1]


def _mask(bits) -> int:
    """Signed 64-bit integer with these bits set."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _constants(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L-1L)" for v in values) + ")")


def hamming_links(nodes: DataFrame, tau: int = 2, hot: int = 2000) -> DataFrame:
    """Links (a, b) between nodes (rep, fp) within ``tau`` bits that leave the same components as all such links.

    ``fp`` must be distinct.  Every close pair in a masked value of up to ``hot`` nodes is returned; in larger ones each
    node is linked to the least of those that differ from it in the left-out bits only.
    """
    n, together = bit_statistics(nodes)
    if n < 2:
        return nodes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    keep: list[tuple[int, set[int]]] = []
    for group, t in plan_partitions(n, together, tau):
        if t >= 0:
            keep += [(_mask(set(group) - set(out)), set(group) - set(out)) for out in combinations(group, t)]
    keys = nodes.select("rep", "fp", F.explode(_constants([k for k, _ in keep])).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    crowded = cut(keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > hot).select("mask", "key"))
    masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]
    cold = keys.join(crowded, ["mask", "key"], "left_anti") if masks else keys
    x, y = cold.alias("x"), cold.alias("y")
    near = (F.col("x.mask") == F.col("y.mask")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= tau)
    links = x.join(y, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    for kept, bits in keep:
        if kept in masks:
            left_out = [~_mask(out) for out in combinations(sorted(set(range(BITS)) - bits), tau)]
            members = keys.where(F.col("mask") == kept).join(crowded, ["mask", "key"], "left_semi")
            fine = members.select("rep", "fp", F.explode(_constants(left_out)).alias("fine")).select("rep", "fine", F.col("fp").bitwiseAND(F.col("fine")).alias("key"))
            stars = fine.groupBy("fine", "key").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
            links = links.unionByName(stars.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a < b"))
    return links


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, tau: int = 2, hot: int = 2000) -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of ``docs``.

    component_id is the smallest id reachable over links.  A null or empty text has fingerprint zero and is linked like any
    other; rows without an id can't carry a component, so theirs is that of the rows they are linked with through an equal
    fingerprint, else null.  Repeated rows stay.  An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, k, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = connected_components(hamming_links(nodes.where("rep is not null"), tau, hot))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(nodes["fp"], F.coalesce("root", "rep").alias("component_id"))
    # a fingerprint that many have is dealt
    return salted_join(prints, named, "fp").select("id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


# Near copies by the similarity of their shingles.
#
# Two sets of shingles that reach the similarity share one in their first few, in any order of all shingles that both use
# (prefix filtering).  So each text's shingles are ordered, rare ones first, and the first of them, its tokens, are joined.
# Sets that are alike differ in few shingles, so their sketches, the parities of their hashes' counts in SKETCH bits or more,
# differ in no more bits: a pair whose sketches are further apart needn't be compared.  All links are found that way.  A sketch
# has at least two bits for each shingle, else long texts fill it and none of their pairs is left out.
#
# A group of thousands of copies shares most of its tokens.  So the pigeonhole above goes first, over fingerprints of the same
# shingles: it proposes the pairs within ``tau`` bits.  A token then proposes one link for each of its texts only, to a leader
# drawn for the token; of its proposals a text tries the closest.  Both are linear in crowds, and what is linked then counts
# as one: after ``rounds`` of leaders, all pairs of a token's texts that aren't in one component yet are compared.  What these
# steps miss costs time, not links; every link is one whose sets reach the similarity.
SKETCH = 512
#: Texts of a token from which on pairs are left out by their sketches in the join itself.
CROWDED = 8
#: First tokens of a text that tell whether a pair has been met before.
HEAD = 16


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles, as signed integers."""
    found = shingle_list(text, k)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, seed) for s in found), dtype=np.uint64, count=len(found)).astype(np.int64))


def common_shingles(rows: DataFrame, k: int, texts: int = 20_000, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes that occur in more than one of about ``texts`` sampled texts, and in how many.

    They only order the shingles of a text, so a sample costs no links.
    """

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, k) for t in texts])

    share = texts / max(rows.count(), 1)
    taken = rows.where(F.rand(7) < share) if share < 1 else rows
    found = taken.select(F.explode(hashes("text")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = found.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = found["h"].to_numpy(), found["n"].to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def prefix_of(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first hashes, rare ones first, of which a set that is similar enough and not smaller or larger has at least one."""
    own = np.asarray(hashes, dtype=np.int64)
    often = np.zeros(len(own), dtype=np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        often = np.where(common[0][at] == own, common[1][at], 0)
    return own[np.lexsort((own, often))[: len(own) - ceil(similarity * len(own) - 1e-9) + 1]] if len(own) else own


def print_of(hashes: np.ndarray) -> int:
    """64 bits as a signed integer; a bit is 1 if set in over half the hashes."""
    counts = sum((np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(hashes), _CHUNK)), np.zeros(BITS, dtype=np.int64))
    return int(np.packbits(counts * 2 > len(hashes)).view(np.int64)[0])


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Bits as signed integers: whether an odd number of the hashes has a bit's place.

    There are SKETCH of them or, from half as many hashes on, the power of two from two a hash; a longer sketch folds to a
    shorter one.
    """
    width = max(SKETCH, 1 << max(2 * len(hashes) - 1, 1).bit_length())
    counts = np.bincount((hashes & (width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _folded(bits: Column, words: Column) -> Column:
    """A sketch of so many words from one of as many or more."""
    place = lambda i: F.aggregate(F.sequence(i, F.size(bits) - 1, words), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(bits, j)))
    return F.when(F.size(bits) == words, bits).otherwise(F.transform(F.sequence(F.lit(0), words - 1), place))


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches of SKETCH bits differ."""
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, SKETCH // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def _apart_folded(a: str, b: str) -> Column:
    """Bits in which two sketches differ, of any lengths: the longer is folded."""
    words = F.least(F.size(a), F.size(b))
    both = F.zip_with(_folded(F.col(a), words), _folded(F.col(b), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when((F.size(a) == SKETCH // 64) & (F.size(b) == SKETCH // 64), _apart(a, b)).otherwise(F.aggregate(both, F.lit(0), lambda s, x: s + x))


def _may(apart: Column, na: Column, nb: Column, similarity: float) -> Column:
    return apart <= (1 - similarity) / (1 + similarity) * (na + nb) + 1e-9


def sketched(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches allow the similarity, with na, nb (sizes) and apart (bits)."""
    own = lambda x: nodes.select(F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").withColumn("apart", _apart_folded("bits_a", "bits_b")).drop("bits_a", "bits_b")
    return both.where(_may(F.col("apart"), F.col("na"), F.col("nb"), similarity))


def fingerprint_pairs(nodes: DataFrame, similarity: float, tau: int) -> DataFrame:
    """Candidates (a, b) by the pigeonhole: of the ``nodes`` (uid, n, bits, fp) those whose fingerprints are within ``tau`` bits;
    of nodes of one fingerprint each with the first of them."""
    own = nodes.where("n > 0").select("uid", "fp")
    prints = cut(own.groupBy("fp").agg(F.min("uid").alias("rep")))
    same = salted_join(own, prints, "fp").where("uid <> rep").select(F.col("uid").alias("a"), F.col("rep").alias("b"))
    return sketched(hamming_links(prints, tau).distinct().unionByName(same), nodes, similarity).select("a", "b")


def proposals(mixed: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): of each text the closest of its tokens' leaders; from ``mixed`` (uid, label, n, lead: uid, label and n
    of the token's leader)."""
    alike = (F.least("n", "lead.n") >= similarity * F.greatest("n", "lead.n") - 1e-9) & (F.col("label") != F.col("lead.label"))
    met = mixed.where(alike).groupBy(F.col("uid").alias("a"), F.col("lead.uid").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    best = sketched(met, nodes, similarity).groupBy("a").agg(F.min(F.struct(F.round(F.col("apart") / (F.col("na") + F.col("nb")), 2).alias("far"), (-F.col("times")).alias("times"), "b")).alias("best"))
    return best.select("a", "best.b")


def all_pairs(mixed: DataFrame, nodes: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """Candidates (a, b): every pair of one token's texts in ``mixed`` (token, uid, label, n, pos, size) whose labels differ
    and that can reach the similarity.

    Texts that are alike in part share hundreds of tokens of few texts.  So the texts of a token of up to ``CROWDED`` are one
    list, and each list gives its pairs once.  In larger tokens rows carry their sketch, folded, and their first tokens: pairs
    too far apart, and those that an earlier token has met, are left out where they are made.  A token of more than ``crowd``
    texts is dealt out: its smaller sets into parts, the others to every part, so that all its pairs are still compared, but
    not in one task.

    Each of the steps is a query of its own: a task reports the figures of all steps of its query to the driver, and the join
    may have thousands of tasks.
    """
    both = similarity / (1 + similarity)

    def pairs(x: Column, y: Column) -> Column:
        """Whether y is the smaller of two sets of different labels that can reach the similarity."""
        smaller = (y["n"] < x["n"]) | ((y["n"] == x["n"]) & (y["uid"] < x["uid"]))
        return (x["label"] != y["label"]) & smaller & (y["n"] >= similarity * x["n"] - 1e-9)

    lists = mixed.where(F.col("size") <= CROWDED).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("uid", "label", "n"))).alias("texts")).select("texts").distinct()
    of = lambda x: F.transform(F.filter("texts", lambda y: pairs(x, y)), lambda y: F.struct(x["uid"].alias("a"), y["uid"].alias("b")))
    few = cut(lists.select(F.explode(F.flatten(F.transform("texts", of))).alias("pair")).select("pair.*").distinct())
    many = mixed.where(F.col("size") > CROWDED).withColumn("parts", F.ceil(F.col("size") / crowd).cast("int"))
    many = many.join(nodes.select("uid", _folded(F.col("bits"), F.lit(SKETCH // 64)).alias("bits"), F.slice("prefix", 1, HEAD).alias("head")), "uid")
    many = cut(many.withColumn("head", F.slice("head", 1, F.least(F.col("pos"), F.lit(HEAD)))))
    # of a pair the smaller set has a shared one among even fewer
    y = many.where(F.col("pos") <= F.col("n") - F.ceil(2 * both * F.col("n") - 1e-9)).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    x, y = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x"), y.alias("y")
    able = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= both * (F.col("x.n") + F.col("y.n")) - 1e-9
    close = _may(_apart("x.bits", "y.bits"), F.col("x.n"), F.col("y.n"), similarity) & ~F.arrays_overlap("x.head", "y.head")
    row = lambda side: {c: F.col(f"{side}.{c}") for c in ("uid", "label", "n")}
    found = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & pairs(row("x"), row("y")) & able & close)
    tidy(nodes.sparkSession)
    found = cut(found.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct())
    many = x = y = None
    tidy(nodes.sparkSession)
    return sketched(found.unionByName(few).distinct(), nodes, similarity).select("a", "b")


def verified(links: DataFrame, sets_of, similarity: float) -> DataFrame:
    """The ``links`` (a, b) of texts whose shingles reach the similarity; ``sets_of``: from a table of uids that of their
    sets (uid, h)."""
    links = cut(links)
    sets = sets_of(links.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
    both = links.join(sets.select(F.col("uid").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("uid").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return cut(both.where((common >= similarity * (F.size("ha") + F.size("hb") - common)) & (common > 0)).select("a", "b"))


def shared_tokens(nodes: DataFrame, common: DataFrame) -> DataFrame:
    """Rows (token, uid, n, pos) of the ``nodes`` (uid, n, prefix): tokens that more than one has, and a few others.

    ``common`` (token, parts): the frequent tokens of a sample, a table of bounded size, and to how many parts each is dealt;
    they are taken as shared.  So no token's rows are all in one group.
    """
    each = nodes.select("uid", "n", F.posexplode("prefix").alias("pos", "token")).join(F.broadcast(common), "token", "left")
    each = each.withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("uid"), F.col("parts"))))
    each = each.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token", "salt")))
    return cut(each.where("size > 1 or parts is not null").select("token", "uid", "n", "pos"))


def similar_sets(nodes: DataFrame, common: DataFrame, sets_of, similarity: float, rounds: int = 1, crowd: int = 2000, tau: int = 2) -> DataFrame:
    """Rows (node, root): components of the ``nodes`` (uid, n, prefix, bits, fp) linked by the similarity of their sets."""
    links = verified(fingerprint_pairs(nodes, similarity, tau), sets_of, similarity)
    labels = connected_components(links)
    shared = shared_tokens(nodes, common)
    for k in range(rounds + 1):
        tokens = shared.join(labels, shared["uid"] == labels["node"], "left").select(*shared.columns, F.coalesce("root", "uid").alias("label"))
        drawn = F.struct(F.xxhash64("uid", "token", F.lit(k)).alias("drawn"), "uid", "label", "n")
        each = tokens.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"), F.min(drawn).alias("lead"))
        mixed = tokens.join(each.where("low <> high").select("token", "size", "lead"), "token")
        found = verified(proposals(mixed, nodes, similarity) if k < rounds else all_pairs(mixed, nodes, similarity, crowd), sets_of, similarity)
        links = cut(links.unionByName(found))
        tokens = each = mixed = found = None
        labels = connected_components(links)
    return labels


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """Rows (id, component_id) of the ids whose text has an equal or near copy (Jaccard of k-word shingles) of another id.

    component_id is the smallest id reachable over such links; every link counts.  Null ids are left out; a null text counts
    as empty; equal texts are one node, so copies are never expanded.  An id that is repeated has the row of each of its texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"))
    spark = rows.sparkSession
    sample = common_shingles(rows, k)
    often = spark.sparkContext.broadcast(sample)
    hot = sample[1] >= 200  # of 20,000 sampled texts
    common = spark.createDataFrame(pd.DataFrame({"token": sample[0][hot], "parts": sample[1][hot]}), "token long, parts long")

    @F.pandas_udf("n int, prefix array<long>, bits array<long>, fp long")
    def described(texts: pd.Series) -> pd.DataFrame:
        found = []  # a text's hashes are many: none are held longer than it takes
        for t in texts:
            own = shingle_hashes(t, k)
            found.append((len(own), prefix_of(own, similarity, often.value), sketch_of(own), print_of(own)))
        return pd.DataFrame(found, columns=["n", "prefix", "bits", "fp"])

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, k) for t in texts])

    same = F.unhex(F.md5("text")).alias("same")
    first = rows.select("id", same, described("text").alias("w")).groupBy("same").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("w").alias("w"))
    with small_batches(spark):
        nodes = cut(first.select("same", "rep", "last", F.monotonically_increasing_id().alias("uid"), "w.*"))

    def sets_of(uids: DataFrame) -> DataFrame:
        wanted = sized(nodes.select("uid", F.col("rep").alias("id"), "same").join(uids, "uid"))
        with small_batches(spark):
            return cut(rows.select("id", same, "text").join(wanted, ["id", "same"]).dropDuplicates(["uid"]).select("uid", hashes("text").alias("h")))

    roots = similar_sets(nodes.select("uid", "n", "prefix", "bits", "fp"), common, sets_of, similarity, **how)
    grouped = cut(nodes.select("same", "rep", "last", "uid").join(roots, nodes["uid"] == roots["node"], "left").where("root is not null or rep <> last").select("same", "rep", F.coalesce("root", "uid").alias("root")))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    # equal texts may be many: each is one of a few rows to which its copies are dealt
    named = salted_join(grouped, least, "root").select("same", "component_id")
    return salted_join(rows.select("id", same), named, "same").select("id", "component_id").distinct()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without those that are equal or near copies of a row with a smaller id; its columns stay as they
    are, whatever their names.

    Of rows that repeat an id one stays (the least text hash).  Rows without an id stay as they are.  An empty table stays
    empty.
    """
    found = near_copies(docs, id_col, text_col, **how)
    gone = sized(found.where("id <> component_id").select(F.col("id").alias(id_col)).distinct())
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    repeated = sized(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col))
    if repeated.isEmpty():
        return kept
    rank = fresh("_rank", docs)
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    one = kept.join(repeated, id_col, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
    return kept.join(repeated, id_col, "left_anti").select(*docs.columns).unionByName(one)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash components of all documents (3-word shingles, up to 2 differing bits)."""
    found = near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
