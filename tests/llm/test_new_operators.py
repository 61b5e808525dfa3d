"""Packing, the filter audit and fill-in-the-middle against brute force, and on tables with every awkward row."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import audit, infill, packing

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, before long, n long, id long, ids string, mask int, form string, prefix_chars long, output string, h1 long, prefix string, _prefix long, th string, good int, c int"
LONG = "the word\n" * 30_000 + "end"
ROWS = [
    (1, "The cat sat\non the mat\r\nand looked.\n", "en", "a"),
    (2, "The cat sat\non the mat\r\nand looked.\n", "en", "b"),
    (2, "The cat sat\non the mat\r\nand looked.\n", "en", "b"),
    (2, "another text of the same id", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "  \t\n \n\n", "de", "a"),
    (None, "no id here,\nbut # some words", "en", "c"),
    (None, "no id here,\nbut # some words", "en", "c"),
    (None, None, "", "c"),
    (7, LONG, "en", "a"),
    (8, "ÄÖÜ straße 😀\n12345 \xa0nbsp <|endoftext|> it's", "de", "b"),
    (9, "a <P> mark\nof ours", "xx", "d"),
    (10, "LOUD $ WORDS " * 60, "xx", "d"),
    (11, "LOUD $ WORDS " * 60, "xx", "d"),
    (12, "\n", "xx", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "p", 1, 2, 3, "i", 9, "f", 4, "o", 5, "q", 6, "t", 1, 2) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


# --- 11 packing -------------------------------------------------------------------------------------------------------
def ids_of(text, tokenizer):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_encoder_is_the_tokenizer():
    """By word as the tokenizer does whole texts, with awkward characters at every place."""
    make = packing.Encoder(packing.vocabulary())
    assert make.split is not None
    rng = random.Random(3)
    letters = "aAbÄß İǅ'sStT''lL12²¼½ \t\n\x1c\xa0 ́ͅİΣσςАяع中ﬁ😀|<>$%&_-.,​\u0085éÀȀɏǰKÅȺ"
    texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "", "<|endoftext|>it's"]) for _ in range(3000))]
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(x, "<u2").tolist() for x in make.encode(pa.array(texts))]
        assert got == [make.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("length", [2048, 16, 1])
def test_packing(docs, odd, length, tmp_path):
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text")).repartition(5)
    if length == 1:
        both = both.where("length(text) < 300")
    both = both.persist()
    placed = packing.place(both, packing.vocabulary(), str(tmp_path / "ids"))
    got = packing.pieces(placed, length).collect()
    want = collections.Counter((r["doc_id"], tuple(ids_of(r["text"], tokenizer))) for r in both.collect())
    # sequences have no gap and all but the last are full
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    assert sorted(by) == list(range(len(by)))
    for k, rows in by.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == length or k == len(by) - 1
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    # every document's pieces follow each other, and have the ids they should
    pieces = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    found, at = collections.Counter(), 0
    known = collections.defaultdict(list)
    for d, ids in want:
        known[d].append(ids)
    while at < len(pieces):
        own = [pieces[at]]
        while own[-1]["start"] + own[-1]["length"] < own[0]["doc_tokens"]:
            own.append(pieces[at + len(own)])
        at += len(own)
        assert own[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in itertools.pairwise(own))
        ids = next(x for x in known[own[0]["id"]] if len(x) == own[0]["doc_tokens"] and all(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in own))
        found[own[0]["id"], ids] += 1
    assert found == want
    # whole sequences give every document back
    whole = packing.sequences(placed, length).collect()
    assert sorted(r["sequence_id"] for r in whole) == sorted(by)
    stream = [(p["id"], p["start"], r["ids"][p["offset"] : p["offset"] + p["length"]]) for r in sorted(whole, key=lambda r: r["sequence_id"]) for p in r["parts"]]
    again, ids = collections.Counter(), []
    for (d, _, x), after in zip(stream, [*stream[1:], (None, 0, None)], strict=True):
        ids += x
        if after[1] == 0:
            again[d, tuple(ids)] += 1
            ids = []
    assert again == want
    for r in whole:
        assert len(r["ids"]) == (r["n"] if r["n"] & (r["n"] - 1) == 0 else length) and set(r["ids"][r["n"] :]) <= {packing.PAD}
    both.unpersist()


def test_packing_odd_and_empty(odd):
    got = packing.pack_documents(odd).collect()
    assert collections.Counter(r["id"] for r in got if r["start"] == 0) == collections.Counter(r[0] for r in ROWS)
    assert {r["doc_tokens"] for r in got if r["id"] in (3, 4)} == {1}
    assert packing.pack_documents(odd.limit(0)).collect() == [] and packing.sequences(packing.place(odd.limit(0), packing.vocabulary())).collect() == []


def test_part_offsets_over_blocks(spark):
    """Partitions of several blocks: the same as one running sum."""
    rng = random.Random(4)
    rows = [(k, rng.randint(1, 9)) for k in range(0, 3 * packing.BLOCK, 7) for _ in range(2)]
    got = dict(map(tuple, packing.part_offsets(spark.createDataFrame(rows, "part int, n long")).collect()))
    at, want = 0, {}
    for k, n in rows:
        want.setdefault(k, at)
        at += n
    assert got == want


# --- 12 audit ---------------------------------------------------------------------------------------------------------
def failures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {c for c, x in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text)))) if x}


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, lang in rows:
        f = failures(t or "") | ({"E"} if i is not None and i > least[t or ""] else set())
        parts[lang or ""].append((f, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part, members in parts.items():
        value = {c: sum(Fraction(1, len(f)) for f, _, _ in members if c in f) for c in "ABCDE"}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for k, c in enumerate(order, 1):
                gone = [m for m in left if c in m[0]]
                left = [m for m in left if c not in m[0]]
                fails = sum(c in m[0] for m in members)
                out[part, order, k] = (len(left), len(gone), fails - len(gone), sum(m[0] == {c} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone), 120 * value[c])
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_audit(spark, docs, odd, which):
    at = docs if which == "docs" else odd
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    extra = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (10, None, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).unionByName(extra)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit_documents(at, labels).collect()}
    assert got == brute_audit([(r["doc_id"], r["text"], r["lang"]) for r in at.collect()], [tuple(r) for r in labels.collect()])
    assert audit.audit_documents(at.limit(0), labels).collect() == []
    assert len(audit.audit_documents(at, labels.limit(0)).collect()) == len(got)


def test_shapley_is_the_mean_over_orders(spark):
    """Three filters of random counts: what a filter removes, summed over all orders."""
    rng = random.Random(5)
    counts = [("p", m, rng.randint(0, 50), 0, 0) for m in range(8)]
    got = audit.audit(spark.createDataFrame(counts, "part string, mask int, n long, n_good long, n_toxic long"), "ABC").collect()
    for c in "ABC":
        assert {r["shapley"] for r in got if r["filter_order"][r["step"] - 1] == c} == {sum(r["removed"] for r in got if r["filter_order"][r["step"] - 1] == c)}


# --- 13 fill-in-the-middle --------------------------------------------------------------------------------------------
def brute_infill(doc_id, text, unit=infill.UNIT, seed=7, rate=100, spm=50):
    text = text or ""
    u = re.findall(unit, text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= rate:
        return (len(u), "plain", None, None, text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return (len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("how", [{}, {"rate": 40, "spm": 80, "seed": 3}, {"unit": r"\S+\s*|\s+"}])
def test_infill(docs, odd, how):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    if "unit" in how:
        both = both.where("doc_id is null or doc_id < 40")
    made = infill.fill_in_middle(both, **how)
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == both.count()
    for r in rows:
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_infill(r["doc_id"], r["text"], **how)
        assert r["back"] == (r["text"] or "")


def test_infill_keeps_other_columns(odd):
    made = infill.fill_in_middle(odd)
    kept = [c for c in odd.columns if c not in ("form", "prefix_chars", "output")]
    assert sorted(map(str, made.select(*kept).collect())) == sorted(map(str, odd.select(*kept).collect()))
    assert infill.fill_in_middle(odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op12_audit", "op13_infill"])
def test_against_sql(spark, name):
    from tessera.llm import registry

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    df = registry.queries()[name](spark, DIR)
    assert sorted(names) == sorted(df.columns)
    assert sorted((str(tuple(r[c] for c in names)) for r in df.collect())) == sorted(map(str, cur.fetchall()))
