"""Token classes of small hosts against plain vectors; names inside articles; pages that hold their template only."""

import collections
import random

from tessera.llm import htmltext


def pages_of(rng, n):
    """Pages of two hosts: boxes on all pages, on every other, a few times a page, and text of their own; some lack an article."""
    rows = []
    for k in range(n):
        host = f"h{k % 2}.org"
        menu = "".join(f"<li>menu {host} {j}</li>" for j in range(3))
        extra = f"<div class=\"q1\"><b>box of layout {k // 2 % 2} with some words</b></div>" if k // 2 % 2 else "<section>other layout, other box</section>"
        own = "" if k >= n - 2 else "".join(f"<p>{' '.join(rng.choice('lorem ipsum dolor sit amet magna aliqua'.split()) for _ in range(25))} {k}</p>" for _ in range(3))
        rows.append((k, f"http://{host}/{k}", f"<body><div><ul>{menu}</ul></div><div><div>{own}</div>{extra}</div><div>end of {host}, all rights</div></body>"))
    return rows


def test_classes_are_the_equal_vectors(spark):
    rows = pages_of(random.Random(1), 40)
    vectors = collections.defaultdict(lambda: collections.defaultdict(dict))
    for k, url, html in rows:
        for token, (times, _) in htmltext.tokens(htmltext.Page(html)).items():
            vectors[htmltext.host_of(url)][token][k] = times
    want = {}
    for host, own in vectors.items():
        classes = collections.defaultdict(set)
        for token, times in own.items():
            if len(times) >= max(htmltext.MIN_PAGES, htmltext.LEAST_SHARE * 20):
                classes[tuple(sorted(times.items()))].add(token)
        want[host] = {frozenset(c) for c in classes.values()}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {}
    for r in htmltext.host_templates(frame).collect():
        classes = collections.defaultdict(set)
        for t in r["tokens"]:
            classes[t["pages"], t["vector"]].add((t["path"], t["text"], t["kind"]))
        got[r["host"]] = {frozenset(c) for c in classes.values()}
        assert r["pages"] == 20
    assert got == want and all(len(c) > 2 for c in want.values())


def test_a_page_of_its_template_only_is_empty(spark):
    """The unnamed boxes of both layouts go, and the two pages without text of their own are empty."""
    rows = pages_of(random.Random(2), 40)
    got = {r["id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, html in rows:
        own = [b.text for b in htmltext.Page(html).blocks if b.path.endswith("/p")]
        assert got[k] == " ".join(own)
    assert got[38] == got[39] == ""


def test_copies_of_one_page_keep_their_text(spark):
    html = "<body><div>one text that all pages of the host have</div></body>"
    got = htmltext.extract_text(spark.createDataFrame([(k, "http://x.org/a", html) for k in range(6)], "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"one text that all pages of the host have"}


def test_names_inside_an_article():
    """There only a whole name removes a box; outside any part of one does."""
    kept = ["related-work", "comments-on-law", "share-prices", "footnotes-of-the-treaty", "social-contract", "menu-of-a-feast"]
    gone = ["related-posts", "comments", "reader-comments", "comment-list", "social-share-buttons", "ad", "ads-top", "site-nav", "newsletter-box", "footer"]
    body = "".join(f'<div class="{c}">kept {c}</div>' for c in kept) + "".join(f'<div id="{c}">gone {c}</div>' for c in gone)
    text = htmltext.main_text(f"<article><p>start</p>{body}</article><div class='related-work'>outside</div>", None)
    assert text == " ".join(["start", *(f"kept {c}" for c in kept)])
    assert htmltext.main_text("<body><div class='related-work'>x</div><p>y</p></body>", None) == "y"
