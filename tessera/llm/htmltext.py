"""Main text of web pages by deducing the template of each host from equivalence classes of tokens.

Tokens of a page are its block elements, told apart by their path, and its text blocks.  Tokens of a host that occur equally
often in the same pages share an occurrence vector and form an equivalence class.  A class is valid if it

- occurs in at least ``MIN_PAGES`` pages and a share of ``LEAST_SHARE`` of the host's,
- occurs in nearly all pages (``COVER``) of the class around it, or has an element of its own to hold its texts, or is
  large (``LARGE`` texts that always come together: a single text that pages share is no template), and
- doesn't fill its slot: texts that are most of what their place holds are the content of copied pages, not template.

Valid classes nest by their elements: the class of all pages, in it those of layouts and of boxes that only some pages have.
What the texts of valid classes leave over is in slots.  The slot of a page's article is found going down from the root among
the template elements that the page has, as long as one holds most of what is left over there.  Names only choose among
slots: elements that never hold an article (menus, headers, footers, sidebars, adverts, forms, scripts, comments) aren't
gone into, and where a page names its article (``article``, ``main``) that is the slot; of it only boxes that are valid
classes are taken out.  Hosts of fewer than ``MIN_PAGES`` pages have no template, and names decide alone.

Vectors are never gathered: a vector is the number of pages and a sum of hashes of (page, count), both summed by host and
token with a partial aggregation, so a host with a third of all pages is no hot task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SMALL, cut, size_of, table

MIN_PAGES = 4
LEAST_SHARE = 0.1
LARGE = 3
COVER = 0.8
MOST = 0.7
#: Share of a host's text that must be its pages' own for a page without any to be empty.
OWN = 0.05

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^\s>/]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s>/]*)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)

#: Elements with raw text, that of script and style is never shown.
RAW = frozenset("script style noscript template textarea xmp iframe noframes".split())
#: Elements that never hold an article.
OUTSIDE = frozenset("head nav footer aside form script style noscript template textarea select button svg canvas iframe object audio video dialog menu noframes fieldset label input math datalist".split())
BLOCKS = frozenset(
    "html body head div section article main nav aside header footer ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption"
    " form fieldset address hr details summary center dialog menu title search hgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that end an open paragraph.
ENDS_P = BLOCKS - {"html", "body", "head", "title"}
#: What a start tag closes: the tag, and where the search stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of class, id and role that mark what is no article; those that may as well name a part of one, which count for template
# elements and where there is no template; and words that say nothing beside them.
_NOISE = (
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|side-?bar|widgets?|nav\w*|menus?|breadcrumbs?|pagination|pager|toolbar|masthead|site-?header|page-?header|top-?bar"
    r"|foot\w*|copyright|comments?|comment-?\w*|replies|reply|respond|disqus|social\w*|related|recommend\w*|read-?more|more-?stories|teasers?|newsletter|subscri\w*|sign-?up|log-?in|forms?|skip\w*"
    r"|hidden|sr-only|visually-hidden|byline-links|outbrain|taboola|complementary|navigation|contentinfo|alertdialog"
)
_DOUBTFUL = r"notices?|alerts?|legal|disclaimer|discussion|share\w*|sharing|search\w*|tags?"
_NEUTRAL = (
    r"site|page|top|bottom|left|right|main|global|user|reader|visitor|post|posts|article|articles|story|stories|entry|section|box|boxes|list|block|wrap|wrapper|container|area|bar|items?|links?|content|inner|outer|module|panel|title|head|header|body"
    r"|count|buttons?|icons?|group|row|col|column|slot|unit|space|holder|text|nav|menu|form|media|inline|sticky|fixed|small|large|mobile|desktop|thread|feed|[0-9]+"
)


def _anywhere(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[-_ ])(?:{words})(?:$|[-_ ])", re.I)


def _alone(words: str) -> re.Pattern:
    """A whole name of these words and such as say nothing: ``related-posts``, not ``related-work``."""
    return re.compile(rf"(?:^| )(?:(?:{_NEUTRAL})[-_])*(?:{words})(?:[-_](?:{_NEUTRAL}|{_NOISE}|{_DOUBTFUL}))*(?:$| )", re.I)


#: By whether it is inside what the page names its article: there only whole names count.
NOISE = {False: _anywhere(_NOISE), True: _alone(_NOISE)}
DOUBTFUL = {False: _anywhere(_DOUBTFUL), True: _alone(_DOUBTFUL)}
#: Elements that hold boxes; others (paragraphs, lists, tables) are content wherever they stand.
BOXES = frozenset("div section article center details dialog fieldset td address".split())
MAIN = re.compile(r"(?:^|[-_ ])(?:article-?(?:body|content|text)?|post-?(?:body|content)?|entry-?(?:body|content)?|main-?content|content-?(?:body|main)?|story-?(?:body)?|main)(?:$|[-_ ])", re.I)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Block:
    __slots__ = ("doubtful", "outside", "path", "text", "within")

    def __init__(self, path, within, outside, doubtful, text):
        self.path, self.within, self.outside, self.doubtful, self.text = path, within, outside, doubtful, text


class Page:
    """Text blocks in page order and the paths of block elements, from one pass over the html."""

    def __init__(self, html: str | None):
        self.blocks: list[Block] = []
        self.elements: dict[str, int] = defaultdict(int)
        self.articles: list[int] = []  # identity of each article element, by kind
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        # an open element: tag, path, outside, path of the element around with a doubtful name, identity of the articles around
        stack: list[tuple[str, str, bool, str, tuple]] = [("", "", False, "", ())]
        buffer: list[str] = []
        count = 0

        def flush():
            if buffer:
                if text := " ".join(unescape("".join(buffer)).split()):
                    _, path, outside, doubtful, within = stack[-1]
                    self.blocks.append(Block(path, within, outside, doubtful, text))
                buffer.clear()

        def close(k: int):
            flush()
            del stack[k:]

        skip_to = ""
        for match in _TOKEN.finditer(html):
            token = match.group()
            if skip_to:
                if token.startswith("</") and (m := _TAG.match(token)) and m[2].lower() == skip_to:
                    skip_to = ""
                continue
            if token[0] != "<" or len(token) == 1:
                buffer.append(token)
                continue
            if token.startswith("<![CDATA["):
                buffer.append(token[9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            m = _TAG.match(token)
            if not m:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCKS or tag in OUTSIDE:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if stack[k][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "div", "section", "article", "body", "html", "main"):
                            break
                elif tag == "p":
                    flush()
                continue
            if tag in RAW:
                if not token.endswith("/>"):
                    skip_to = tag
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag not in BLOCKS and tag not in OUTSIDE:
                continue
            flush()
            if tag in VOID or token.endswith("/>") and tag not in BLOCKS:
                continue
            if tag in ENDS_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in stops:
                        break
            if tag == "body":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "head":
                        close(k)
                        break
            _, path, outside, doubtful, within = stack[-1]
            names = ""
            is_main = tag in ("article", "main")
            if len(token) > len(tag) + 2:
                attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(token[len(tag) + 1 :].rstrip(">"))}
                names = " ".join(filter(None, (attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""))))
                if tag not in ("html", "body", "article", "main") and names and NOISE[bool(within)].search(names) or tag == "article" and re.search(r"comment|reply|teaser|related|promo|(?:^|[-_ ])ads?(?:$|[-_ ])", names, re.I) or "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
                    outside = True
                if tag in ("div", "section", "td") and names and not outside and MAIN.search(names) or attrs.get("itemprop", "").lower() == "articlebody":
                    is_main = True
            if tag in OUTSIDE or tag == "header" and not any(kind == "article" for kind, _ in within):
                outside = True
            path = f"{path}/{tag}.{'.'.join(names.replace('/', ' ').split())}" if names else f"{path}/{tag}"
            if names and not doubtful and tag not in ("html", "body", "article", "main") and DOUBTFUL[bool(within)].search(names):
                doubtful = path
            if not outside:
                self.elements[path] += 1
            if is_main:
                count += 1
                within = (*within, ("article" if tag == "article" else "main" if tag == "main" else "named", count))
            stack.append((tag, path, outside, doubtful, within))
        flush()

    def article(self) -> list[Block] | None:
        """Blocks of what the page itself names its article: the fullest ``article``, else ``main``, else named element."""
        for kind in ("article", "main", "named"):
            sizes: dict[int, int] = defaultdict(int)
            for b in self.blocks:
                if not b.outside:
                    for k, i in b.within:
                        if k == kind:
                            sizes[i] += len(b.text)
            if sizes:
                best = max(sizes, key=lambda i: (sizes[i], -i))
                return [b for b in self.blocks if not b.outside and any(i == best for _, i in b.within)]
        return None


def key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1


def tokens(page: Page) -> dict[tuple[str, int, str], tuple[int, int]]:
    """(path, text hash or 0, kind) to (times, characters of text) of a page's tokens that aren't outside."""
    found: dict[tuple[str, int, str], list[int]] = {(p, 0, "e"): [n, 0] for p, n in page.elements.items()}
    for b in page.blocks:
        if b.outside:
            continue
        found.setdefault((b.path, key(b.text), "t"), [0, 0])[0] += 1
        found[b.path, key(b.text), "t"][1] += len(b.text)
        at = b.path
        while at:
            if (at, 0, "e") in found:
                found[at, 0, "e"][1] += len(b.text)
            at = at.rpartition("/")[0]
    return {k: (a, b) for k, (a, b) in found.items()}


def _count_tokens(batches):
    """Sums over this task's pages: host, path, text, kind, pages, vector, size."""
    sums: dict[tuple, list[int]] = {}

    def frame():
        rows = [(*k, *v) for k, v in sums.items()]
        sums.clear()
        return pd.DataFrame(rows, columns=["host", "path", "text", "kind", "pages", "vector", "size"])

    for batch in batches:
        for url, html in zip(batch["url"], batch["html"], strict=True):
            host = host_of(url)
            page = Page(html)
            own = key(url or "", html or "")
            at = sums.setdefault((host, "", 0, "p"), [0, 0, 0])
            at[0] += 1
            for token, (times, size) in tokens(page).items():
                at = sums.setdefault((host, *token), [0, 0, 0])
                at[0] += 1
                at[1] += key(str(own), str(times)) >> 31
                at[2] += size
            if len(sums) > 200_000:
                yield frame()
    if sums:
        yield frame()


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Rows (host, pages, tokens): the tokens of each host that may be of a valid class, as an array of structs.

    A class is given by its vector (pages, sum of hashes).  Every token is in ``least_share`` of the host's pages, so a host
    has at most as many as a page has tokens on average, over that share.
    """
    raw = pages.select("url", "html").mapInPandas(_count_tokens, "host string, path string, text long, kind string, pages long, vector long, size long")
    summed = cut(raw.groupBy("host", "path", "text", "kind").agg(F.sum("pages").alias("pages"), F.sum("vector").alias("vector"), F.sum("size").alias("size")).where(F.col("pages") >= min_pages))
    hosts = summed.where("kind = 'p'").select("host", F.col("pages").alias("all"))
    often = summed.where("kind <> 'p'").join(hosts, "host").where(F.col("pages") >= F.col("all") * least_share)
    return often.groupBy("host").agg(F.first("all").alias("pages"), F.collect_list(F.struct("path", "text", "kind", "pages", "vector", "size")).alias("tokens"))


def _above(path: str):
    """The paths of the elements around, nearest first."""
    while path := path.rpartition("/")[0]:
        yield path


class Template:
    """The valid classes of one host: their texts, the boxes among them, and how much each element has left over."""

    def __init__(self, pages: int, found):
        classes: dict[tuple[int, int], list] = defaultdict(list)
        for t in found:
            classes[t["pages"], t["vector"]].append(t)
        of = {t["path"]: c for c, members in classes.items() for t in members if t["kind"] == "e"}
        size = {t["path"]: t["size"] / t["pages"] for members in classes.values() for t in members if t["kind"] == "e"}
        self.texts: set[tuple[str, int]] = set()
        self.boxed: set[tuple[str, int]] = set()
        self.elements: set[str] = set()
        fixed: dict[str, float] = defaultdict(float)  # characters of template text within a path, on a page that has it
        for c, members in sorted(classes.items(), reverse=True):
            elements = {t["path"] for t in members if t["kind"] == "e"}
            texts = [t for t in members if t["kind"] == "t"]
            # the class around: that of the nearest element of another class, around the outermost member
            top = min((t["path"] if t["kind"] == "e" else f"{t['path']}/" for t in members), key=lambda x: (x.count("/"), x))
            around = next((a for a in _above(top) if a in of and of[a] != c), "")
            covers = c[0] >= COVER * (of[around][0] if around else pages)
            boxes = {x for x in elements if x.rpartition("/")[2].split(".")[0] in BOXES}
            held = [t for t in texts if t["path"] in boxes or any(a in boxes for a in _above(t["path"]))]
            if not covers:
                texts = texts if len(texts) >= LARGE else held
                # content of copied pages fills its place; a box doesn't
                if not texts or around and sum(t["size"] for t in texts) / c[0] >= MOST * size[around]:
                    continue
                self.boxed |= {(t["path"], t["text"]) for t in held}
            self.elements |= elements
            self.texts |= {(t["path"], t["text"]) for t in texts}
            for t in texts:
                for a in (t["path"], *_above(t["path"])):
                    if a in of:
                        fixed[a] += t["size"] / of[a][0]
        self.free = {x: size[x] - fixed[x] for x in size}
        # a box on nearly all pages that holds nothing of a page's own, and less than the rest of its place
        whole = {x: next((a for a in _above(x) if a in size), "") for x in self.elements if x in size}
        pure = {x for x, a in whole.items() if x.rpartition("/")[2].split(".")[0] in BOXES and a and self.free[x] <= 0.1 * size[x] < 0.1 * MOST * size[a]}
        self.boxed |= {t for t in self.texts if t[0] in pure or any(a in pure for a in _above(t[0]))}
        # whether pages have text of their own at all; a host of copies of one page hasn't
        top = [x for x in size if not any(a in size for a in _above(x))]
        self.fills = sum(self.free[x] for x in top) >= OWN * sum(size[x] for x in top)
        self.below: dict[str, list[str]] = defaultdict(list)
        for path in self.free:
            self.below[next((a for a in _above(path) if a in self.free), "")].append(path)

    def slot(self, page: Page) -> str:
        """The template element of the page that holds most of what is left over, going down from the root."""
        at = ""
        while here := [p for p in self.below[at] if p in page.elements]:
            best = max(here, key=lambda p: (self.free[p], p))
            whole = self.free[at] if at else sum(self.free[p] for p in here)
            # a single paragraph or item is no slot for an article
            if whole <= 0 or self.free[best] < MOST * whole or re.search(r"/(?:p|li|h[1-6]|td|dd|dt)(?:\.[^/]*)?$", best):
                break
            at = best
        return at


def main_text(html: str | None, template: Template | None) -> str:
    page = Page(html)
    named = page.article()
    elements = None if template is None else template.elements
    shown = [b for b in page.blocks if not b.outside and not (b.doubtful and (elements is None or b.doubtful in elements))]
    if named is not None:
        # the page's own name chooses the slot; a text that all articles of a host share is part of them, a box isn't
        own = {id(b) for b in named}
        within = [b for b in shown if id(b) in own]
        kept = within if template is None else [b for b in within if (b.path, key(b.text)) not in template.boxed]
        return " ".join(b.text for b in kept or ([] if template is not None and template.fills else within))
    if template is None:
        return " ".join(b.text for b in shown)
    slot = template.slot(page)
    inside = [b for b in shown if not slot or b.path == slot or b.path.startswith(slot + "/")]
    kept = [b for b in inside if (b.path, key(b.text)) not in template.texts]
    return " ".join(b.text for b in kept or ([] if template.fills else shown))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = SMALL) -> DataFrame:
    """Rows (id, url, text): the main text of every page.

    Null and empty html give an empty text; a null or unreadable url has the host "".  Repeated rows stay; other columns are
    left aside; an empty table gives no rows.  Templates of up to ``most`` bytes in all are sent to every task, more are
    joined by host.  A page is read whole, however long.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = cut(host_templates(rows))
    shape = "id long, url string, text string"

    def frame(batch, template_of):
        texts = [main_text(h, template_of(u, k)) for k, (u, h) in enumerate(zip(batch["url"], batch["html"], strict=True))]
        return pd.DataFrame({"id": batch["id"].astype("Int64"), "url": batch["url"], "text": texts})

    if size_of(found) <= most:
        shipped = rows.sparkSession.sparkContext.broadcast({r["host"]: (r["pages"], [t.asDict() for t in r["tokens"]]) for r in found.collect()})

        def with_all(batches):
            made: dict[str, Template] = {}

            def of(url, _):
                host = host_of(url)
                if host not in shipped.value:
                    return None
                if host not in made:
                    made[host] = Template(*shipped.value[host])
                return made[host]

            for batch in batches:
                yield frame(batch, of)

        return rows.mapInPandas(with_all, shape)

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    joined = rows.withColumn("host", host("url")).join(found.select("host", F.col("pages").alias("n_pages"), "tokens"), "host", "left")

    def with_own(batches):
        made: dict[str, Template] = {}
        for batch in batches:

            def of(url, k, batch=batch):
                own = batch["tokens"].iloc[k]
                if own is None or isinstance(own, float):
                    return None
                name = batch["host"].iloc[k]
                if name not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[name] = Template(int(batch["n_pages"].iloc[k]), [t if isinstance(t, dict) else t.asDict() for t in own])
                return made[name]

            yield frame(batch, of)

    return joined.mapInPandas(with_own, shape)


def op5_htmltext(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


__all__ = ["Page", "Template", "extract_text", "host_templates", "main_text", "op5_htmltext"]
