"""HTML extraction: a tolerant parser, subtree hashes counted per host, removal of what recurs, the main text of the rest."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import cut, if_small, rebalanced, small_batches, tidy

# Fixed values of HTML: elements without content, with raw content, that are blocks, and that end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption head html legend option select tbody td tfoot th thead tr".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never are part of an article's text, and roles and words of class or id that mark such elements.
DROPPED = frozenset("nav aside footer form script style title head noscript template iframe noembed noframes object svg canvas select button input textarea datalist dialog menu search audio video map".split())
#: Elements whose content is not text on a page.
NOT_TEXT = frozenset("script style title head noscript template iframe noembed noframes object svg canvas audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note status".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal "
    "overlay newsletter subscribe subscription signup login sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
    "comment comments disqus respond reply replies discussion share sharing social related recommended recommendations widget widgets toolbar pagination pager skip paywall".split()
)
COMMENTS = frozenset("comment comments disqus respond replies discussion".split())
#: A subtree goes if it stands in so many different surroundings on a host, and in that share of the number of the host's different pages.
LEAST_PAGES, LEAST_SHARE = 4, 0.3
#: Elements that hold an article's content itself. What surrounds them is told by a minimum hash, so that the paragraphs that near copies of an article share are none that recur.
CONTENT = HEADINGS | frozenset("p li dd dt td th tr tbody thead table blockquote pre figure figcaption".split())
#: Elements that are no subtree of a page but the page.
FRAME = frozenset(["#page", "html", "body", "head", "article", "main"])
#: Templates of all hosts together that may be broadcast.
TEMPLATES = 200_000

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?|[\"'])*+)(?P<end>>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s/=\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Page:
    """Elements in page order: tags, attributes, parents, and contents (indices of elements, or texts)."""

    def __init__(self, source: str | None):
        self.tags, self.attrs, self.parents, self.contents = ["#page"], [""], [-1], [[]]
        self._parse(source or "")

    def _parse(self, source: str) -> None:
        tags, attrs, parents, contents = self.tags, self.attrs, self.parents, self.contents
        stack: list[int] = [0]
        opened: dict[str, list[int]] = {}  # the places of open elements in the stack, by tag
        at, size = 0, len(source)

        def pop() -> None:
            opened[tags[stack.pop()]].pop()

        def text(own: str) -> None:
            if own:
                contents[stack[-1]].append(html.unescape(own) if "&" in own else own)

        while at < size:
            found = TOKEN.search(source, at)
            if found is None:
                text(source[at:])
                break
            text(source[at : found.start()])
            at = found.end()
            if found["cdata"]:
                contents[stack[-1]].append(found["cdata"])
            if (tag := found["tag"]) is None or not found["end"]:
                continue
            tag = tag.lower()
            if found["close"]:
                if opened.get(tag):
                    while tags[stack[-1]] != tag:
                        pop()
                    pop()
                elif tag in ("p", "br"):
                    self._add("br" if tag == "br" else "p", "", stack[-1])
                continue
            if tag in ENDS_P and opened.get("p"):
                self._close(stack, opened, pop, {"p"}, {"td", "th", "button", "table", "caption", "object"})
            if tag in SIBLINGS:
                self._close(stack, opened, pop, *SIBLINGS[tag])
            elif tag in HEADINGS and tags[stack[-1]] in HEADINGS:
                pop()
            node = self._add(tag, found["attrs"].strip(), stack[-1])
            if tag in VOID or found["attrs"].endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(source, at)
                if tag in ("title", "textarea") and end.start() > at:
                    contents[node].append(html.unescape(source[at : end.start()]))
                close = source.find(">", end.start())
                at = close + 1 if close >= 0 else size
                continue
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def _add(self, tag: str, attrs: str, parent: int) -> int:
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(parent)
        self.contents.append([])
        self.contents[parent].append(len(self.tags) - 1)
        return len(self.tags) - 1

    @staticmethod
    def _close(stack: list[int], opened: dict[str, list[int]], pop, ended: set[str], within: set[str]) -> None:
        """Closes the outermost open element of ``ended`` that is not beyond one of ``within``."""
        last = max((own[-1] for tag in within if (own := opened.get(tag))), default=0)
        deep = min((own[k] for tag in ended if (own := opened.get(tag)) and (k := bisect_right(own, last)) < len(own)), default=len(stack))
        while len(stack) > deep:
            pop()

    def digests(self) -> list[int]:
        """Of each element a hash over tag, attributes, texts without surplus white space, and the elements within."""
        out = [0] * len(self.tags)
        self.filled = [False] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            h = xxhash.xxh64(f"{self.tags[i]}\0{self.attrs[i]}\0")
            for own in self.contents[i]:
                if isinstance(own, int):
                    h.update(out[own].to_bytes(8, "little", signed=True))
                    self.filled[i] |= self.filled[own]
                elif words := own.split():
                    h.update(" ".join(words))
                    self.filled[i] = True
            out[i] = h.intdigest() - (1 << 63)
        return out

    def shapes(self, article: list[bool]) -> dict[int, int]:
        """Of each element with text outside the articles of a page that has one a hash over tag, class, id, role, and the elements within.

        Texts and other attributes do not count, and of equal neighbours within an element one
        does: a menu has one shape whatever and however many its entries are.
        """
        if not article[0]:
            return {}
        inside = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            inside[i] = inside[self.parents[i]] or self.tags[i] in ("article", "main")
        out: dict[int, int] = {}
        for i in range(len(self.tags) - 1, 0, -1):
            if inside[i] or article[i] or self.tags[i] in FRAME or not self.filled[i]:
                continue
            own = self.attributes(i)
            h = xxhash.xxh64("\0".join((self.tags[i], *(own.get(name, "") for name in ("class", "id", "role")))), 1)
            before = None
            for x in self.contents[i]:
                if isinstance(x, int) and x in out and out[x] != before:
                    before = out[x]
                    h.update(before.to_bytes(8, "little", signed=True))
            out[i] = h.intdigest() - (1 << 63)
        return out

    def surroundings(self, digests: list[int], article: list[bool]) -> list[tuple[int, int]]:
        """(digest, surroundings) of each subtree with text that may be a template, once each; and of the shapes of subtrees outside articles.

        The surroundings are the digest of the element around it, for a shape that of the page,
        for content a minimum hash over the other contents of the element around it: copies of
        an article that share most of it have few of these, different articles have many.
        """
        found = {(shape, digests[0]) for shape in self.shapes(article).values()}
        for i, own in enumerate(self.contents):
            full = [x for x in own if (self.filled[x] if isinstance(x, int) else not x.isspace())]
            values = [((digests[x] if isinstance(x, int) else xxhash.xxh64_intdigest(x)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63) for x in full]
            least = sorted(values)[:2]
            for x, value in zip(full, values):
                if not isinstance(x, int) or article[x] or self.tags[x] in FRAME or self.tags[x] not in BLOCK:
                    continue
                others = least[1:] if value == least[0] else least[:1]
                found.add((digests[x], (others or [0])[0] if self.tags[x] in CONTENT else digests[i]))
        return list(found)

    def holders(self) -> tuple[list[bool], list[bool]]:
        """Whether an element has an article or main element in it, and whether it has a first heading."""
        article, heading = [False] * len(self.tags), [False] * len(self.tags)
        for i in range(len(self.tags) - 1, 0, -1):
            article[self.parents[i]] |= article[i] or self.tags[i] in ("article", "main")
            heading[self.parents[i]] |= heading[i] or self.tags[i] == "h1"
        return article, heading

    def attributes(self, i: int) -> dict[str, str]:
        return {m[1].lower(): html.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in ATTR.finditer(self.attrs[i])} if self.attrs[i] else {}

    def unwanted(self, i: int, article: bool, heading: bool) -> bool:
        """Whether the element is a menu, header, footer, sidebar, notice, advert, form, comments or not text at all.

        ``article``: it is around an article element, and within none; ``heading``: it holds a first heading.
        """
        tag = self.tags[i]
        if tag in ("html", "body", "#page", "article", "main"):
            own = self.attributes(i)
            return tag == "article" and bool(MARKS & _words(own)) and not heading
        if tag in DROPPED:
            return not article or tag in ("script", "style", "head", "title", "template")
        own = self.attributes(i)
        if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
            return not article
        if tag == "header" or own.get("role", "").lower() in ROLES or MARKS & _words(own):
            return not (heading or article and not COMMENTS & _words(own))
        return False

    def text(self, templates: frozenset[int] = frozenset(), digests: list[int] | None = None, rules: bool = True) -> str:
        """The blocks of the main text, joined by line breaks.

        Templates go first. Of what is left go the elements that ``unwanted`` names, and the
        article elements, or else the main element, are the text. Without ``rules`` all of
        the page that is text and no template stays.
        """
        article, heading = self.holders()
        shapes = self.shapes(article) if templates else {}
        n = len(self.tags)
        gone, inside = [False] * n, [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parents[i]] or self.tags[self.parents[i]] == "article"
            gone[i] = gone[self.parents[i]] or bool(templates) and not article[i] and (digests[i] in templates or shapes.get(i) in templates)
            if not gone[i]:
                gone[i] = self.unwanted(i, article[i] and not inside[i], heading[i]) if rules else self.tags[i] in NOT_TEXT
        roots = rules and (self._roots("article", gone) or self._roots("main", gone)) or [0]
        blocks: list[str] = []
        own: list[str] = []

        def close() -> None:
            if words := "".join(own).split():
                blocks.append(" ".join(words))
            own.clear()

        for root in roots:
            todo: list = [root]
            while todo:
                x = todo.pop()
                if x is None:
                    close()
                elif isinstance(x, str):
                    own.append(x)
                elif not gone[x]:
                    if self.tags[x] == "br":
                        own.append(" ")
                    elif self.tags[x] in BLOCK:
                        close()
                        todo.append(None)
                    todo.extend(reversed(self.contents[x]))
            close()
        return "\n".join(blocks)

    def _roots(self, tag: str, gone: list[bool]) -> list[int]:
        """The outermost elements of the tag that stay and hold text."""
        out, within = [], [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            within[i] = within[self.parents[i]]
            if self.tags[i] == tag and not within[i] and not gone[i]:
                within[i] = True
                out.append(i)
        holds = [False] * len(self.tags)
        for i in range(len(self.tags) - 1, 0, -1):
            holds[i] = not gone[i] and (holds[i] or any(isinstance(x, str) and not x.isspace() for x in self.contents[i]))
            holds[self.parents[i]] |= holds[i]
        return [i for i in out if holds[i]]


def _words(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for name in ("class", "id") if name in attributes for w in WORDS.findall(attributes[name])}


def host(url: str | None) -> str:
    """The url's host in lower case; empty if it has none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def host_key(url: str | None) -> int:
    """The host as a 64-bit number."""
    return xxhash.xxh64_intdigest(host(url)) - (1 << 63)


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(host, digest, around)``: the subtrees of pages that may be templates, once a page; digest 0 stands for a page itself."""
    for b in batches:
        found: set[tuple[int, int, int]] = set()
        for url, source in zip(b["url"], b["html"]):
            page, site = Page(source), host_key(url)
            digests = page.digests()
            found.update((site, d, around) for d, around in page.surroundings(digests, page.holders()[0]))
            found.add((site, 0, digests[0]))
        yield pd.DataFrame(np.array(list(found), np.int64).reshape(-1, 3), columns=["host", "digest", "around"])


def templates(df: DataFrame, url_col: str = "url", html_col: str = "html", least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """``(host, digest)`` of the subtrees that recur on a host (``host_key``).

    Counted are the different surroundings of a subtree, so copies of a page or of an
    article count once; and the different pages with a shape outside their articles. At least ``least`` of them, and ``share`` of the number of the host's
    different pages, make a template. Counts are aggregated by (host, digest, surroundings)
    before they move.
    """
    rows = df.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(tidy(_subtrees), "host long, digest long, around long")
    counts = cut(rows.distinct().groupBy("host", "digest").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.col("digest") == 0)))
    pages = counts.where("digest = 0").select("host", F.col("n").alias("pages"))
    return counts.where("digest != 0").join(if_small(cut(rebalanced(pages))), "host").where(F.col("n") >= share * F.col("pages")).select("host", "digest")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: bool = True) -> DataFrame:
    """``(id_col, url, text, n_chars)``, a row for each page: the main text without what belongs to the site.

    Subtrees that recur on many pages of the page's host go first (``templates``), whatever
    their element: those with the same content, and outside article elements those with the
    same shape, such as menus whose entries differ. Then go those that tags, roles or class words mark as menu, header, footer,
    sidebar, notice, advert, form or comments, as hosts with few pages have no templates and
    some of these differ from page to page. What is left of the article elements, or else of
    the main element, or else of the page, is the text: character references decoded, white
    space within a block one space, blocks joined by one line break. ``rules=False`` leaves
    it at the templates. Null html counts as empty and gives an empty text, a null or odd
    url belongs to host ''. Null and repeated ids are rows like any other; other columns are
    not read; an empty table gives an empty result.

    Templates of a host are few, since each stands on a share of its pages; they come to the
    pages by a broadcast if they are few in total, else by a join that can split a hot host.
    """
    small_batches(df.sparkSession)
    kind, url_kind = df.schema[id_col].dataType, df.schema[url_col].dataType
    found = cut(rebalanced(templates(df, url_col, html_col)))
    by_host = found.groupBy("host").agg(F.collect_list("digest").alias("templates"))
    by_host = F.broadcast(by_host) if found.limit(TEMPLATES + 1).count() <= TEMPLATES else cut(rebalanced(by_host))
    rows = df.select(F.col(id_col).cast("string").alias("__id"), F.col(url_col).cast("string").alias("__url"), F.col(html_col).alias("__html"))

    @F.pandas_udf("long")
    def key(urls: pd.Series) -> pd.Series:
        return pd.Series([host_key(u) for u in urls], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, frozenset[int]] = {}
        for b in batches:
            texts = []
            for source, own in zip(b["__html"], b["templates"]):
                page = Page(source)
                found = frozenset()
                if own is not None and len(own):
                    mark = np.asarray(own, np.int64).tobytes()
                    if mark not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[mark] = frozenset(np.asarray(own, np.int64).tolist())
                    found = known[mark]
                texts.append(page.text(found, page.digests() if found else None, rules))
            yield pd.DataFrame({"__id": b["__id"], "__url": b["__url"], "text": texts, "n_chars": [len(t) for t in texts]})

    placed = rows.withColumn("host", key("__url")).join(by_host, "host", "left").select("__id", "__url", "__html", "templates")
    out = placed.mapInPandas(tidy(run), "__id string, __url string, text string, n_chars long")
    return out.select(F.col("__id").cast(kind).alias(id_col), F.col("__url").cast(url_kind).alias(url_col), "text", "n_chars")
