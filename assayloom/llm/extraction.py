"""Main text of web pages by composite text density.

A page becomes a list of nodes in page order. Boilerplate that says what it is goes first: by tag, role, or words of class and id. Of what is left
every node gets a density, its characters per tag, adjusted by the share of links; the node whose children have the largest sum of densities
is the main subtree. The smallest density between it and the body is the threshold: other subtrees that reach it are main text
too, each at its own node of the largest sum.

A page is worked on by itself, in time linear in its length; Spark deals the pages.
"""

from __future__ import annotations

import html as references
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assayloom.llm.common import quoted

# fixed values: HTML's own sets of elements
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub "
                    "sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                      "hgroup hr main menu nav ol p pre section summary table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# what is never main text: elements, roles, and words of class and id
_DROP_TAGS = frozenset("head nav aside footer form dialog menu template svg canvas object embed audio video button select input fieldset map".split()) | _RAW
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note status".split())
_DROP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget widgets related recommended recommendations "
    "share sharing social ad ads adv advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form comments comment respond replies disqus "
    "pagination pager toolbar skip copyright disclaimer".split())
_HAVING = frozenset("has with no without is".split())           # "with-sidebar" is not the sidebar
_OWN_HEADER = frozenset("article entry post content story page-content".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*>""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[-_:]+")


def _says_boilerplate(name: str) -> bool:
    """Whether one class name or id names a part of the page that is not its article."""
    parts = [p for p in _PARTS.split(_CAMEL.sub("-", name).lower()) if p]
    if not parts or parts[0] in _HAVING:
        return False
    if parts[-1] == "header" and parts[0] in _OWN_HEADER:
        return False
    return parts[0] in _DROP_WORDS or parts[-1] in _DROP_WORDS


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROP_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), references.unescape(value.strip("\"'"))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in _DROP_ROLES:
            return True
        if name in ("class", "id") and any(_says_boilerplate(v) for v in value.split()):
            return True
    return False


class Page:
    """Nodes in page order: tag, parent, dropped; and texts with the node they stand in. Node 0 is the body."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop = ["body"], [-1], [False]
        self.pieces: list[tuple[int, str]] = []         # node and text, or node and None where a block begins or ends
        self._stack, self._open, self._articles = [0], {"body": 1}, 0
        at, end, last = 0, len(source), source.rfind(">")
        while at < end:
            token = _TOKEN.search(source, at) if at <= last else None       # without an end no mark begins
            begin = token.start() if token else end
            if begin > at:
                self._text(references.unescape(source[at:begin]) if "&" in source[at:begin] else source[at:begin])
            if not token:
                break
            at, mark = token.end(), token.group()
            if mark.startswith("<![CDATA["):
                self._text(mark[9:].removesuffix("]]>"))
                continue
            name = _NAME.match(mark)
            if not name:
                continue
            tag = name.group(1).lower()
            if mark[1] == "/":
                self._close(tag)
                continue
            node = self._start(tag, mark[name.end():-1])
            if tag in _RAW and node is not None:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = stop.end() if stop else end        # its text is no text of the page
                self._pop_to(tag)

    def _text(self, text: str) -> None:
        if not self.drop[self._stack[-1]]:
            self.pieces.append((self._stack[-1], text))

    def _edge(self, node: int) -> None:
        if self.tag[node] not in _INLINE:
            self.pieces.append((node, None))

    def _pop(self) -> None:
        node = self._stack.pop()
        self._open[self.tag[node]] -= 1
        self._articles -= self.tag[node] == "article"
        self._edge(node)

    def _pop_to(self, tag: str) -> None:
        while self.tag[self._stack[-1]] != tag:
            self._pop()
        self._pop()

    def _start(self, tag: str, attributes: str) -> int | None:
        if tag in ("html", "body"):
            return None
        if tag in _CLOSES_P and self._open.get("p"):
            self._pop_to("p")
        for other in _SIBLINGS.get(tag, ()):
            if self._open.get(other) and self._nearer(other, _SCOPE.get(tag, ("table",))):
                self._pop_to(other)
        top = self._stack[-1]
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(top)
        self.drop.append(self.drop[top] or _dropped(tag, attributes, self._articles > 0))
        if tag in _VOID:
            self.pieces.append((node, " " if tag == "br" else None if tag == "hr" else ""))
            return node
        self._edge(node)
        self._stack.append(node)
        self._open[tag] = self._open.get(tag, 0) + 1
        self._articles += tag == "article"
        return node

    def _nearer(self, tag: str, limits: tuple[str, ...]) -> bool:
        """Whether the innermost open ``tag`` is inside the innermost of ``limits``."""
        for node in reversed(self._stack):
            if self.tag[node] == tag:
                return True
            if self.tag[node] in limits:
                return False
        return False

    def _close(self, tag: str) -> None:
        if tag in ("html", "body") or not self._open.get(tag):
            return
        if tag in _INLINE:      # an inline end tag closes no block
            for node in reversed(self._stack):
                if self.tag[node] == tag:
                    break
                if self.tag[node] not in _INLINE:
                    return
        self._pop_to(tag)


def _densities(page: Page) -> tuple[list[float], list[float], bool]:
    """Composite density of every node, the sum of its children's, and whether there is text outside links."""
    n = len(page.tag)
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for k in range(1, n):
        inside[k] = inside[page.parent[k]] or page.tag[k] == "a"
    for node, text in page.pieces:
        if text and not page.drop[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if inside[node]:
                linked[node] += size
    for k in range(n - 1, 0, -1):       # children come after their parent
        if page.drop[k]:
            continue
        up = page.parent[k]
        chars[up] += chars[k]
        linked[up] += linked[k]
        tags[up] += tags[k] + 1
        links[up] += links[k] + (page.tag[k] == "a")
    share = linked[0] / max(chars[0], 1)
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n):
        c, lc, t, lt = chars[k], linked[k], max(tags[k], 1), max(links[k], 1)
        if c and not page.drop[k]:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[k] = c / t * math.log(c / max(lc, 1) * t / lt) / max(math.log(base), 0.05)
        if k:
            sums[page.parent[k]] += density[k]
    return density, sums, chars[0] > linked[0]


def _marked(page: Page) -> list[bool]:
    """Nodes whose texts are main text."""
    n = len(page.tag)
    density, sums, any_text = _densities(page)
    live = [k for k in range(n) if not page.drop[k]]
    if not any(density):        # a letter or two, or nothing but links
        return [any_text and not d for d in page.drop]
    top = max(live, key=lambda k: (sums[k], -k)) if any(s > 0 for s in sums) else 0
    threshold, at = density[top], top
    while at >= 0:
        threshold = min(threshold, density[at])
        at = page.parent[at]

    # best sum below every node, itself included; the earliest node on ties
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        if not page.drop[k] and (sums[best[k]], -best[k]) > (sums[best[up]], -best[up]):
            best[up] = best[k]
    chosen, looked = [False] * n, [False] * n
    looked[0] = True
    for k in range(n):
        if page.drop[k] or (k and not looked[page.parent[k]]):
            continue
        if density[k] >= threshold and density[k] > 0:
            chosen[best[k] if sums[best[k]] > 0 else k] = True
        looked[k] = True

    # an article is taken whole, and so is what stands between it and the main subtree
    at = top
    while at > 0:
        if page.tag[at] in ("article", "main"):
            chosen[at] = True
        at = page.parent[at]
    chosen[top] = True
    # headings that lead to the main subtree
    path, at = {0}, top
    while at >= 0:
        path.add(at)
        at = page.parent[at]
    for k in range(1, top):
        if page.tag[k] in _HEADINGS and page.parent[k] in path and not page.drop[k]:
            chosen[k] = True
    for k in range(1, n):
        chosen[k] = (chosen[k] or chosen[page.parent[k]]) and not page.drop[k]
    return chosen


def main_text(source: str | None) -> str:
    """Main text of one page: blocks in page order, joined by an empty line; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    chosen = _marked(page)
    blocks, run = [], []
    for node, text in page.pieces:
        if text is None:
            blocks.append("".join(run))
            run = []
        elif chosen[node] or (page.tag[node] == "br" and run):
            run.append(text)
    blocks.append("".join(run))
    return "\n\n".join(b for b in (" ".join(block.split()) for block in blocks) if b)


def text_of(source: Column) -> Column:
    """``main_text`` as a column."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return run(source)


def extract(pages: DataFrame, keep: list[str] = ["page_id", "url"], html: str = "html") -> DataFrame:  # noqa: B006
    """Columns ``keep``, the main text of every row, and its number of code points.

    Null and empty pages, pages without text outside boilerplate, and pages of nothing but links have an empty text. Rows that repeat stay
    rows of their own; null ids and urls are kept; an empty table gives an empty result. White space, also that of character references,
    becomes one space inside a block. Broken markup is read as browsers do in the main: unclosed paragraphs, list items and cells end
    where the next begins, unknown end tags count for nothing. Kept columns named text or n_chars are not allowed, others may be.
    """
    clash = {"text", "n_chars"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"kept columns would be named twice: {sorted(clash)}")
    out = pages.select(*[quoted(c) for c in keep], text_of(quoted(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
