"""Main text of HTML pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A classifier gives each block the log-odds of being content,
a sum over independent features with fixed weights: the elements around it (an article against a menu, footer,
form ...), the tokens of their class, id and role, its length, its sentences, and its share of link text. The
odds are the capacities of its edges to the two terminals of a flow network. Smoothness edges join blocks that follow each
other, stronger the fewer elements lie between them, and each block to the nearest earlier blocks of the same
parent and of the same section. The minimum cut, found by augmenting paths, labels the page: what stays with
the source is content.

A token is judged whole, by its head: ``main-menu`` and ``ad-box`` name boilerplate, ``has-sidebar``, ``ad-free``,
``overflow-hidden`` and ``tags-news`` don't. Boilerplate is what stands beside an article, however long it is. So a
token counts unless nothing outside such elements is an article or clean prose while the element itself holds an
article or prose: then it wraps the page. A form counts unless it wraps an article. Comments always count.

Scripts, styles, templates and form controls hold no text of a reader and make no blocks. White space inside a block becomes
one space, inline tags and line breaks with it; blocks are joined in page order by two line feeds.

Edge cases: null, empty and tag-only html give the empty text; unclosed, stray and misnested tags are taken
as they come, an end tag closes up to its own element if that is open; a page of any length and nesting is read
whole, in time in proportion to its tags; repeated rows and ties are read row by row; further columns are not
read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from helixplan.llm.common import slices

# Element names of HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template svg math canvas iframe object audio video select textarea button head datalist noframes applet map".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - frozenset("li dd dt td th tr tbody thead tfoot caption option optgroup body html head title legend summary".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# Log-odds of content (positive) or boilerplate, by element.
ELEMENT = {"article": 6.0, "main": 4.0, "nav": -14.0, "menu": -14.0, "footer": -14.0, "aside": -14.0, "form": -14.0, "fieldset": -8.0, "dialog": -14.0, "search": -14.0, "h1": 2.0, "h2": 1.0, "h3": 1.0, "p": 2.0, "blockquote": 1.0, "pre": 1.0, "figcaption": 0.5, "title": -14.0, "label": -4.0, "legend": -4.0}
HEADER_IN_PAGE = -14.0
# Parts of tokens of class, id and role.
GOOD = frozenset("article content post entry story main body text".split())
BAD = frozenset("ad ads adv advert adverts advertisement adbox adsense banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer dialog footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation navlinks newsletter notice notices alert alerts outbrain overlay pager pagination paywall popup promo promoted promotion related recommended rss search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar warning widget widgets complementary contentinfo".split())
TALK = frozenset("comment comments commentlist discussion discussions disqus replies respond responses reviews".split())
#: A token with one of these says something about an element's state or surroundings, not what it is.
STATE = frozenset("no has have with without not is are show hide hides show shows free overflow visually aria js layout page single template enabled disabled open closed active sticky category tagged tag type format status".split())
#: What may follow the name of a kind of boilerplate: a box for it.
BOX = frozenset("area bar block body bottom box col column container content group holder inline inner item items left link links list outer panel right row section slot title top unit wrap wrapper zone".split())
TOKEN_BAD, TOKEN_GOOD = -14.0, 1.5
LINK, LONG, SHORT, BASE, SENTENCE = -6.0, 3.0, -0.5, -0.5, 0.5
NEXT, SAME_PARENT, SAME_SECTION = 1.5, 1.0, 0.5
#: Blocks of prose in an element without an article that make it the page's text.
LEAST_PROSE = 2

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S)
NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCES = re.compile(r"[.!?:](?:\s|$)")
SPACE = re.compile(r"\s+")


class _Element:
    """An open element, with what holds for everything in it: ``total`` log-odds, the place of its nearest block element, the outermost condemned element, whether it is in an article."""

    __slots__ = ("article", "block", "condemned", "name", "number", "section", "silent", "total")

    def __init__(self, name: str, number: int, section: int, silent: bool, total: float, block: int, condemned: int, article: bool):
        self.name, self.number, self.section, self.silent, self.total, self.block, self.condemned, self.article = name, number, section, silent, total, block, condemned, article


def token_kind(token: str) -> str:
    """``bad``, ``talk``, ``good`` or nothing, for one token of class, id or role."""
    parts = [x.lower() for x in PART.findall(token)]
    whole = "".join(parts)
    for kind, names in (("talk", TALK), ("bad", BAD)):
        # A known name, or one with a box for it written on: adslot, footerlinks.
        if whole in names or any(whole[:k] in names and whole[k:] in BOX for k in range(2, len(whole))):
            return kind
    if not parts or STATE & set(parts):
        return ""
    for kind, names in (("talk", TALK), ("bad", BAD)):
        # Its head is its last part; a box for something is that thing.
        if parts[-1] in names or parts[0] in names and all(x in BOX or x in names for x in parts[1:]):
            # The header of an article belongs to it.
            return "good" if parts[-1] == "header" and GOOD & set(parts) else kind
    return "good" if GOOD & set(parts) else ""


def _evidence(name: str, attributes: str, in_article: bool) -> tuple[float, float]:
    """Log-odds of an element, and how much of it a token of boilerplate or its being a form gave, which the rest of the page may overrule."""
    worth, overruled = ELEMENT.get(name, 0.0), 0.0
    if name == "header" and not in_article:
        worth = HEADER_IN_PAGE
    if attributes and name not in ("html", "body"):
        if HIDDEN.search(attributes):
            worth -= 14.0
        kinds = {token_kind(t) for m in NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()}
        if "talk" in kinds:
            worth += TOKEN_BAD
        elif "bad" in kinds:
            worth += TOKEN_BAD
            overruled = TOKEN_BAD
        elif "good" in kinds:
            worth += TOKEN_GOOD
    if name == "form":
        overruled += ELEMENT["form"]
    return worth, overruled


class Block:
    __slots__ = ("article", "condemned", "depth", "evidence", "linked", "parent", "section", "text")

    def __init__(self, text: str, linked: int, parent: int, section: int, depth: int, evidence: float, condemned: int, article: bool):
        self.text, self.linked, self.parent, self.section, self.depth, self.evidence, self.condemned, self.article = text, linked, parent, section, depth, evidence, condemned, article


def _is_prose(block: Block, more: float = 0.0) -> bool:
    """Content by itself, with ``more`` log-odds: in an article or main element, or with a sentence."""
    return _worth(block) + more > 0 and (block.article or SENTENCES.search(block.text) is not None)


def _acquit(blocks: list[Block], weight: dict[int, float], wraps: set[int]) -> list[Block]:
    """Takes back what condemns elements that wrap the page; ``wraps`` are forms around an article."""

    def free(number: int) -> None:
        for b in blocks:
            if b.condemned == number:
                b.evidence, b.condemned = b.evidence - weight[number], 0

    for number in wraps:
        free(number)
    if weight and not any(_is_prose(b) for b in blocks if not b.condemned):
        held: dict[int, list[Block]] = {}
        for b in blocks:
            if b.condemned and _is_prose(b, -weight[b.condemned]):
                held.setdefault(b.condemned, []).append(b)
        for number, some in held.items():
            if len(some) >= LEAST_PROSE or any(b.article for b in some):
                free(number)
    return blocks


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    stack = [_Element("", 0, 0, False, 0.0, 0, 0, False)]
    open_at: dict[str, list[int]] = {}
    weight: dict[int, float] = {}
    forms: set[int] = set()
    wraps: set[int] = set()
    made, out, parts, linked, links, silent = 0, [], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                top = stack[-1]
                holder = stack[top.block]
                above = stack[stack[top.block - 1].block].number if top.block else 0
                out.append(Block(text, linked, above, holder.section, len(stack), max(-60.0, top.total), top.condemned, top.article))
        linked = 0

    def close(k: int) -> None:
        """Closes the elements from place ``k`` on."""
        nonlocal links, silent
        while len(stack) > k:
            e = stack.pop()
            open_at[e.name].pop()
            links -= e.name == "a"
            silent -= e.silent

    def last(names: tuple[str, ...]) -> int:
        """Place of the innermost open element of these, or 0."""
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        start = m.start() if m else n
        if start > at and not silent:
            text = html.unescape(page[at:start])
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA[") and not silent:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                parts.append(" ")
                continue
            if k := last((name,)):
                if stack[-1].block >= k:
                    flush()
                close(k)
            elif name in BLOCK:
                flush()
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in BLOCK:
            if name in CLOSES_P and stack[stack[-1].block].name == "p":
                # An open paragraph ends; inline elements that it left open end with it.
                flush()
                close(stack[-1].block)
            if name in SIBLING:
                k = last(SIBLING[name])
                if k > last(SCOPE[name]):
                    flush()
                    close(k)
            flush()
            if name == "body":
                # What a head left open ends here.
                while len(stack) > 1 and stack[-1].name != "html":
                    close(len(stack) - 1)
        attributes = m[3] or ""
        if attributes.rstrip().endswith("/") and name in ("svg", "iframe", "script"):
            continue
        made += 1
        quiet = name in SILENT
        worth, overruled = _evidence(name, attributes, bool(last(("article", "main"))))
        top = stack[-1]
        section = made if name in BLOCK and (name in ("article", "section", "main", "nav", "aside", "footer", "header", "form", "ul", "ol", "table") or worth <= -8) else top.section
        condemned = top.condemned
        if overruled and not condemned:
            condemned, weight[made] = made, overruled
        article = name in ("article", "main")
        if name == "form" and condemned == made and overruled == ELEMENT["form"]:
            forms.add(made)
        if article and condemned in forms:
            wraps.add(condemned)
        stack.append(_Element(name, made, section, quiet, top.total + worth, len(stack) if name in BLOCK else top.block, condemned, article or top.article))
        open_at.setdefault(name, []).append(len(stack) - 1)
        links += name == "a"
        silent += quiet
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            if not silent:
                parts.append(html.unescape(page[at:stop]))
            at = stop
    flush()
    return _acquit(out, weight, wraps)


def _worth(block: Block) -> float:
    """The classifier's log-odds."""
    n = len(block.text)
    return BASE + block.evidence + LONG * min(n / 200, 1.0) + (SHORT if n < 25 else 0.0) + LINK * min(block.linked / n, 1.0) + (SENTENCE if SENTENCES.search(block.text) else 0.0)


def costs(block: Block) -> tuple[float, float]:
    """Capacities from the source (what calling it boilerplate costs) and to the sink."""
    worth = _worth(block)
    return (worth, 0.0) if worth > 0 else (0.0, -worth)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page and in the tree."""
    edges: list[tuple[int, int, float]] = []
    last_parent: dict[int, int] = {}
    last_section: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            apart = (a.parent != b.parent) + 2 * (a.section != b.section) + abs(a.depth - b.depth) / 4
            edges.append((i - 1, i, NEXT / (1 + apart)))
        for near, key, weight in ((last_parent, b.parent, SAME_PARENT), (last_section, b.section, SAME_SECTION)):
            if key in near:
                edges.append((near[key], i, weight))
            near[key] = i
    return edges


def source_side(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut (the smallest such side), by shortest augmenting paths."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, ab: float, ba: float) -> None:
        near[a].append(len(to))
        to.append(b)
        room.append(ab)
        near[b].append(len(to))
        to.append(a)
        room.append(ba)

    for i in range(n):
        if source[i] > 0:
            join(s, i, source[i], 0.0)
        if sink[i] > 0:
            join(i, t, sink[i], 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in near[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            edges_of, p = near[a], place[a]
            while p < len(edges_of) and not (room[edges_of[p]] > tiny and level[to[edges_of[p]]] == level[a] + 1):
                p += 1
            place[a] = p
            if p < len(edges_of):
                path.append(edges_of[p])
                a = to[edges_of[p]]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None) -> str:
    """The article of one page."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    pairs = [costs(b) for b in blocks]
    keep = source_side([p[0] for p in pairs], [p[1] for p in pairs], smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page; a map over the rows."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__html"):
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.selectExpr(f"`{id_col}`", f"`{url_col}`", f"`{html_col}` as __html").mapInArrow(run, f"{kinds}, text string, n_chars bigint")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
