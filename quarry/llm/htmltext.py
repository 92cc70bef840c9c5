"""Main-text extraction by composite text density.

A page becomes a tree. Every node has the characters and tags of its subtree, and those inside links; its density is
characters per tag, adjusted by the link shares. A block's density sum adds the densities of the blocks in it and of its
own text; inline markup belongs to the text that it stands in. The main subtree is the block of greatest density sum, the
outermost of equal ones. The least density on the path from it up to the body is the threshold: blocks beside it of its
own tag, at least that dense and with less than a third of their text in links, belong to it, as do the enclosing article
or main element if most of that one's text is in it and what isn't is not mostly links. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out before and inside it.

Null and empty pages, and pages without text, give the empty text. Markup that ends early is closed at its end; an
unclosed script or style runs to the end of the page. Repeated pages get equal results.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices
from quarry.session import ship

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe svg math canvas object audio video menu dialog noembed noframes datalist option label".split())
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr".split())
#: A start tag closes an open element of the second set, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id that name what is not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|notification|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|footer\w*|masthead|topbar|toolbar|comments?|comment-?list|respond|disqus|replies|reply|related|recommend\w*|share|sharing|social|"
    r"pagination|pager|skip|tags|copyright|disclaimer|alert)(?:$|[\s_-])",
    re.I,
)
#: Of an article element's own class and id; of what is a header outside an article.
OTHER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo|comments?|reply|replies|related|recommend\w*)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"\s+")


#: Words that stand beside those of NAMES in a class or id.
BESIDE = frozenset("area bar block body box buttons container content inner left links list main page post posts right section site slot top wrap wrapper".split())


def _named(words: re.Pattern, names: list[str]) -> bool:
    """A whole class or id is made of the words, at least one, and of BESIDE."""
    for token in " ".join(names).lower().split():
        parts = [x for x in re.split("[-_]+", token) if x]
        hits = [bool(words.search(x)) for x in parts]
        if words.search(token) and any(hits) and all(h or x in BESIDE for h, x in zip(hits, parts, strict=True)):
            return True
    return False


class Node:
    __slots__ = ("tag", "kids", "up", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "soft", "blocky")

    def __init__(self, tag: str, up: Node | None, drop: bool):
        self.tag, self.up, self.drop, self.kids = tag, up, drop, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.soft = self.blocky = False


def _unwanted(tag: str, raw: str, up: Node) -> bool:
    if tag in DROP:
        return True
    if tag == "header":
        return not _within(up, ("article", "main"))
    if not raw or tag in ("body", "html", "main"):
        return False
    if _hidden(raw):
        return True
    attrs = {k.lower(): (a or b or c) for k, a, b, c in _ATTR.findall(raw)}
    names = [attrs.get("class", ""), attrs.get("id", "")]
    if tag == "article":
        return _named(OTHER, names)
    return _named(NAMES, names) or any(map(HEADER.search, names)) and not _within(up, ("article", "main"))


def _hidden(raw: str) -> bool:
    attrs = {k.lower(): (a or b or c) for k, a, b, c in _ATTR.findall(raw)}
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


def _rescue(root: Node) -> None:
    """Named nodes and forms stay where they hold most of the text outside links, and a main heading or article if there is any."""
    nodes = [root]
    for n in nodes:
        nodes += [k for k in n.kids if isinstance(k, Node) and (not k.drop or k.soft)]
    if not any(n.soft for n in nodes):
        return
    held: dict[int, list[int]] = {}
    for n in reversed(nodes):
        mine = [0, int(n.tag in ("h1", "article", "main"))]
        for k in n.kids:
            if isinstance(k, str):
                mine[0] += len(_SPACE.sub(" ", k).strip())
            elif id(k) in held:
                mine = [x + y for x, y in zip(mine, held[id(k)], strict=True)]
        held[id(n)] = mine if n.tag != "a" else [0, mine[1]]
    text, heads = held[id(root)]
    for n in nodes:
        if n.soft and 2 * held[id(n)][0] > text and (held[id(n)][1] or not heads):
            n.drop = False


def _within(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.up
    return False


def parse(page: str) -> Node:
    """The tree; kids are nodes and texts with character references decoded."""
    root = Node("html", None, False)
    here, at = root, 0
    length = len(page)
    while at < length:
        m = _TOKEN.search(page, at)
        if m is None:
            here.kids.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            here.kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            here = _close(here, tag)
            continue
        if tag == "body":
            if here.tag == "head" or _within(here, ("head",)):
                here = _close(here, "head")
            if _within(here, ("body",)):
                continue
        elif here.tag == "head" and tag in BLOCK:
            here = _close(here, "head")
        if tag in ENDS_P:
            here = _end_p(here)
        if tag in CLOSES:
            own, stop = CLOSES[tag]
            n = here
            while n.up is not None and n.tag not in stop:
                if n.tag in own:
                    here = n.up
                n = n.up
        node = Node(tag, here, _unwanted(tag, m[3], here))
        node.soft = node.drop and (tag == "form" or tag not in DROP and not _hidden(m[3]))
        here.kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.kids.append(html.unescape(page[at : end.start() if end else length]))
            at = end.end() if end else length
        elif not m[3].rstrip().endswith("/") or tag in BLOCK:
            here = node
    return root


def _close(here: Node, tag: str) -> Node:
    n = here
    while n.up is not None:
        if n.tag == tag:
            return n.up
        if tag not in BLOCK and n.tag in BLOCK:  # an inline end tag closes nothing outside its block
            return here
        n = n.up
    return here


def _end_p(here: Node) -> Node:
    n = here
    while n.up is not None and n.tag not in ("button", "td", "th", "div", "article", "section", "body", "li", "blockquote", "main"):
        if n.tag == "p":
            return n.up
        n = n.up
    return here


def _ordered(root: Node) -> list[Node]:
    """Wanted nodes, each after its parent."""
    out = [root]
    for n in out:
        out += [k for k in n.kids if isinstance(k, Node) and not k.drop]
    return out


def densest(root: Node) -> tuple[Node, Node]:
    """The body, and the block of greatest density sum."""
    _rescue(root)
    nodes = _ordered(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if body is not root:
        nodes = _ordered(body)
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(_SPACE.sub(" ", k).strip())
            elif not k.drop:
                n.chars, n.tags = n.chars + k.chars, n.tags + k.tags + 1
                n.link_chars, n.link_tags = n.link_chars + k.link_chars, n.link_tags + k.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
    share = body.link_chars / body.chars if body.chars else 0
    for n in reversed(nodes):
        kids = [k for k in n.kids if isinstance(k, Node) and not k.drop]
        n.blocky = n.tag in BLOCK or any(k.blocky for k in kids)
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        # The text of a block itself, with its inline markup, counts as a child.
        run = [k for k in kids if not k.blocky]
        own = sum(len(_SPACE.sub(" ", k).strip()) for k in n.kids if isinstance(k, str)) + sum(k.chars for k in run)
        n.total = sum(k.density for k in kids if k.blocky) + _density(own, sum(k.tags + 1 for k in run), sum(k.link_chars for k in run), sum(k.link_tags for k in run), share)
    return body, max((n for n in nodes if n.blocky or n is body), key=lambda n: n.total)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, less the denser the links are; share is the share of links in the whole page's text."""
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags)) + math.e - 1, max(base, 1.0001))


def main_nodes(root: Node) -> list[Node]:
    """The main subtree, or the main subtrees side by side, in page order."""
    body, best = densest(root)
    path = [best]
    while path[-1] is not body and path[-1].up is not None:
        path.append(path[-1].up)
    for n in path[1:]:
        if n.tag in ("article", "main") and 2 * best.chars > n.chars and 2 * (n.link_chars - best.link_chars) <= n.chars - best.chars:
            best = n
    threshold = min(n.density for n in path)
    if best is body or best.up is None:
        return [best]
    return [k for k in best.up.kids if k is best or isinstance(k, Node) and not k.drop and k.tag == best.tag and k.density >= threshold and 3 * k.link_chars < k.chars]


def text_of(top: Node) -> str:
    """The subtree's blocks in page order, one a line, white space inside a block as one space."""
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        line = _SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if line:
            blocks.append(line)

    todo: list[tuple[Node, int]] = [(top, 0)]
    while todo:
        node, k = todo.pop()
        if k == 0 and node.tag in BLOCK:
            end()
        for i in range(k, len(node.kids)):
            kid = node.kids[i]
            if isinstance(kid, str):
                now.append(kid)
            elif kid.tag == "br":
                now.append(" ")
            elif not kid.drop:
                todo += [(node, i + 1), (kid, 0)]
                break
        else:
            if node.tag in BLOCK:
                end()
    end()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    return "\n".join(t for n in main_nodes(parse(page)) if (t := text_of(n))) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
