"""Main text of web pages by tag-path ratios.

The text blocks of a page are aggregated by their root-to-leaf tag path. A path's text ratio is its characters per
block, its punctuation ratio its punctuation marks per block: body text has long, punctuated blocks on few paths, menus
have many short ones. Both ratios are spread over the blocks in page order, smoothed over neighbours, fused by their
geometric mean and compared with a threshold. The element that holds most of the selected text is the article. Elements that are
something else by name (menus, forms, comments and so on) are left out. Where the page marks no article or main element,
blocks on paths below the threshold go too, but for headings and items of lists and tables between those above it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.substring_dedup import _arrow
from hostweave.llm.tokens import pieces

# Elements of HTML by what they are.
RAW = "script|style|textarea|title|iframe"
SKIPPED = frozenset("svg noscript template object select canvas audio video annotation annotation-xml".split())
FOREIGN = ("svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()) | frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER = frozenset("nav header footer aside form button dialog menu fieldset head".split())
MAIN = frozenset("html body main article".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox adsense banner promo promotion sponsor sponsored sidebar side menu nav navbar "
    "navigation breadcrumb breadcrumbs comment comments commentlist disqus respond replies reply cookie cookies consent notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations footer header masthead widget toolbar "
    "pagination pager skip copyright legal disclaimer tags".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*+>|<[!?/][^>]*+>",
    re.S | re.I,
)
ITEMS = frozenset("li dt dd td th caption figcaption pre blockquote".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW.split("|")}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、]")
THRESHOLD, RADIUS = 0.5, 2


@dataclass
class Element:
    name: str
    label: str
    other: bool
    path: tuple[str, ...]
    parent: Element | None
    is_form: bool = False
    doubt: bool = False  # a section with a telling word in its id only
    score: float = 0.0
    chars: int = 0
    children: list = field(default_factory=list)


@dataclass
class Block:
    element: Element
    text: str


def _is_other(name: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is something else than article text by its name or attributes, whether it may be so by its id,
    and its label in paths. The ids of headings and sections are often made of their title and decide nothing alone."""
    label = name
    other, doubt = name in OTHER, False
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "class" and value:
            label = f"{name}.{value.split()[0].lower()}" if value.split() else name
        if name in MAIN:
            continue
        if key in ("class", "id"):
            words = {w.lower() for v in value.split() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", v)}
            told = bool(words & NAMES)
            if key == "id" and (name == "section" or name in HEADINGS):
                doubt = doubt or (told and name == "section")
            else:
                other = other or told
        elif key == "role":
            other = other or value.lower() in ROLES
        elif key == "hidden":
            other = True
        elif key == "style":
            other = other or "display:none" in value.replace(" ", "").lower()
    return other, doubt, label


def _tokens(page: str) -> Iterator[tuple[re.Match, int, bool]]:
    """(token, end, left out) of the comments, tags and raw texts of a page. An element of SKIPPED with its own end tag inside the
    same parent is one token with all it holds; without one, its start tag alone is left out and what follows is text of the page."""
    limit = page.rfind(">") + 1
    found: list[tuple[re.Match, int, bool]] = []
    until: dict[int, int] = {}  # start of an element of SKIPPED: the token that ends it
    opened: list[tuple[str, int]] = []
    n_open: dict[str, int] = defaultdict(int)

    def pop() -> tuple[str, int]:
        name, i = opened.pop()
        n_open[name] -= 1
        return name, i

    at = 0
    while m := _TOKEN.search(page, at, limit):
        at = m.end()
        name = (m["raw"] or m["name"] or m["name2"] or "").lower()
        is_end = bool(m["end"] or m["end2"])
        complete = not is_end and m[0].endswith("/>") and (name in SKIPPED or name in FOREIGN or any(n_open[f] for f in FOREIGN))
        if m["raw"] and not complete:
            z = _RAW_END[name].search(page, at)
            at = z.end() if z else len(page)
        elif is_end:
            if n_open[name]:
                while True:
                    top, i = pop()
                    if top == name:
                        break
                if name in SKIPPED:
                    until[i] = len(found)
            complete = name in SKIPPED
        elif name and not complete and name not in VOID and not m["raw"]:
            if n_open["svg"] and not n_open["foreignobject"] and (name in CLOSES_P or name in ("p", "li")):
                while pop()[0] != "svg":  # such a tag ends a drawing
                    pass
            if name not in INLINE or name in FOREIGN:
                opened.append((name, len(found)))
                n_open[name] += 1
            complete = name in SKIPPED
        found.append((m, at, complete))
    i = 0
    while i < len(found):
        m, at, complete = found[i]
        if i in until:
            i = until[i]
            at, complete = found[i][1], True
        yield m, at, complete
        i += 1


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, each with the innermost block element around it."""
    root = Element("", "", False, (), None)
    stack, out, run = [root], [], []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            holder = next(e for e in reversed(stack) if e.name not in INLINE)
            out.append(Block(holder if not any(e.other for e in stack) else next(e for e in stack if e.other), text))

    def close(to: int) -> None:
        if any(e.name not in INLINE for e in stack[to:]):
            flush()
        del stack[to:]

    at = 0
    for m, after, left_out in _tokens(page):
        run.append(page[at : m.start()])
        at = after
        if m["raw"] or left_out:
            if (m["raw"] or m["name"] or m["name2"]).lower() in ("textarea", "select"):
                flush()
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            # an end tag closes up to its element, but does not reach out of a block for an inline one
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if name in INLINE and stack[i].name not in INLINE:
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name == "br":
            run.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == "p":
                        close(i)
                        break
                    if stack[i].name not in INLINE:
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in SIBLINGS.get(name, ()):
                    close(i)
                    break
                if stack[i].name in ("ul", "ol", "dl", "table", "select") or stack[i].name in OTHER | MAIN:
                    break
        if name in VOID:
            continue
        other, doubt, label = _is_other(name, m["attributes"] or "")
        inside = stack[-1]
        if name == "header" and any(e.name in ("article", "main") for e in stack):
            other = False  # the heading of the article
        e = Element(name, label, other, (*inside.path, label), inside, name == "form", doubt)
        stack.append(e)
    run.append(page[at:])
    flush()
    return out


def _up(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def _on_article_paths(found: list[tuple[Block, float]], limit: float) -> list[tuple[Block, float]]:
    """The blocks on paths whose mean fused ratio reaches the limit, headings before them, and headings and items between them."""
    by_path: dict[tuple, list[float]] = defaultdict(list)
    for b, f in found:
        by_path[b.element.path].append(f)
    high = {p for p, f in by_path.items() if sum(f) >= limit * len(f)}
    at = [i for i, (b, _) in enumerate(found) if b.element.path in high and b.element.name not in HEADINGS]
    if not at:
        return found
    keep, following = set(at), False
    for i in range(len(found) - 1, -1, -1):
        name = found[i][0].element.name
        if i in keep:
            following = True
        elif name not in HEADINGS:
            following = False
        if at[0] < i < at[-1] and name in HEADINGS | ITEMS or following and name in HEADINGS:
            keep.add(i)
    return [x for i, x in enumerate(found) if i in keep]


def article(page: str | None) -> str:
    """Text of the article, its blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    found = blocks_of(page)
    total = sum(len(b.text) for b in found)
    # a form around most of the page is its frame
    forms: dict[int, int] = defaultdict(int)
    for b in found:
        if b.element.is_form:
            forms[id(b.element)] += len(b.text)
    blocks = [b for b in found if not b.element.other or 2 * forms.get(id(b.element), 0) > total]
    if not blocks:
        return ""
    chars, marks, n = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        p = b.element.path
        chars[p] += len(b.text)
        marks[p] += len(_PUNCTUATION.findall(b.text))
        n[p] += 1
    ratio = np.array([(chars[b.element.path] / n[b.element.path], (marks[b.element.path] + 0.5) / n[b.element.path]) for b in blocks])
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / 1.0) ** 2)
    weight = np.convolve(np.ones(len(blocks)), kernel)[RADIUS:-RADIUS]
    smooth = np.stack([np.convolve(r, kernel)[RADIUS:-RADIUS] / weight for r in ratio.T], axis=1)
    fused = np.sqrt(smooth.prod(1))
    limit = THRESHOLD * float(np.average(fused, weights=[len(b.text) for b in blocks]))
    chosen = fused >= limit
    held: dict[int, int] = defaultdict(int)
    size: dict[int, int] = defaultdict(int)
    for b, c in zip(blocks, chosen, strict=True):
        for e in _up(b.element):
            size[id(e)] += len(b.text)
            held[id(e)] += len(b.text) * bool(c)
    most = held[id(next(e for e in _up(blocks[0].element) if e.parent is None))]
    # the innermost element that still holds nearly all of the selected text
    best, depth = None, -1
    for b in blocks:
        for e in _up(b.element):
            if held[id(e)] >= 0.9 * most and len(e.path) > depth and e.name not in ("p", "li", "td", "span", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"):
                best, depth = e, len(e.path)
    def kept(b: Block) -> bool:
        for e in _up(b.element):
            if e is best:
                return True
            if e.doubt and 2 * held[id(e)] < size[id(e)]:
                return False
        return best is None

    inside = [(b, f) for b, f in zip(blocks, fused.tolist(), strict=True) if kept(b)]
    if not any(e.name in ("article", "main") for e in _up(best)):
        inside = _on_article_paths(inside, limit)
    return "\n".join(b.text for b, _ in inside)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: (id_col, url_col, text). Null, empty and text-free pages give an empty text; a
    page without tags is one block. Repeated rows are extracted one by one; null ids and urls are kept; other columns
    are ignored."""
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    kinds = [base.schema[c].dataType for c in ("_id", "_url")]
    arrow = [_arrow(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "_html"):
            text = [article(h) for h in p.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([p.column("_id").cast(arrow[0]), p.column("_url").cast(arrow[1]), pa.array(text, pa.string())], ["_id", "_url", "text"])

    out = base.mapInArrow(run, f"_id {kinds[0].simpleString()}, _url {kinds[1].simpleString()}, text string")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
