"""HTML main text by tag-path ratios.

A page is cut into blocks, each with the path of tags from the root to it. For each path the
lengths of its blocks' text, their punctuation, and the text in links are summed. The ratio of
text to blocks, weighted by punctuation and by the share that isn't link text, is the path's
score; scores are smoothed over neighbouring blocks by the similarity of their paths (the geometric
mean with the path's own, so that a menu beside an article gains little) and fused with what the
path's tags and class names say. Paths that reach half the mean score of the page's characters, and
aren't mostly links, are content. The text is that of all blocks on content paths, of the content
elements that hold such a path, whole but for boilerplate, of short flow blocks (headings, list
items, paragraphs) beside content, and of the headings right before it.

The work is in proportion to a page's length (times a logarithm, where paths are compared): tags are
read once, open elements are found by their tag, and paths are nodes of a tree and not lists.

Edge cases: null and empty pages give an empty text, an empty table none. Broken markup is read as
far as it goes: end tags that open nothing are ignored, unclosed elements end with their parent, a
paragraph ends where a block begins; a tag whose quotes don't close ends at its first ">", and
where no ">" follows all is text. A very long page is read whole, in one task. Repeated rows are
pages of their own, equal scores count alike. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags and name parts.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object select".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog head input option optgroup fieldset legend".split())
CONTENT = frozenset("article main".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar widget widgets"
    " related recommended share sharing social comment comments reply replies respond disqus breadcrumb breadcrumbs menu nav navbar navigation footer header masthead newsletter"
    " subscribe subscription login signup signin pagination pager toolbar outbrain taboola alert skip print tags".split()
)
#: Inside an article these hold its title.
HEADS = frozenset(("header", "masthead"))
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
GOOD_NAMES = frozenset("article articlebody content entry main post story body".split())
#: A new block of the first kind ends an open one of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Short blocks of these are kept beside content; the lists are seen through.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("p li dt dd pre blockquote figcaption".split())
LISTS = frozenset("ul ol dl li blockquote figure".split())
SCOPES = frozenset("ul ol dl table article main section div body html blockquote".split())

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*+))")
#: The rest of a tag up to its ">", which quotes may hide; no part is tried twice.
_REST = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Blocks on each side that smooth a score, and the width of the window.
REACH, WIDTH = 3, 1.5
#: What a content name multiplies a score by, the share of the mean score that makes a path content,
#: and the share of text in links that unmakes it.
GOOD, LEAST, LINKS = 2.0, 0.5, 0.5


class Path:
    """A node of the tree of tag paths, with a jump towards the root that finds common parts in logarithmic time."""

    __slots__ = ("label", "up", "jump", "depth", "below")

    def __init__(self, label: str, up: "Path | None"):
        self.label, self.up, self.below = label, up, {}
        self.depth = up.depth + 1 if up else 1
        far = up is not None and up.depth - up.jump.depth == up.jump.depth - up.jump.jump.depth
        self.jump = self if up is None else up.jump.jump if far else up

    def child(self, label: str) -> "Path":
        if label not in self.below:
            self.below[label] = Path(label, self)
        return self.below[label]

    def labels(self) -> tuple[str, ...]:
        """From below the root on."""
        out, p = [], self
        while p.up is not None:
            out.append(p.label)
            p = p.up
        return tuple(reversed(out))

    def above(self, depth: int) -> "Path":
        """The part of the path down to a depth."""
        p = self
        while p.depth > depth:
            p = p.jump if p.jump.depth >= depth else p.up
        return p


class Element:
    __slots__ = ("tag", "path", "bad", "good", "up", "outer", "container")

    def __init__(self, tag: str, attributes: str, up: "Element | None"):
        self.tag, self.up = tag, up
        names, bad = [], tag in BOILERPLATE
        inside = up is not None and up.good
        if tag == "header" and not inside:
            bad = True
        good = tag in CONTENT
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
                if name == "role":
                    bad |= value in BAD_ROLES
                    good |= value in ("main", "article")
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                    bad = True
                elif name in ("class", "id", "itemprop"):
                    # has-sidebar and the like tell what else there is
                    parts = {x for token in value.split() if not token.startswith(("has-", "no-", "with-")) for x in re.split(r"[^a-z]+", token)}
                    bad |= bool(parts & (BAD_NAMES - HEADS if inside else BAD_NAMES)) and tag not in ("html", "body", "main")
                    good |= bool(parts & GOOD_NAMES)
                    names.append(value)
        self.bad = bad or up is not None and up.bad
        self.good = (good or inside) and not self.bad
        self.path = up.path.child(".".join([tag, *sorted(names)])) if up else Path(tag, None)
        # the outermost content element about it, and what a block of flow in it lies in: lists are seen through
        self.outer = up.outer if up is not None and up.outer is not None else self if self.good else None
        self.container = self if up is None else up.container if up.tag in LISTS and up.up is not None else up


class Block:
    __slots__ = ("element", "text", "linked", "path")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked, self.path = element, text, linked, element.path


@cache
def _shut(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b", re.I)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in page order."""
    top = Element("#root", "", None)
    out: list[Block] = []
    pieces: list[str] = []
    links, linked, at, end = 0, 0, 0, len(page)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(top, text, linked))
            pieces.clear()
        linked = 0

    # open elements of each tag, the innermost last
    opened: dict[str, list[Element]] = defaultdict(list)

    def innermost(tags) -> int:
        return max((opened[t][-1].path.depth for t in tags if opened.get(t)), default=0)

    def close(tags, scopes=()):
        nonlocal top
        depth = innermost(tags)
        if depth and depth > innermost(scopes):
            while top.path.depth >= depth:
                opened[top.tag].pop()
                top = top.up

    while at < end:
        m = _OPEN.search(page, at)
        stop, after, rest, tag = (m.start() if m else end), end, "", ""
        if m:
            tag = (m[2] or "").lower()
            if tag:
                body = _REST.match(page, m.end())
                # quotes that don't close would hide all that follows
                after = body.end() if page.startswith(">", body.end()) else page.find(">", m.end())
                rest = page[m.end() : after]
            elif page.startswith("<!--", stop):
                after = page.find("-->", m.end())
                after = end - 1 if after < 0 else after + 2
            else:
                after = page.find(">", m.end())
            if after < 0:  # no tag ends from here on
                m, stop, tag = None, end, ""
            after += 1
        if stop > at:
            text = html.unescape(page[at:stop])
            pieces.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = after
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = 0
            elif tag not in INLINE and tag not in VOID:
                flush()
                close((tag,), SCOPES if tag == "p" or tag == "li" else frozenset())
            continue
        if tag in RAW:
            flush()
            shut = _shut(tag).search(page, at)
            at = page.find(">", shut.end()) + 1 if shut else 0
            at = at or end
            continue
        if tag == "br":
            pieces.append(" ")
        if tag == "a":
            links = 1
        if tag in INLINE:
            continue
        flush()
        links = 0
        close(("p",), SCOPES)
        if tag in ENDS:
            close(ENDS[tag], SCOPES)
        if tag not in VOID:
            top = Element(tag, rest, top)
            opened[tag].append(top)
    flush()
    return out


def _alike(a: Path, b: Path) -> float:
    """The share of two paths that they have in common from the root."""
    both = a.depth + b.depth
    least = min(a.depth, b.depth)
    a, b = a.above(least), b.above(least)
    while a is not b:
        a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.up, b.up)
    return 2 * a.depth / both


def scores(found: list[Block]) -> list[float]:
    """The smoothed and fused score of each block."""
    total: dict[Path, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in found:
        t = total[b.path]
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(_PUNCTUATION.findall(b.text))
        t[3] += min(b.linked, len(b.text))
    ratio = {p: n_text / n * (1 + log1p(marks / n)) * (1 - n_link / n_text) for p, (n, n_text, marks, n_link) in total.items()}
    kernel = [exp(-(d * d) / (2 * WIDTH * WIDTH)) for d in range(REACH + 1)]
    out = []
    for k, b in enumerate(found):
        value = weight = 0.0
        for j in range(max(0, k - REACH), min(len(found), k + REACH + 1)):
            w = kernel[abs(k - j)] * _alike(b.path, found[j].path) ** 3
            value, weight = value + w * ratio[found[j].path], weight + w
        out.append(0.0 if b.element.bad else (ratio[b.path] * value / weight) ** 0.5 * (GOOD if b.element.good else 1.0))
    return out


def main_text(page: str | None) -> str:
    """The page's main text: blocks joined by line breaks."""
    found = blocks(page or "")
    value = scores(found)
    sizes = [len(b.text) for b in found]
    plain = [v / GOOD if b.element.good else v for b, v in zip(found, value)]
    live = sum(n for n, v in zip(sizes, plain) if v > 0)
    if not live:
        return ""
    least = LEAST * sum(n * v for n, v in zip(sizes, plain)) / live
    # by path: blocks, their scores, text, link text; by content element: text, link text, content
    paths: dict[Path, list[float]] = defaultdict(lambda: [0, 0.0, 0, 0])
    for b, n, v in zip(found, sizes, value):
        t = paths[b.path]
        t[0], t[1], t[2], t[3] = t[0] + 1, t[1] + v, t[2] + n, t[3] + min(b.linked, n)
    content = {p for p, (n, v, text, links) in paths.items() if v > 0 and v / n >= least and links < LINKS * text}
    whole: dict[Element, list] = defaultdict(lambda: [0, 0, False])
    owner = [None if b.element.bad else b.element.outer for b in found]
    for b, n, e in zip(found, sizes, owner):
        if e is not None:
            t = whole[e]
            t[0], t[1], t[2] = t[0] + n, t[1] + min(b.linked, n), t[2] or b.path in content
    keep, prose = [], [not b.element.bad and b.linked < LINKS * n for b, n in zip(found, sizes)]
    for b, e, ok in zip(found, owner, prose):
        keep.append(whole[e][2] and whole[e][1] < LINKS * whole[e][0] if e is not None else ok and b.path in content)
    beside = {b.element.container for b, k in zip(found, keep) if k}
    for k, b in enumerate(found):
        if not keep[k] and owner[k] is None and prose[k] and b.element.tag in FLOW:
            keep[k] = b.element.container in beside
    for k in range(len(found) - 2, -1, -1):
        if keep[k + 1] and prose[k] and found[k].element.tag in HEADINGS:
            keep[k] = True
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch(
            {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())}
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each input row: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
