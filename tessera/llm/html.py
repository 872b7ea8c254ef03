"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each under the path of open tags from the root. For every path
the blocks' characters, punctuation and link characters are added up; a path's ratio is its
characters per block. Ratios are smoothed over the blocks in page order, fused with punctuation and
the share of text outside links, and averaged per path; paths of at least THRESHOLD times the best
are content, and the container that holds most of their text is the content's own. Everything in
an article or main container is content; in another one the paths that aren't mostly links are.
Elements that are never content by their tag or by the words of their class, id or role have no
blocks. Paths are nodes of a tree of tags, so a page costs time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textvec import slices

THRESHOLD = 0.12

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
# a quote opens a value only after an equals sign; any other quote is a character
_TAG = re.compile(_OTHER + r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)""", re.S)
#: what tags are from a tag on whose values never close
_TAG_WITHOUT_VALUES = re.compile(_OTHER + r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_MARKS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: elements whose content is not markup
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "noscript", "template", "object", "audio", "video", "map", "label", "fieldset", "datalist"}
_BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: an open element of the first kind ends where one of the others begins
_ENDS = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: where the search for such an element stops
_WALLS = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "body", "blockquote"}
#: words of class, id and role that mark what is not the article
_NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner masthead navbar nav navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer header topbar toolbar pagination pager comment comments respond reply replies disqus discussion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget skip search contentinfo complementary".split()
)
#: of these, words that mark nothing at the end of a compound (market-share)
_WEAK_ENDS = {"share", "search", "skip", "alert"}
#: elements that hold text themselves: their marks count only as whole names
_TEXTUAL = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "summary", "caption", "span", "a", "b", "i", "em", "strong", "u", "s", "small", "mark", "code", "q", "cite", "abbr", "time", "sub", "sup", "font", "ins", "del"}
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")


def _marks_noise(name: str, tag: str, inside: bool) -> bool:
    """Whether one name in a class, id or role marks what is not content."""
    words = re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if not words or inside and {"header"} <= set(words) <= {"header", "article", "post", "entry"}:
        return False
    if tag in _TEXTUAL:
        return len(words) == 1 and words[0] in _NOISE
    return words[0] in _NOISE or words[-1] in _NOISE - _WEAK_ENDS


def _noisy(attributes: str, tag: str, inside: bool) -> bool:
    """Whether an element is hidden, or its class, id or role names what is not content."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    if tag in ("body", "html"):
        return False
    return any(_marks_noise(name, tag, inside) for m in _MARKS.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split())


class Paths:
    """Tag paths as nodes of a tree: the root is 0, and a node's parent has a smaller number."""

    def __init__(self) -> None:
        self.parent, self.tag, self._child = [0], [""], {}

    def down(self, node: int, tag: str) -> int:
        if (node, tag) not in self._child:
            self._child[node, tag] = len(self.parent)
            self.parent.append(node)
            self.tag.append(tag)
        return self._child[node, tag]

    def below(self, top: int) -> list[bool]:
        """For each node, whether it is `top` or under it."""
        out = [top == 0]
        for node in range(1, len(self.parent)):
            out.append(node == top or out[self.parent[node]])
        return out

    def container(self, node: int) -> int:
        """The last element on the way to a node that holds blocks."""
        while node and (self.tag[node] not in _BLOCK or self.tag[node] in _HEADING or self.tag[node] in ("p", "pre", "li", "td", "th", "dd", "dt", "figcaption", "summary")):
            node = self.parent[node]
        return node

    def outermost(self, node: int, tags: tuple[str, ...]) -> int | None:
        """The first element of such a tag on the way from the root to a node."""
        found = None
        while node:
            found, node = (node if self.tag[node] in tags else found), self.parent[node]
        return found


#: open elements that the beginning of an element of a tag may end
_ENDED_BY = {tag: [o for o, ends in _ENDS.items() if tag in ends] for tag in _BLOCK | {"option"}}


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The paths, and (path, text, characters inside links) of each block outside noise, in page order."""
    out: list[tuple[int, str, int]] = []
    paths = Paths()
    stack: list[tuple[str, int]] = []  # open elements and their paths
    is_open: dict[str, int] = {}
    noise = 0  # depth at which noise began, 1 at least
    text: list[str] = []
    linked = path = 0
    begun = False

    def flush() -> None:
        nonlocal linked, begun
        if begun:
            joined = " ".join("".join(text).split())
            out.append((path, joined, min(linked, len(joined))))
        text.clear()
        linked, begun = 0, False

    def say(raw: str) -> None:
        nonlocal linked, path, begun
        if raw and not noise:
            s = html.unescape(raw) if "&" in raw else raw
            if not begun and s.strip():
                path, begun = stack[-1][1] if stack else 0, True
            text.append(s)
            if is_open.get("a"):
                linked += len(s.strip())

    def close(depth: int) -> None:
        """Pop the stack down to so many elements."""
        nonlocal noise
        while len(stack) > depth:
            tag, _ = stack.pop()
            is_open[tag] -= 1
            if tag in _BLOCK:
                flush()
            if noise > len(stack):
                noise = 0

    def depth_of(tags: list[str] | tuple[str, ...], walls: bool) -> int | None:
        """Where the innermost open element of these tags is, no further out than a wall if asked."""
        if any(is_open.get(x) for x in tags):
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in tags:
                    return d
                if walls and stack[d][0] in _WALLS:
                    break
        return None

    tags, at, last = _TAG, 0, max(page.rfind(">"), page.rfind("<!--"), page.rfind("<![CDATA["))
    while at <= last and (m := tags.search(page, at)):
        if m[2] is not None and m[0][-1] != ">":
            tags = _TAG_WITHOUT_VALUES
            continue
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if (d := depth_of((tag,), walls=False)) is not None:
                close(d)
            elif tag == "p":
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCK:
            if (d := depth_of(_ENDED_BY[tag], walls=True)) is not None:
                close(d)
            flush()
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        in_article = bool(is_open.get("article"))
        stack.append((tag, paths.down(stack[-1][1] if stack else 0, tag)))
        is_open[tag] = is_open.get(tag, 0) + 1
        if not noise and (tag in _NEVER or tag == "header" and not in_article and not is_open.get("main") or _noisy(attributes, tag, in_article)):
            if tag in _BLOCK:
                flush()
            noise = len(stack)
    say(page[at:])
    close(0)
    flush()
    return paths, out


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The page's content blocks, joined by line feeds; empty if there are none."""
    paths, found = blocks(page or "")
    if not found:
        return ""
    total: dict[int, list[float]] = {}
    for path, text, linked in found:
        t = total.setdefault(path, [0.0, 0.0, 0.0, 0.0])
        t[0] += len(text)
        t[1] += len(_PUNCTUATION.findall(text))
        t[2] += linked
        t[3] += 1
    along = [total[p][0] / total[p][3] for p, _, _ in found]
    smooth = [(2 * x + along[max(i - 1, 0)] + along[min(i + 1, len(along) - 1)]) / 4 for i, x in enumerate(along)]
    score: dict[int, float] = {}
    for (path, _, _), s in zip(found, smooth, strict=True):
        score[path] = score.get(path, 0.0) + s
    for path, t in total.items():
        score[path] = score[path] / t[3] * (1 + t[1] / t[3]) * max(0.0, 1 - t[2] / t[0]) ** 2
    best = max(score.values())
    if best <= 0:
        return ""
    chosen = {p for p, s in score.items() if s >= threshold * best}
    weight: dict[int, float] = {}
    for p in chosen:
        home = paths.container(p)
        weight[home] = weight.get(home, 0.0) + total[p][0]
    home = max(weight, key=lambda c: (weight[c], -c))
    article = paths.outermost(home, ("article", "main"))
    inside = paths.below(home if article is None else article)
    if article is not None:
        return "\n".join(text for path, text, _ in found if inside[path])
    chosen.update(p for p, t in total.items() if inside[p] and t[2] < 0.5 * t[0])
    return "\n".join(text for path, text, _ in found if path in chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row for each row of pages (page_id, url, html).

    Null and empty pages, and pages without content, have an empty text. Rows that repeat a page_id
    are read each for itself. Other columns are not read.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
