"""Main-text extraction by composite text density.

Each page becomes a tree of nodes. For every node the characters for each tag of its subtree, adjusted for what of them is
link text, give its density; a node's density sum adds those of its children. The subtree with the largest sum holds the
article; an article element that holds it, or that lies in it and has more than half of its sum, is taken whole. Otherwise
the smallest density on the path from it to the body is the threshold, and every part of the page whose density reaches it
gives its own largest-sum subtree. Scripts and the like don't enter the tree. Elements that seem no part of an article
(menus, forms, notices, adverts, comments: by their names, or by a class, id or role all of whose words say so) are closed
like others, but then left out with all they hold, except those that hold the page's largest article or more than half of
its text outside links. Headings, paragraphs and the like are never marked by an id: it is what links jump to, made of the
heading's own words. Every step takes time in proportion to the page, however deep its elements lie.

Defined results: null, empty and tagless pages (plain text counts as the body's own text); unclosed and stray tags are
closed or dropped as browsers do; a page with no article text gives an empty string; repeated rows come back once each; an
empty table gives no rows; other columns pass through, but for those named text or n_chars, which are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, others, slices

OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
MARK = re.compile(r"[>\"']")
UNENDED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")  # a page cut off within a tag
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>"']|$)""", re.I)

# Element names by what they mean for the text of a page.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "input", "svg", "canvas", "object", "dialog", "menu", "fieldset", "label"}
CONTROLS = {"button", "select", "svg", "canvas", "object", "label"}  # no amount of text makes these an article
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TEXTUAL = {"a", "b", "blockquote", "caption", "dd", "dt", "em", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "i", "p", "pre", "q", "span", "strong", "td", "th"}  # their ids are targets of links
FENCES = {"ul", "ol", "menu", "dl", "table", "article", "section", "div", "body", "html", "blockquote"}
# Words of class, id and role that mark what isn't the article.
MARKS = {
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "discussion", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
TALK = {"comment", "comments", "discussion", "disqus", "replies", "respond"}
PLACES = {"area", "bar", "block", "bottom", "box", "buttons", "container", "item", "items", "links", "list", "main", "page", "section", "site", "slot", "top", "unit", "wrapper"}  # say nothing beside a mark
KEPT = {"html", "head", "body", "main", "article"}


def words_of(tag: str, attributes: str, in_article: bool) -> str:
    """"talk", "words" or "hidden" if a whole class token, id or role says that an element is no part of an article, else ""."""
    said = ""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "id" and tag in TEXTUAL:
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true":
            said = said or "hidden"
        for token in value.split():
            words = {w for w in re.split(r"[^a-z]+", token) if w} - PLACES
            if words & TALK and words <= MARKS:
                return "talk"
            if words and words <= MARKS | ({"header"} if not in_article else set()):
                said = "words"
    return said


def mark_of(tag: str, attributes: str, in_article: bool) -> str:
    """What says that an element and all in it is no part of an article: "name" or what ``words_of`` gives; "" if nothing."""
    if tag in KEPT:
        return ""
    if tag in DROPPED or tag == "header" and not in_article:
        return "name"
    return words_of(tag, attributes, in_article) if attributes else ""


def tags(source: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """Start, end, name, attributes of all tags, and whether one closes; comments and declarations have no name. The caller may
    send a place to go on from.

    A tag ends at the first > outside quotes. Once a quote or a tag with quotes doesn't end in the page, quotes count for nothing
    from there on; so whatever is scanned is passed, but for one scan to the page's end."""
    last, at, quotes = source.rfind(">"), 0, True
    while (m := OPEN.search(source, at)) is not None:
        start, name = m.start(), m[2]
        if m[0] == "<!--":
            end = source.find("-->", m.end())
            end = len(source) if end < 0 else end + 3
        elif start > last:
            return
        else:
            end, place = 0, m.end()
            while name and quotes and not end:
                mark = MARK.search(source, place)
                if mark and mark[0] == ">":
                    end = mark.end()
                elif mark and (closing := source.find(mark[0], mark.end())) >= 0:
                    place = closing + 1
                else:
                    quotes = False
            end = end or source.find(">", m.end()) + 1
        sent = yield start, end, (name or "").lower(), source[m.end() : end - 1] if name else "", bool(m[1])
        at = end if sent is None else sent


class Page:
    """The nodes of a page in document order, each with its parent, and the pieces of text with their nodes."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks = ["body"], [-1], [""]
        self.odd: set[int] = set()  # article elements that a mark names, like a reader's comment
        self.pieces: list[tuple[int, str]] = []  # a piece of "" parts two blocks
        self.open, self.inside = [0], 0
        self.depths: dict[str, list[int]] = {}  # of each name, how deep its open elements lie
        self.fences, self.blocks = [0], [0]  # how deep the open fences and blocks lie
        at, scan = 0, tags(source)
        found = next(scan, None)
        while found is not None:
            start, end, name, attributes, closes = found
            self.text(source[at:start])
            at, on = end, None
            if name in RAW and not closes:
                close = re.compile(rf"</{name}\b", re.I).search(source, at)
                on = at = source.find(">", close.end()) + 1 if close and close.end() <= source.rfind(">") else len(source)
            elif closes:
                self.end(name)
            elif name:
                self.start(name, attributes)
            try:
                found = scan.send(on)
            except StopIteration:
                found = None
        self.text(UNENDED.sub("", source[at:]))
        self.leave_out()

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self.open[-1], html.unescape(raw)))

    def push(self, name: str, mark: str) -> None:
        depth = len(self.open)
        self.parents.append(self.open[-1])
        self.tags.append(name)
        self.marks.append(mark)
        self.open.append(len(self.tags) - 1)
        self.depths.setdefault(name, []).append(depth)
        if name in FENCES:
            self.fences.append(depth)
        if name in BLOCKS:
            self.blocks.append(depth)
        self.inside += name == "article"

    def close(self, depth: int) -> None:
        """Closes the element that lies so deep, and all that is open in it."""
        while len(self.open) > depth:
            name = self.tags[self.open.pop()]
            self.depths[name].pop()
            if name in FENCES:
                self.fences.pop()
            if name in BLOCKS:
                self.blocks.pop()
            self.inside -= name == "article"

    def deepest(self, names) -> int:
        """How deep the innermost open element of these names lies; 0 without any."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "head", "body"):
            return
        mark = "" if name in VOID else mark_of(name, attributes, self.inside > 0)
        if name in BLOCKS or name == "br" or mark:
            self.pieces.append((self.open[-1], ""))
        if name in VOID:
            return
        closes = CLOSES.get(name, set())
        depth = self.deepest(closes | {"p"} if name in BLOCKS else closes)
        if depth > self.fences[-1]:
            self.close(depth)
        self.push(name, mark)
        if name == "article" and words_of(name, attributes, True):
            self.odd.add(self.open[-1])

    def end(self, name: str) -> None:
        if name in BLOCKS or name == "br":
            self.pieces.append((self.open[-1], ""))
        depth = self.deepest((name,))
        # an inline end tag doesn't reach beyond the block that it stands in
        if depth and (name in BLOCKS or name in DROPPED or depth > self.blocks[-1]):
            self.close(depth)

    def leave_out(self) -> None:
        """Takes the marked elements out of the tree, without those that hold the largest article or most of the text.

        Text is counted outside links. A menu's or form's amount of text counts only where no article lies outside all
        marked elements, readers' comments only where hardly any text does."""
        n = len(self.tags)
        if not any(self.marks):
            return
        chars, in_link, marked = [0] * n, [False] * n, [False] * n
        for k in range(1, n):
            in_link[k] = self.tags[k] == "a" or in_link[self.parents[k]]
            marked[k] = bool(self.marks[k]) or marked[self.parents[k]]
        for k, piece in self.pieces:
            chars[k] += 0 if in_link[k] else len("".join(piece.split()))
        spare = sum(c for c, m in zip(chars, marked) if not m)
        for k in range(n - 1, 0, -1):
            chars[self.parents[k]] += chars[k]
        articles = [k for k in range(n) if self.tags[k] == "article" and k not in self.odd and chars[k]]
        free = any(not marked[k] for k in articles)
        holders, k = set(), max(articles, key=chars.__getitem__, default=0)
        while k > 0:
            holders.add(k)
            k = self.parents[k]

        def stays(k: int) -> bool:
            mark = self.marks[k]
            if not mark or k in holders:
                return True
            if 2 * chars[k] <= chars[0] or self.tags[k] in CONTROLS:
                return False
            return mark == "words" or not free and (mark != "talk" or 10 * spare < chars[k])

        new, at = [-1] * n, 0
        for k in range(n):
            if k == 0 or new[self.parents[k]] >= 0 and stays(k):
                new[k], at = at, at + 1
        left = [k for k in range(n) if new[k] >= 0]
        self.parents = [new[self.parents[k]] if k else -1 for k in left]
        self.tags, self.marks = [self.tags[k] for k in left], [self.marks[k] for k in left]
        self.pieces = [(new[k], piece) for k, piece in self.pieces if new[k] >= 0]

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density and density sum of every node."""
        n = len(self.tags)
        chars, links, tags, link_tags = [0] * n, [0] * n, [1] * n, [0] * n
        in_link = [False] * n
        for k in range(n):
            in_link[k] = self.tags[k] == "a" or k > 0 and in_link[self.parents[k]]
            link_tags[k] = int(self.tags[k] == "a")
        for k, piece in self.pieces:
            size = len("".join(piece.split()))
            chars[k] += size
            links[k] += size * in_link[k]
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            chars[p] += chars[k]
            links[p] += links[k]
            tags[p] += tags[k]
            link_tags[p] += link_tags[k]
        body = links[0] / max(chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            if chars[k]:
                lc, lt = max(links[k], 1), max(link_tags[k], 1)
                base = math.log(chars[k] / max(chars[k] - links[k], 1) * links[k] + body * chars[k] + math.e)
                density[k] = chars[k] / tags[k] * math.log(max(chars[k] * tags[k] / (lc * lt), 1) + 1) / math.log(base + 1)
            if k:
                sums[self.parents[k]] += density[k]
        for k in range(n):
            sums[k] = max(sums[k], density[k] if not sums[k] else 0.0)
        return density, sums

    def chosen(self) -> list[bool]:
        """Which nodes are in a chosen subtree."""
        n = len(self.tags)
        density, sums = self.densities()
        best = list(range(n))  # of each subtree: the node of the largest sum, the outermost if equal
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            if sums[best[k]] > sums[best[p]]:
                best[p] = best[k]
        top = best[0]
        threshold, k = density[top], top
        while k >= 0:
            threshold = min(threshold, density[k])
            k = self.parents[k]
        whole = self.article_of(top, sums)
        if whole >= 0:
            roots = {whole}
        else:
            roots = {best[k] for k in range(n) if density[k] >= threshold and sums[best[k]] > 0}
        above, k = set(), top
        while k >= 0:
            above.add(k)
            k = self.parents[k]
        inside, under, out = [False] * n, [False] * n, [False] * n
        for k in range(n):
            p = self.parents[k]
            under[k] = k == (whole if whole >= 0 else top) or k > 0 and under[p]
            # a marked element that is still here gives text only if it holds the chosen node or lies in what is chosen
            out[k] = k > 0 and out[p] and not under[k] or bool(self.marks[k]) and k not in above and not under[k]
            inside[k] = (k in roots or k > 0 and inside[p]) and not out[k]
        return inside

    def article_of(self, k: int, sums: list[float]) -> int:
        """The article element that holds node k, or the one in its subtree with most of its density sum; -1 if there is none."""
        up = k
        while up >= 0:
            if self.tags[up] == "article":
                return up
            up = self.parents[up]
        below = [False] * len(self.tags)
        found = -1
        for j in range(k, len(self.tags)):  # nodes are in document order: those of the subtree come first
            below[j] = j == k or below[self.parents[j]]
            if not below[j]:
                break
            if self.tags[j] == "article" and 2 * sums[j] > max(sums[k], 2 * sums[found] if found >= 0 else 0.0):
                found = j
        return found

    def main_text(self) -> str:
        inside = self.chosen()
        blocks: list[list[str]] = [[]]
        for k, piece in self.pieces:
            if piece == "" or not inside[k]:
                blocks.append([])
            if inside[k]:
                blocks[-1].append(piece)
        return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks if b)))


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""
    own = others(pages, html_col, "text", "n_chars")
    (source,) = fresh(pages, "source_html")
    ready = pages.select(*own, F.col(html_col).alias(source))
    out = T.StructType([*ready.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 256):
                texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                cols = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return ready.mapInArrow(run, out)
