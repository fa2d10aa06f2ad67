"""Operator 7, main text of web pages by composite text density.

A page is parsed leniently into a tree. For every node the link-adjusted characters per tag (composite text density) are
computed from the characters and tags below it and those within links; each node's children's densities are summed, and
the node of the largest sum is the core of the article. The least density on the path from the body to the core is the
threshold: what stands beside that path joins the core, part by part, where its density reaches it. A heading before the
path joins too (of those right below the body only an h1), and below an article or main every part that is not mostly links. The parts are returned in page order.

Kind, class, id and role are evidence that an element holds no article text: it is left out, of the densities too, unless
it holds the page itself (see ``_outside``). A class counts when all its words are words of boilerplate or of layout, so
that ``site-footer`` does and ``no-sidebar`` or ``search-results`` do not.

Edge cases: null or empty html, or a page without text outside boilerplate, gives the empty text; tags that are not
closed end with their parent; a slash before ``>`` does not close an element; very long and deeply nested pages are read
whole; repeated rows are extracted each; a null id passes through; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.support import table, worker_cache

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
#: Elements whose content is never article text.
_NEVER = frozenset("button select option label svg canvas object audio video head map".split()) | _RAW
#: Elements that are not the article unless they hold it as an article or main, and those that can also be a page's wrapper.
_PART = frozenset("nav footer aside menu".split())
_WRAP = frozenset("form fieldset dialog".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag of the first kind ends an open element of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div body html main".split())
#: Words that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation navigationbar menu menus menubar "
    "breadcrumb breadcrumbs sidebar sidebars complementary contentinfo footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond newsletter subscribe subscription signup login related recommended share sharing social toolbar search pagination pager".split()
)
#: Of these, marks of what may be longer than the article beside it.
_TALK = frozenset(
    "ad ads advert adverts advertisement advertising adsense cookie cookies consent gdpr comment comments commentlist disqus reply replies respond newsletter subscribe subscription signup login share sharing social".split()
)
#: Words of layout that may stand beside a mark, and those that may stand beside one of talk.
_FILL = frozenset(
    "area articles bar block bottom box button buttons container first fixed form global holder icon icons inner item items last left link links list main message news outer page panel posts primary "
    "right secondary section site slot small sticky stories top toggle unit widget widgets wrap wrapper".split()
)
_FILL_TALK = _FILL | frozenset("article blog entry post reader readers story user users".split())
_HEADINGS = frozenset("h1 h2 h3".split())


class Page:
    """Nodes of a page as parallel lists, parents before children, and its text runs in order as (node, text, block number)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.why = ["#page"], [-1], [""]
        self.runs: list[tuple[int, str, int]] = []
        self.between: set[int] = set()
        open_nodes, block, at = [0], 0, 0
        opened: Counter[str] = Counter()  # open elements by name
        size = len(source)

        def close(depth: int) -> None:
            opened.subtract(self.tag[n] for n in open_nodes[depth:])
            del open_nodes[depth:]

        def close_kind(kinds: set[str]) -> None:
            """End the innermost open element of the kinds that is not beyond an enclosing list, table or section."""
            if any(opened[k] for k in kinds):
                for depth in range(len(open_nodes) - 1, 0, -1):
                    tag = self.tag[open_nodes[depth]]
                    if tag in kinds:
                        return close(depth)
                    if tag in _SCOPE:
                        return None

        while at < size:
            found = _TOKEN.search(source, at)
            stop = found.start() if found else size
            if stop > at:
                self.runs.append((open_nodes[-1], source[at:stop], block))
            if not found:
                break
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
            if name in _BLOCK:
                block += 1
            if closing:
                if opened[name]:
                    close(next(d for d in range(len(open_nodes) - 1, 0, -1) if self.tag[open_nodes[d]] == name))
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if name in _BLOCK and name != "br":
                close_kind({"p"})
            if name in _ENDS:
                close_kind(_ENDS[name])
            self.tag.append(name)
            self.parent.append(open_nodes[-1])
            self.why.append(self._why(name, attributes, opened["article"] + opened["main"] > 0))
            if name not in _VOID:
                open_nodes.append(len(self.tag) - 1)
                opened[name] += 1
        self.out = self._outside()

    def _why(self, name: str, attributes: str, within: bool) -> str:
        """Why an element looks like boilerplate: never, part, wrap or talk; empty if it does not."""
        if name in _NEVER:
            return "never"
        if name in _PART:
            return "part"
        if name == "header" and within:
            return ""  # an article's own header holds its title
        kind = "wrap" if name in _WRAP or name == "header" else ""
        if attributes and name not in ("html", "body", "main"):
            for value in _NAMES.finditer(attributes):
                for token in (value[1] or value[2] or value[3] or "").split():
                    words = {w.lower() for w in _WORD.findall(token)}
                    if words & _TALK and words <= _MARKS | _FILL_TALK:
                        return "talk"
                    if words & _MARKS and words <= _MARKS | _FILL:
                        kind = "wrap"
        return kind

    def _outside(self) -> list[bool]:
        """Which nodes are boilerplate: what looks like it, with all below, unless it holds the page itself.

        That is: it holds main, or the page's longest article; or, with no article anywhere, more than half of the text
        outside links. Comments, notices and the like must hold a first heading for that. If nothing would be left,
        the longest of what was taken out is put back.
        """
        n, why, parent = len(self.tag), self.why, self.parent
        never, under, linked = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            p = parent[k]
            never[k] = never[p] or why[k] == "never"
            under[k] = under[p] or why[k] != ""
            linked[k] = linked[p] or self.tag[k] == "a"
        every = [0] * n  # characters below a node; without those of links; of these what does not look like boilerplate
        prose, clean = [0] * n, [0] * n
        for node, text, _ in self.runs:
            if not never[node]:
                length = sum(map(len, text.split()))
                every[node] += length
                prose[node] += 0 if linked[node] else length
                clean[node] += 0 if linked[node] or under[node] else length
        main, title = [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            p = parent[k]
            every[p] += every[k]
            prose[p] += prose[k]
            clean[p] += clean[k]
            main[p] = main[p] or main[k] or self.tag[k] == "main" and prose[k] > 0
            title[p] = title[p] or title[k] or self.tag[k] == "h1"
        talk, best = [False] * n, [0] * n
        for k in range(1, n):
            talk[k] = talk[parent[k]] or why[k] == "talk" and not title[k]
        for k in range(n - 1, 0, -1):
            if self.tag[k] in ("article", "main") and not talk[k]:
                best[k] = max(best[k], prose[k])
            best[parent[k]] = max(best[parent[k]], best[k])

        def holds_page(k: int) -> bool:
            if why[k] == "never":
                return False
            if main[k]:
                return True
            if best[k] and best[k] == best[0] and (title[k] or 2 * best[k] > clean[0]):
                return True
            wraps = why[k] == "wrap" or why[k] == "talk" and title[k]
            return wraps and 2 * prose[k] > prose[0] and (not best[0] or title[k])

        kept = {k for k in range(1, n) if why[k] and holds_page(k)}
        while True:
            out = [False] * n
            for k in range(1, n):
                out[k] = out[parent[k]] or why[k] != "" and k not in kept
            if not every[0] or any(not out[node] and not text.isspace() for node, text, _ in self.runs):
                return out
            back = [k for k in range(1, n) if out[k] and not out[parent[k]] and why[k] in ("wrap", "talk") and every[k]]
            if not back:
                return out
            kept.add(max(back, key=lambda k: (prose[k], every[k])))

    def densities(self) -> tuple[list[float], list[float]]:
        """(composite text density, sum of the children's densities) of every node; 0 for what is out."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            linked[k] = linked[self.parent[k]] or self.tag[k] == "a"
        for node, text, _ in self.runs:
            if not self.out[node]:
                length = len(text) - text.count(" ")
                chars[node] += length
                link_chars[node] += length if linked[node] else 0
        for k in range(n - 1, 0, -1):
            if not self.out[k]:
                p = self.parent[k]
                chars[p] += chars[k]
                link_chars[p] += link_chars[k]
                tags[p] += tags[k] + 1
                link_tags[p] += link_tags[k] + linked[k]
        density, sums = [0.0] * n, [0.0] * n
        whole = link_chars[0] / max(1, chars[0])
        for k in range(n - 1, -1, -1):
            if self.out[k] or not chars[k]:
                continue
            c, t, lc, lt = chars[k], max(1, tags[k]), max(1, link_chars[k]), max(1, link_tags[k])
            base = math.log(c / max(1, c - link_chars[k]) * link_chars[k] + whole * c + math.e)
            density[k] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / base
            if k:
                sums[self.parent[k]] += density[k]
        return density, sums

    def region(self) -> set[int]:
        """The roots of the parts that make up the article; of a path node among them, only its own text and what stands below other roots."""
        density, sums = self.densities()
        n = len(self.tag)
        core = max(range(n), key=lambda k: (sums[k], density[k]))
        path = [core]
        while path[-1] > 0:
            path.append(self.parent[path[-1]])
        names = [self.tag[k] for k in path]
        path = path[: names.index("body") + 1 if "body" in names else n]
        threshold = min(density[k] for k in path)
        chars, linked, titled = [0] * n, [0] * n, [0] * n  # characters below a node, those within links and within headings
        is_link, is_title = [False] * n, [False] * n
        for k in range(1, n):
            is_link[k] = is_link[self.parent[k]] or self.tag[k] == "a"
            is_title[k] = is_title[self.parent[k]] or self.tag[k] in _HEADINGS
        for node, text, _ in self.runs:
            if not self.out[node]:
                length = sum(map(len, text.split()))
                chars[node] += length
                linked[node] += length if is_link[node] else 0
                titled[node] += length if is_title[node] else 0
        children: dict[int, list[int]] = {}
        for k in range(n - 1, 0, -1):
            for of in (chars, linked, titled):
                of[self.parent[k]] += of[k]
            children.setdefault(self.parent[k], []).append(k)
        roots, top = {core}, 0
        for depth in range(1, len(path)):
            child, k = path[depth - 1], path[depth]
            semantic = any(self.tag[p] in ("article", "main") for p in path[depth:])
            for s in children[k]:
                if s != child and chars[s] and not self.out[s]:
                    heading = s < child and titled[s] == chars[s] and (self.tag[s] == "h1" or k != path[-1])
                    if density[s] >= threshold > 0 or (heading or semantic) and 2 * linked[s] < chars[s]:
                        roots.add(s)
                        top = depth
        self.between = set(path[1 : top + 1])
        return roots

    def text(self) -> str:
        roots = self.region()
        inside = [False] * len(self.tag)
        for k in range(len(self.tag)):
            inside[k] = k in roots or k > 0 and inside[self.parent[k]]
        blocks: dict[int, list[str]] = {}
        for node, text, block in self.runs:
            if (inside[node] or node in self.between) and not self.out[node]:
                blocks.setdefault(block, []).append(text)
        return " ".join(filter(None, (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())))


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars, its code points."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("html_text")
        for batch in it:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_main_text": op7_main_text}
