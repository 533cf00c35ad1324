"""Main text of web pages by container paths that hosts agree on.

1. Each page is split into blocks of text. A block's characters outside links score for the containers around it: in
   full for its parent, half and a quarter for the next two, and in full for the nearest article or main element. The
   best container names its path: the tags and classes from the root down, digits generalised.
2. In Spark, pages of a host with the same set of paths are one template. A path's support is the share of
   the host's pages with that path on which it was best (pages plus one, so that lone pages prove little). Each
   template takes its path of the highest support.
3. Pages whose template decided for another path than their own best (few, and told by key) are told so; every
   page is read again and the blocks inside its path are its text.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments are known by tag, class, id or role
wherever they stand, and never counted or returned. Whole pages are read; no length is capped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cutline.llm.bitmaps import bitmaps, cell_of, cells_for, with_flag
from cutline.llm.graph import join_groups
from cutline.llm.text import chunks
from cutline.session import written

# --- fixed values: elements of HTML, and names that sites give to parts that are no article ----------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
             "h5 h6 header hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = set("applet aside audio button canvas datalist dialog embed footer form frameset head header iframe input map math menu "
              "nav noframes noscript object option search select script style svg template textarea title video".split())
SKIPPED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SKIPPED_NAMES = set(
    "ad ads adbox adblock adslot adsense adunit advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments "
    "commentlist consent cookie cookies disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar widget widgets".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6".split())
RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in "iframe noembed noframes script style textarea title xmp".split()}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
HOLDERS = set("ol ul dl table tbody thead tfoot tr div section article main aside nav body".split())

_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[-_:\s]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/><]*+)(?P<attributes>(?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")


def _no_article(tag: str, attrs: dict[str, str | None]) -> bool:
    """Is this element, by tag, role or names, no part of an article?"""
    if tag in SKIPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in SKIPPED_ROLES:
        return True
    if _HIDDEN.search(attrs.get("style") or ""):
        return True
    if tag in ("html", "body", "main") or tag not in BLOCKS:
        return False
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [p.lower() for p in _PARTS.split(name) if p]
        if parts and parts[0] not in ("has", "no", "with", "without", "is", "js") and (parts[0] in SKIPPED_NAMES or parts[-1] in SKIPPED_NAMES):
            return True
    return False


class Page:
    """The blocks of a page in order, and the containers around them.

    A container is (parent, path, nearest article or main, step); ``blocks`` holds (container, text, characters outside links).
    """

    def __init__(self, html: str) -> None:
        self.nodes: list[tuple[int, int, int, str]] = [(-1, 0, -1, "")]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, skipped
        self.opened: Counter[str] = Counter()  # tags in the stack
        self.parts: list[str] = []
        self.plain = 0
        self.link = 0  # depth of the stack where a link was opened
        at = 0
        while (found := _MARKUP.search(html, at)) is not None:
            self._text(html[at: found.start()])
            at, name = found.end(), found["name"]
            if name is None:
                continue  # comments and declarations
            name = name.lower()
            if found["end"]:
                self._close(name)
                continue
            if name in RAW:  # no markup inside; without an end it reaches to the end of the page
                end = RAW[name].search(html, at)
                at = end.end() if end else len(html)
                continue
            self._open(name, found["attributes"])
        self._text(html[at:])
        self._end_block()

    def _text(self, data: str) -> None:
        if data and not self.stack[-1][2]:
            data = unescape(data) if "&" in data else data
            self.parts.append(data)
            if not self.link:
                self.plain += len(data)

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.stack[-1][1], text, self.plain))
            self.parts = []
        self.plain = 0

    def _pop(self, depth: int) -> None:
        for tag, _, _ in self.stack[depth:]:
            self.opened[tag] -= 1
        del self.stack[depth:]

    def _leave(self, depth: int) -> None:
        self._end_block()
        self._pop(depth)
        if self.link > depth:
            self.link = 0

    def _close_implied(self, tag: str) -> None:
        if self.stack[-1][0] == "p":
            self._leave(len(self.stack) - 1)
        closed = CLOSED_BY.get(tag, ())
        depth = len(self.stack) - 1
        while closed and depth > 0 and (self.stack[depth][0] not in HOLDERS or self.stack[depth][0] in closed):
            if self.stack[depth][0] in closed:
                self._leave(depth)
            depth -= 1

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append("\n")
        elif tag == "hr":
            self._end_block()
        elif tag == "a":
            self.link = len(self.stack)
        if tag in VOID or (tag not in BLOCKS and tag not in SKIPPED):
            return
        if tag in BLOCKS:
            self._close_implied(tag)
            self._end_block()
        named = {}
        for name, *values in _ATTRIBUTE.findall(attributes or ""):
            named.setdefault(name.lower(), unescape("".join(values)))
        _, node, skipped = self.stack[-1]
        skipped = skipped or _no_article(tag, named)
        if tag in BLOCKS and not skipped and tag not in LEAVES:
            step = ".".join([tag, *sorted(_DIGITS.sub("#", c) for c in named.get("class", "").split())])
            path = xxhash.xxh64_intdigest(step, self.nodes[node][1] & (2**64 - 1))
            own = len(self.nodes)
            whole = own if tag in ("article", "main") or named.get("role") == "main" or named.get("itemprop") == "articleBody" else self.nodes[node][2]
            self.nodes.append((node, path - (1 << 64) if path >= 1 << 63 else path, whole, step))
            node = own
        self.stack.append((tag, node, skipped))
        self.opened[tag] += 1

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag in ("body", "html") or not self.opened[tag]:
            return  # what follows still belongs to the page
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                if tag in BLOCKS:
                    self._leave(depth)
                else:
                    self._pop(depth)
                return

    def best(self) -> int | None:
        """Path of the container with the highest score; of equal ones, the first on the page."""
        scores = [0.0] * len(self.nodes)
        for node, _, letters in self.blocks:
            whole = self.nodes[node][2]
            if whole >= 0:
                scores[whole] += letters
            for share in (1.0, 0.5, 0.25):
                if node < 0:
                    break
                if node != whole:
                    scores[node] += share * letters
                node = self.nodes[node][0]
        top = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return self.nodes[top][1] if scores[top] > 0 else None

    def paths(self) -> list[int]:
        """Different paths of containers with blocks somewhere inside."""
        used = [False] * len(self.nodes)
        for node, _, _ in self.blocks:
            while node >= 0 and not used[node]:
                used[node], node = True, self.nodes[node][0]
        return sorted({self.nodes[i][1] for i, u in enumerate(used) if u})

    def text(self, path: int | None) -> tuple[str, str | None]:
        """Blocks inside containers of ``path``, one per line, and the steps of that path."""
        inside, where = [], None
        for i, (parent, own, _, _) in enumerate(self.nodes):
            inside.append(own == path or (parent >= 0 and inside[parent]))
            where = i if where is None and own == path else where
        steps = []
        while where is not None and where > 0:
            steps.append(self.nodes[where][3])
            where = self.nodes[where][0]
        lines = [text for node, text, _ in self.blocks if inside[node]]
        return "\n".join(lines), ">".join(reversed(steps)) if lines else None


def page_paths(pages: DataFrame) -> DataFrame:
    """(page, key, host, best, paths) of ``pages`` (page, url, html, key)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "html"):
            read = [Page(html or "") for html in chunk.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("key"), chunk.column("host"), pa.array([p.best() for p in read], pa.int64()),
                 pa.array([p.paths() for p in read], pa.list_(pa.int64()))], ["key", "host", "best", "paths"])

    return pages.select("key", host.alias("host"), "html").mapInArrow(look, "key bigint, host string, best bigint, paths array<bigint>")


def other_paths(read: DataFrame) -> DataFrame:
    """(key, path) of the pages for which their host decided on another path than their own best; ``read`` is stored."""
    templates = written(read.where("best is not null").groupBy("host", "paths", "best").agg(F.count(F.lit(1)).alias("n")), "templates")
    each = templates.select("host", "paths", "best", "n", F.explode("paths").alias("path"))
    support = each.groupBy("host", "path").agg((F.sum(F.when(F.col("path") == F.col("best"), F.col("n")).otherwise(0)) / (F.sum("n") + 1)).alias("support"))
    ranked = each.join(support, ["host", "path"]).groupBy("host", "paths", "best").agg(
        F.max("n").alias("n"), F.max_by("path", F.struct("support", (F.col("path") == F.col("best")).alias("own"), "path")).alias("path"))
    changed = written(ranked.where("path <> best").select(F.xxhash64("host", "paths", "best").alias("template"), "n", "path"), "changed")
    pages = read.where("best is not null").select("key", F.xxhash64("host", "paths", "best").alias("template"))
    return join_groups(pages, changed, "template").select("key", "path").dropDuplicates(["key"])


def page_texts(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text``, the main text (empty if there is none), and ``path``, the
    container it came from (null then).

    Blocks are lines of ``text`` in page order; blanks inside a block are one space. Null or empty html gives an empty text,
    a null or odd url the host "". Ids are not needed: rows of equal url and html are alike and get the same text. Columns
    of ``pages`` named ``text`` or ``path`` are replaced. An empty table gives an empty table.

    Html never moves, but for pages that the bitmap of changed keys cannot rule out.
    """
    kept = [c for c in pages.columns if c not in (html_column, "text", "path")]
    key = F.xxhash64(F.coalesce(F.col(url_column), F.lit("")), F.coalesce(F.col(html_column), F.lit("")))
    rows = pages.select(F.struct(*(F.col(c) for c in kept)).alias("row"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), key.alias("key"))
    changed = written(other_paths(written(page_paths(rows), "page_paths")), "other_paths")
    cells = cells_for(changed.count())
    marks = written(bitmaps(changed.select(cell_of("key", cells=cells).alias("cell")).distinct()), "changed_bits")
    tested = with_flag(rows, marks, [cell_of("key", cells=cells)], "may")
    stay = tested.where("not may").select("row", "html", F.lit(None).cast("bigint").alias("path"))
    told = tested.where("may").join(changed, "key", "left").select("row", "html", "path")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "html"):
            out = []
            for html, path in zip(chunk.column("html").to_pylist(), chunk.column("path").to_pylist()):
                page = Page(html or "")
                out.append(page.text(page.best() if path is None else path))
            texts, paths = zip(*out)
            yield pa.RecordBatch.from_arrays([chunk.column("row"), pa.array(texts, pa.string()), pa.array(paths, pa.string())], ["row", "text", "path"])

    schema = rows.select("row", F.lit("").alias("text"), F.lit(None).cast("string").alias("path")).schema
    return stay.unionByName(told).mapInArrow(extract, schema).select("row.*", "text", "path")
