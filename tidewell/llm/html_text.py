"""Main text of web pages: site templates go by counting element subtrees per host.

First pass: each page's elements are hashed in two ways, and Spark counts per host the different pages (by a hash of the whole
page) that hold each hash.

* A block element's hash covers all that it contains.  Subtrees on more than ``RATIO`` of a host's pages (and ``MIN_PAGES`` or more) are template.
* A slot is a container element's place in the page: its own and its ancestors' tags and class names, without text, so the slot of a menu is the
  same on every page though its words differ.  Of the slots on more than ``RATIO`` of a host's pages, the innermost that holds
  half of the host's text is the content slot.  Slots outside it with up to ``OUTSIDE_SHARE`` of the text are template, and so is any slot
  whose text is half links or more; slots that hold the content slot, and outside ones with a top heading, are not.

Second pass: pages are read again without the template, without elements that by tag, role, class or id are no main text, and with the
articles only where there are any.  Paragraphs and headings inside an article always stay, however often they recur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, ship

RATIO, MIN_PAGES, CONTENT_SHARE, OUTSIDE_SHARE = 0.3, 5, 0.5, 0.15
#: Hashes of templates up to which they go to every executor (32 MB); beyond it pages and templates are joined by a shuffle that AQE may split.
BROADCAST_HASHES = 4_000_000
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*')*+|[^>]*+)>""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
CLASS = re.compile(r"""(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

# Element names by their role in HTML, and class names by convention.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes template svg math iframe object noscript canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
DROP = frozenset("nav aside footer form button select option input label fieldset menu dialog head datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar status".split())
CLOSES_P = BLOCK - frozenset(["body", "html", "caption", "tbody", "tfoot", "thead", "tr"])
OWN_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
SLOTS = frozenset("address article aside center details div dl figure footer form header main menu nav ol section table ul".split())
CLUTTER = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|banner|ads?|adverts?|advertisement|advertising|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|social|share|sharing|related|recommended|recommendations|comments?|disqus|replies|respond|widget|pagination|pager|toolbar|login|notices?|alert|toast|hidden|sr-only)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:content|article|main|post-body|entry|story)(?:$|[\s_-])", re.I)
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply)(?:$|[\s_-])", re.I)


def _clutter(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is by its name and attributes no main text."""
    if tag in DROP or (tag == "header" and not in_article):
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return False
    a = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if tag in ("article", "main"):
        return bool(READERS.search(names))
    return bool(CLUTTER.search(names)) and (not CONTENT.search(names) or bool(READERS.search(names)))


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s>/]", re.I)


@lru_cache(maxsize=20_000)
def _slot(above: int, tag: str, classes: str) -> int:
    """The hash of a slot: of the slot around it, its tag and its class names without numbers of two or more digits."""
    names = " ".join(sorted({re.sub("[0-9]{2,}", "", c) for c in classes.strip("\"'").split()}))
    h = xxhash.xxh64_intdigest(f"{above}\0{tag}\0{names}")
    return h - ((h >> 63) << 64)


class Element:
    """An open element: parts for its hash, the count of blocks before it, whether it is dropped, its place among articles, its slot, and whether it lies in or holds the content slot."""

    __slots__ = ("tag", "parts", "before", "dropped", "article", "slot", "own", "chars", "links", "linked", "title", "inside", "holds")

    def __init__(self, tag: str, before: int, dropped: bool, article: int, slot: int, own: bool, linked: bool, inside: bool):
        self.tag, self.parts, self.before, self.dropped, self.article, self.slot, self.own, self.linked, self.inside = tag, [], before, dropped, article, slot, own, linked, inside
        self.chars = self.links = 0
        self.title, self.holds = tag == "h1", False


class Template(NamedTuple):
    """A host's template: hashes of subtrees, slots full of links, slots outside the content slot, and the content slot (or none)."""

    trees: frozenset = frozenset()
    dense: frozenset = frozenset()
    slots: frozenset = frozenset()
    content: frozenset = frozenset()


class Reader:
    """One reading of a page.  ``hashes`` collects the hashes of its block elements, ``slots`` per slot its depth, its characters, those in links, and whether it has a top heading."""

    def __init__(self, template: Template = Template(), names: bool = True):
        self.template, self.names = template, names
        self.stack = [Element("", 0, False, 0, 0, False, False, False)]
        self.outside: list[tuple[int, int]] = []
        self.open: dict[str, list[int]] = {}
        self.blocks: list[tuple[str, int]] = []
        self.words: list[str] = []
        self.hashes: set[int] = set()
        self.slots: dict[int, list] = {}
        self.articles = self.removed = 0

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            self.words.clear()
            top = self.stack[-1]
            if text and not top.dropped:
                self.blocks.append((text, top.article))

    def close(self) -> None:
        top = self.stack[-1]
        if top.tag in BLOCK:
            self.flush()
        self.stack.pop()
        self.open[top.tag].pop()
        above = self.stack[-1]
        above.chars += top.chars
        above.links += top.links
        above.title |= top.title
        h = xxhash.xxh64_intdigest(f"{top.tag}\0" + "\1".join(top.parts))
        above.parts.append(f"{h:x}")
        above.holds |= top.holds
        t = self.template
        if top.own:
            seen = self.slots.setdefault(top.slot, [len(self.stack), 0, 0, False])
            seen[1], seen[2], seen[3] = seen[1] + top.chars, seen[2] + top.links, seen[3] or top.title
            above.holds |= top.slot in t.content
        if top.tag in BLOCK and top.parts and top.tag not in ("html", "body"):
            h -= (h >> 63) << 64
            self.hashes.add(h)
            same = h in t.trees and not (top.article and top.tag in HEADINGS) and top.tag not in ("article", "main")
            if same or (top.own and top.slot in t.dense and top.slot not in t.content and not top.holds):
                self.removed += len(self.blocks) > top.before
                del self.blocks[top.before :]
                while self.outside and self.outside[-1][0] >= top.before:
                    self.outside.pop()
            elif top.own and top.slot in t.slots and not top.inside and not top.holds and len(self.blocks) > top.before:
                self.outside.append((top.before, len(self.blocks)))

    def close_down_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.close()

    def text(self, s: str) -> None:
        if s and not s.isspace():
            top = self.stack[-1]
            top.parts.append(" ".join(s.split()))
            top.chars += len(top.parts[-1])
            if top.linked:
                top.links += len(top.parts[-1])
            if not top.dropped:
                self.words.append(unescape(s) if "&" in s else s)
        elif s:
            self.words.append(" ")

    def last(self, tags: tuple) -> int:
        """The place in the stack of the innermost open element of these tags; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.open.get(t))), default=0)

    def start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            k = self.last(("p",))
            if k > self.last(("td", "th", "button", "article")):
                self.close_down_to(k)
        if tag in OWN_END:
            k = self.last(OWN_END[tag])
            if k > self.last(FENCES[tag]):
                self.close_down_to(k)
        if tag in BLOCK:
            self.flush()
        elif tag in ("td", "th"):
            self.words.append(" ")
        top = self.stack[-1]
        dropped = top.dropped or (self.names and _clutter(tag, attrs, top.article > 0))
        article = top.article
        if tag == "article" and not dropped and article <= 0:
            self.articles += 1
            article = self.articles
        elif not article and not dropped and (tag == "main" or re.search(r"role\s*=\s*[\"']?main", attrs)):
            article = -1
        own = tag in SLOTS
        slot, inside = top.slot, top.inside
        if own:
            named = CLASS.search(attrs) if attrs else None
            slot = _slot(top.slot, tag, named.group(1) if named else "")
            inside |= slot in self.template.content
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, len(self.blocks), dropped, article, slot, own, top.linked or tag == "a", inside))

    def feed(self, html: str) -> None:
        at, n, end_of_tags = 0, len(html), html.rfind(">")
        while at < n:
            lt = html.find("<", at)
            if lt < 0 or (lt > end_of_tags and not html.startswith("<!--", lt)):
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
                continue
            if html.startswith(("<!", "<?"), lt):
                stop = html.find("]]>", lt) + 2 if html.startswith("<![CDATA[", lt) else -1
                at = (stop if stop > 1 else html.find(">", lt)) + 1
                continue
            m = TAG.match(html, lt, end_of_tags + 1)
            if not m:
                self.text("<")
                at = lt + 1
                continue
            at = self.tag(html, m)
        self.close_down_to(1)
        self.flush()
        if self.stack[0].holds:
            # The page has the content slot, so what stands in the other slots goes.
            gone = set()
            for a, b in self.outside:
                gone.update(range(a, b))
            self.removed += len(self.outside)
            self.blocks = [x for k, x in enumerate(self.blocks) if k not in gone]

    def tag(self, html: str, m: re.Match) -> int:
        """Take one tag; returns where to read on."""
        at, tag, attrs = m.end(), m.group(2).lower(), m.group(3)
        if m.group(1):
            if tag == "br":
                self.words.append(" ")
            elif depth := self.last((tag,)):
                self.close_down_to(depth)
            elif tag == "p":
                self.flush()
        elif tag in RAW:
            if not (tag in ("svg", "math") and attrs.rstrip().endswith("/")):
                end = _end_of(tag).search(html, at)
                stop = html.find(">", end.start()) if end else -1
                at = len(html) if stop < 0 else stop + 1
                self.words.append(" ")
        elif tag == "hr":
            self.flush()
        elif tag in VOID:
            self.words.append(" " if tag == "br" else "")
        else:
            self.start(tag, attrs)
        return at

    def main_text(self) -> str:
        """The text of the articles, else of the main part, else of the whole page."""
        for wanted in (lambda k: k > 0, lambda k: k < 0, lambda k: True):
            if found := [t for t, k in self.blocks if wanted(k)]:
                return "\n\n".join(found)
        return ""


def read(html: str, template: Template = Template(), names: bool = True) -> str:
    """The main text of a page, without what ``template`` says; without ``names`` tags, roles, classes and ids decide nothing."""
    reader = Reader(template, names)
    reader.feed(html)
    return reader.main_text()


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_HASHES = T.ArrayType(T.LongType())
_SLOT = T.StructType([T.StructField(n, k) for n, k in (("slot", T.LongType()), ("depth", T.IntegerType()), ("chars", T.LongType()), ("links", T.LongType()), ("title", T.BooleanType()))])
PARTS = T.StructType([T.StructField("trees", _HASHES), T.StructField("slots", T.ArrayType(_SLOT)), T.StructField("chars", T.LongType())])


@F.pandas_udf(PARTS)
def _parts(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in pages:
        out = []
        for html in s:
            reader = Reader()
            reader.feed(html or "")
            slots = [{"slot": k, "depth": d, "chars": c, "links": n, "title": t} for k, (d, c, n, t) in sorted(reader.slots.items())]
            out.append((sorted(reader.hashes), slots, reader.stack[0].chars))
        yield pd.DataFrame(out, columns=PARTS.names)


def templates(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Per host: ``__h_host`` and ``__h_template`` (a struct like Template), whose hashes are fewer than (the host's elements per page) / RATIO."""
    page = F.struct(F.xxhash64(html_col).alias("a"), F.hash(html_col).alias("b")).alias("page")
    parts = pages.select(host(F.col(url_col)).alias("h"), page, _parts(html_col).alias("x"))
    # The different pages of a host, each with what it holds; texts stay behind.
    parts = materialise(parts.groupBy("h", "page").agg(F.any_value("x").alias("x")).select("h", "x.*"), "html-parts")
    totals = parts.groupBy("h").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("whole"))
    often = lambda df: df.join(totals, "h").where((F.col("n") >= MIN_PAGES) & (F.col("n") > RATIO * F.col("pages")))
    trees = often(parts.select("h", F.explode("trees").alias("t")).groupBy("h", "t").agg(F.count(F.lit(1)).alias("n")))
    each = parts.select("h", F.inline("slots"))
    slots = each.groupBy("h", "slot").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("title").alias("title"))
    slots = often(slots).where("chars > 0")
    full, big = 2 * F.col("links") >= F.col("chars"), F.col("chars") >= CONTENT_SHARE * F.col("whole")
    set_of = lambda test: F.collect_list(F.when(test, F.col("slot")))
    slots = slots.groupBy("h").agg(
        set_of(full & ~big).alias("dense"), set_of(~full & (F.col("chars") <= OUTSIDE_SHARE * F.col("whole")) & ~F.col("title")).alias("slots"),
        F.array_compact(F.array(F.min_by("slot", F.when(big, F.struct("chars", -F.col("depth"), "slot"))))).alias("content"),
    )
    both = trees.groupBy("h").agg(F.collect_list("t").alias("trees")).join(slots, "h", "full")
    out = materialise(both.select(F.col("h").alias("__h_host"), F.struct(*Template._fields).alias("__h_template")), "html-templates")
    discard(parts)
    return out


def _read_column(names: bool, removals: bool):
    kind = T.LongType() if removals else T.StringType()

    def run(columns: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for pages, found in columns:
            out = []
            for html, *sets in zip(pages, *(found[c] for c in Template._fields)):
                reader = Reader(Template(*(frozenset() if x is None else frozenset(x) for x in sets)), names)
                reader.feed(html or "")
                out.append(reader.removed if removals else reader.main_text())
            yield pd.Series(out, dtype="int64" if removals else "object")

    run.__annotations__ = {"columns": Iterator[tuple[pd.Series, pd.DataFrame]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def _with_templates(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    ship(pages.sparkSession)
    known = templates(pages, url_col, html_col)
    sizes = F.expr("aggregate(array(__h_template.trees, __h_template.dense, __h_template.slots), 8, (n, x) -> n + coalesce(size(x), 0))")
    if (known.agg(F.sum(sizes)).first()[0] or 0) <= BROADCAST_HASHES:
        known = F.broadcast(known)
    return pages.withColumn("__h_of", host(F.col(url_col))).join(known, F.col("__h_of") == F.col("__h_host"), "left")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep_cols: list[str] | None = None, names: bool = True) -> DataFrame:
    """The columns of ``pages`` (or ``keep_cols``) and ``__h_text``, the main text of each page; without ``names`` only templates decide.

    Null and empty pages have empty text.  Pages without a host share one empty host.  Equal pages of a host count as one
    when templates are sought, so a page stored many times is no template of itself.
    """
    cols = pages.columns if keep_cols is None else keep_cols
    return _with_templates(pages, url_col, html_col).select(*cols, _read_column(names, False)(F.col(html_col), F.col("__h_template")).alias("__h_text"))


def removals(pages: DataFrame, url_col: str = "url", html_col: str = "html", names: bool = False) -> DataFrame:
    """Per host: ``host``, ``pages``, ``changed`` (pages from which a template subtree or slot with text went) and ``subtrees`` (how many went)."""
    gone = _with_templates(pages, url_col, html_col).select("__h_of", _read_column(names, True)(F.col(html_col), F.col("__h_template")).alias("n"))
    return gone.groupBy(F.col("__h_of").alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n") > 0).alias("changed"), F.sum("n").alias("subtrees"))
