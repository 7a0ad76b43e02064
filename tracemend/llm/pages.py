"""Main text of web pages by removal of site templates.

Element subtrees of each page are hashed and counted by host; those that stand on many pages of a host beside different
content are its template and are deleted, whatever their names. What no count can tell, for a host may have one page only,
goes by its kind: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. Of what
is left the article, or the main part, or the body is read block by block.

A page's own paragraphs within an article are no template, however often they stand elsewhere: pages are copied, and
passages quoted. In a page without an article or main part nothing tells a quotation from a notice, and what recurs goes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, fields_of, fresh, map_arrow, quoted, table

MANY, SHARE = 3, 0.01  #: pages of a host with different content on which a template stands, at least, and their share of the host's pages
BROADCAST_BYTES, SALTS = 8 << 20, 16

# fixed values of HTML: elements without content, with raw content, that make blocks, that end an open paragraph or item
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
IN_TABLES = set("body caption col colgroup head html tbody td tfoot th thead tr".split())
WITHIN = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tbody", "thead", "tfoot"}, "tbody": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead", "tfoot"}}
# elements that are no article: blocks; within a line; and words in the class, id or role of others
NO_ARTICLE = set("head nav aside footer form dialog menu search fieldset".split())
SKIPPED = set("template select button object svg canvas audio video map datalist label".split()) | RAW
NAMES = set(
    "ad ads adv advert adverts advertisement advertisements adsense adbox adslot banner sponsor sponsored sponsors promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager sidebar sidebars "
    "aside complementary contentinfo footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert alertdialog disclaimer popup modal newsletter subscribe subscription signup login search "
    "searchbox share sharing social comment comments commentlist respond replies disqus related recommended widget widgets copyright".split()
)
BEGINS = ("adsby", "advert", "cookie", "newsletter", "sidebar", "sponsor")  #: and words that begin so
PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr figcaption caption tbody thead tfoot".split())  #: in an article, no template

_tag = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z)"""
    r"""|(?P<start>[a-zA-Z][^\s/>]*)(?:(?P<rest>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|(?P<odd>[^>]*)(?:>|\Z)))""",
    re.S,
)
_attribute = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_end_of_raw = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Block elements in order of their begins, as parallel lists, and blocks of text, each in the innermost element around it."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[frozenset] = field(default_factory=list)  #: words of class, id and role
    begins: list[int] = field(default_factory=list)  #: blocks before the element
    ends: list[int] = field(default_factory=list)  #: blocks before its end
    blocks: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)


def words_of(rest: str) -> frozenset:
    if "=" not in rest:
        return frozenset()
    return frozenset(w.lower() for v in _attribute.findall(rest) for w in _word.findall(html.unescape("".join(v))))


def no_article(names: frozenset) -> bool:
    return bool(names & NAMES) or any(w.startswith(BEGINS) for w in names)


class Reader:
    """Builds a Page; unclosed and stray tags are taken much as browsers take them, elements within a line leave their text only."""

    def __init__(self) -> None:
        self.page, self.stack, self.open, self.text = Page(), [], Counter(), []

    def close_block(self) -> None:
        said = " ".join("".join(self.text).split()) if self.text else ""
        self.text.clear()
        if said:
            self.page.blocks.append(said)
            self.page.owners.append(self.stack[-1] if self.stack else -1)

    def pop_to(self, depth: int) -> None:
        self.close_block()
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.open[self.page.tags[e]] -= 1
            self.page.ends[e] = len(self.page.blocks)

    def depth_of(self, some: set[str], within: set[str]) -> int | None:
        """The depth of the innermost open element of `some`, if none of `within` is open inside it."""
        if any(self.open[t] for t in some):
            for d in range(len(self.stack) - 1, -1, -1):
                if (t := self.page.tags[self.stack[d]]) in some:
                    return d
                if t in within:
                    break
        return None

    def begin(self, tag: str, rest: str) -> None:
        self.close_block()
        if tag not in IN_TABLES and (d := self.depth_of({"p"}, BLOCKS - {"p"})) is not None:
            self.pop_to(d)
        if tag in CLOSES and (d := self.depth_of(CLOSES[tag], WITHIN[tag])) is not None:
            self.pop_to(d)
        if tag == "body" and (d := self.depth_of({"head"}, set())) is not None:
            self.pop_to(d)
        if tag in VOID or (tag in ("html", "body") and self.open[tag]):
            return
        page = self.page
        page.tags.append(tag)
        page.parents.append(self.stack[-1] if self.stack else -1)
        page.names.append(words_of(rest))
        page.begins.append(len(page.blocks))
        page.ends.append(-1)
        self.stack.append(len(page.tags) - 1)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        self.close_block()
        if (d := self.depth_of({tag}, set())) is not None:
            self.pop_to(d)

    def read(self, source: str) -> Page:
        at = 0
        skipped: list[str] = []  # open elements within a line whose text is no article
        while m := _tag.search(source, at):
            if m.start() > at and not skipped:
                self.text.append(html.unescape(source[at : m.start()]))
            at = m.end()
            if start := m["start"]:
                tag, rest = start.lower(), m["rest"] or m["odd"] or ""
                if tag in RAW:
                    end = _end_of_raw[tag].search(source, at)
                    at = end.end() if end else len(source)
                elif skipped:
                    if tag not in VOID and not rest.endswith("/"):
                        skipped.append(tag)
                elif tag in BLOCKS:
                    self.begin(tag, rest)
                elif tag == "br":
                    self.text.append(" ")
                elif tag not in VOID and not rest.endswith("/") and (tag in SKIPPED or no_article(words_of(rest))):
                    skipped.append(tag)
            elif m["end"]:
                tag = m["end"].lower()
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                elif tag in BLOCKS:
                    if self.open[tag]:  # what was never closed within a line ends with the block around it
                        skipped.clear()
                    if not skipped:
                        self.end(tag)
            elif m["cdata"] and not skipped:
                self.text.append(m["cdata"])
        if not skipped:
            self.text.append(html.unescape(source[at:]))
        self.pop_to(0)
        return self.page


def parse(source: str) -> Page:
    return Reader().read(source)


def hashes(page: Page) -> list[int]:
    """A hash of each element's subtree: its tag, its blocks and its elements in order."""
    items: list[list] = [[] for _ in page.tags]
    for b, (owner, text) in enumerate(zip(page.owners, page.blocks, strict=True)):
        if owner >= 0:
            items[owner].append((b, 1, xxhash.xxh3_64_intdigest(text)))
    out = [0] * len(page.tags)
    for e in range(len(page.tags) - 1, -1, -1):
        inner = sorted(items[e])
        out[e] = xxhash.xxh3_64_intdigest(page.tags[e].encode() + b"".join(bytes([k]) + h.to_bytes(8, "little") for _, k, h in inner)) >> 1
        if page.parents[e] >= 0:
            items[page.parents[e]].append((page.begins[e], 0, out[e]))
    return out


def contexts(page: Page) -> list[int | None]:
    """For each element the hash of the longest block outside it, by which pages of different content are told from copies; None where all text is inside."""
    sizes = [(len(t), -i) for i, t in enumerate(page.blocks)]
    before = [(0, 1), *accumulate(sizes, max)]
    after = [*accumulate(reversed(sizes), max, initial=(0, 1))][::-1]
    out = []
    for b, e in zip(page.begins, page.ends, strict=True):
        size, at = max(before[b], after[e])
        out.append(xxhash.xxh3_64_intdigest(page.blocks[-at]) >> 1 if size else None)
    return out


def roots_of(page: Page, gone: set[int] = frozenset(), prints: list[int] | None = None) -> tuple[list[bool], list[bool]]:
    """For each element: whether its blocks are main text, and whether it may be a template.

    Main text is what lies in articles, or else in main parts, or else in the page, but for elements of other kinds, articles
    within articles, and elements whose hash is in `gone`. The roots, what is around them, and the prose of articles are no templates.
    """
    n, tags, parents, names = len(page.tags), page.tags, page.parents, page.names
    held = [False] * n  # has an article or a main part inside
    outer = [False] * n  # in an article
    first = next((e for e in range(n) if tags[e] == "article"), None)
    for e in range(n):
        p = parents[e]
        outer[e] = p >= 0 and (outer[p] or tags[p] == "article")
        if tags[e] == "article" or tags[e] == "main":
            while p >= 0 and not held[p]:
                held[p] = True
                p = parents[p]
    other = [False] * n
    for e in range(n):
        p, tag, own = parents[e], tags[e], names[e]
        if p >= 0 and other[p]:
            other[e] = True
        elif (tag in NO_ARTICLE and not (tag == "form" and held[e])) or (tag == "article" and outer[e]) or (tag == "header" and not outer[e] and not held[e]):
            other[e] = True
        elif tag not in ("html", "body", "main") and e != first and not held[e]:
            other[e] = no_article(own) or (not outer[e] and "header" in own)
        if prints is not None and prints[e] in gone:
            other[e] = True
    for kind in ("article", "main", ""):
        roots = {e for e in range(n) if tags[e] == kind and not other[e]}
        if roots or not kind:
            break
    main, template = [False] * n, [False] * n
    for e in range(n):
        p = parents[e]
        within = e in roots or (p >= 0 and main[p]) or not roots
        main[e] = within and not other[e]
        template[e] = e not in roots and not held[e] and tags[e] not in ("html", "body", "head") and not (outer[e] and tags[e] in PROSE)
    return main, template


def main_text(page: Page, gone: set[int] = frozenset()) -> str:
    if not page.tags:
        return "\n".join(page.blocks)
    main, _ = roots_of(page, gone, hashes(page) if gone else None)
    bare = "article" not in page.tags and "main" not in page.tags  # blocks outside all elements
    return "\n".join(t for t, o in zip(page.blocks, page.owners, strict=True) if (main[o] if o >= 0 else bare))


SEEN = "host string, print long, contexts array<long>, pages array<binary>"


def subtrees(pages: DataFrame) -> DataFrame:
    """Rows of SEEN from (host, page, html), one for each subtree of a host in a batch: what stands beside it, and the pages whose main text it is part of."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found: dict[tuple[str, int], tuple[set, list]] = {}
            for host, key, source in zip(b["host"].to_pylist(), b["page"].to_pylist(), b["html"].to_pylist(), strict=True):
                page = parse(source)
                main, template = roots_of(page)
                beside = contexts(page)
                for e, h in enumerate(hashes(page)):
                    if template[e] and beside[e] is not None and page.begins[e] < page.ends[e]:
                        seen = found.setdefault((host, h), (set(), []))
                        seen[0].add(beside[e])
                        if main[e]:
                            seen[1].append(key)
            yield {"host": [h for h, _ in found], "print": [p for _, p in found], "contexts": [list(c) for c, _ in found.values()], "pages": [sorted(set(k)) for _, k in found.values()]}

    return map_arrow(pages, SEEN, each)


def templates(seen: DataFrame, totals: DataFrame) -> DataFrame:
    """(host, print) of the subtrees on many pages of a host. totals: host, total.

    Contexts are made distinct before they are counted, so neither a host nor a subtree is one task's; totals are joined over salts.
    """
    counts = seen.select("host", "print", F.explode("contexts").alias("c")).distinct().groupBy("host", "print").agg(F.count("*").alias("n")).where(F.col("n") >= MANY)
    totals = totals.where(F.col("total") * SHARE > MANY).select("host", "total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    t = counts.withColumn("salt", F.pmod("print", F.lit(SALTS)).cast("int")).join(totals, ["host", "salt"], "left")
    return t.where(F.col("n") >= F.coalesce(F.col("total") * SHARE, F.lit(0))).select("host", "print")


def host_of(url: str = "url") -> F.Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (url, html and others) with `text`, the main text of each.

    Character references are decoded; white space, line breaks and no-break spaces within a block become one space; blocks
    are joined in page order by line ends. A null or empty page has the empty text; a page without elements is its text; one
    without a url belongs to no host, which has no template. Repeated rows each stay. An existing column text is replaced;
    other columns stay. An empty table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    taken = [*pages.columns, "host", "print", "contexts"]
    key, gone = (fresh(taken, c) for c in ("page", "gone"))
    source = F.coalesce(F.col("html"), F.lit(""))
    t = pages.select(*(quoted(c) for c in pages.columns if c.lower() != "text"))
    others = [c for c in t.columns]
    t = t.withColumn(key, F.unhex(F.md5(F.concat(host_of(), F.lit("\0"), source))))
    hosted = t.select(host_of().alias("host"), F.col(key).alias("page"), source.alias("html")).where("host <> ''")
    seen = scratch.keep(subtrees(hosted))
    totals = hosted.select("host", "page").groupBy("host").agg(F.count("*").alias("total"))
    found = scratch.keep(templates(seen, totals))
    hits = seen.where(F.size("pages") > 0).join(found, ["host", "print"]).select(F.explode("pages").alias("page_"), "print").distinct()
    hits = scratch.keep(hits.groupBy("page_").agg(F.collect_list("print").alias(gone)))  # of one page
    size = hits.agg(F.coalesce(F.sum(64 + 8 * F.size(gone)), F.lit(0))).first()[0]
    t = t.join(F.broadcast(hits) if size <= BROADCAST_BYTES else hits, F.col(key) == F.col("page_"), "left").drop("page_", key)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {c: b[c] for c in others} | {"text": [main_text(parse(s or ""), frozenset(g or ())) for s, g in zip(b["html"].to_pylist(), b[gone].to_pylist(), strict=True)]}

    return map_arrow(t, f"{fields_of(t, gone)}, text string", each)


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page and its length. Nulls, empty pages and repeats as in `extract_main_text`."""
    done = extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op13_page_text": op13_page_text}

# for pages whose article stands in one element of that name, without anything else inside it
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages
), blocks AS (
  SELECT page_id, url, list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(body, '</?(p|h[1-6]|li|ul|ol|div|blockquote|table|tr|td)(\s[^>]*)?>', chr(1), 'g'), '<br>', ' ', 'g'), '</?[a-z]+[^>]*>', '', 'g'), chr(1)),
    lambda s: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '&quot;?', '"', 'g'), '&#39;', chr(39), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM a
), t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda s: s <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
ORACLES = {"op13_page_text": ORACLE}
