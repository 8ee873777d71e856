"""HTML extraction by equivalence-class template deduction.

Pages of one host come from a template. A page's tokens are its tags, each in the role given
by its path with classes and ids, and its text blocks, each in the role given by its path and
words. Pages of one host whose body and article stand in the same roles are of one layout. The
occurrence vector of a token says how often it stands in each page of its layout; tokens with
equal vectors form an equivalence class. A class of enough tokens that occurs in enough of the
layout's pages is valid, and the valid classes, nested by how many pages they cover, are the
layout's template. What the template does not say are its slots: extraction drops template
text wherever it stands, zones that the template has for other things than the article (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments), scripts, styles and
markup, and returns the blocks in the slots that remain, those of the article where a page
marks one. A class, id or role that merely sounds like a zone drops nothing unless its element
is part of the template; where a layout has no template, it is all there is to go by.

Vectors are never built: a token's vector is represented by the sum over its pages of a hash
of page and count, which partial aggregation forms before the shuffle, so a layout may have any
number of pages. A template is bounded: its tokens occur in half of the layout's pages.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Spool, map_slices, table

MIN_PAGES, MIN_TOKENS, MIN_SHARE = 3, 2, 0.5
BROADCAST_ROLES = 1_000_000
#: The token that every page has once, so that a layout's pages are counted with its tokens.
PAGE = 0
LONG_PATH = 1000

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(script|style|noscript|template|iframe|textarea|svg|math|title|object|canvas|select)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|$)|</?[a-zA-Z]{_ATTRIBUTES}>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[a-z0-9]+")

BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br td th option".split())
CLOSES_P = BLOCKS - {"body", "html"}
#: Elements and classes, ids or roles that a page has for other things than its article.
ZONES = frozenset("nav footer aside form button input label menu head dialog".split())
ZONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)


def attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(tag)}


def is_zone(name: str, given: dict[str, str], in_article: bool) -> int:
    """Whether an element is for something else than the article: 2 if surely, 1 if the template has to say so, or 0."""
    if name in ZONES or (name == "header" and not in_article):
        return 1 if in_article else 2
    if name in ("body", "html", "article", "main"):
        return 0
    words = {w for k in ("class", "id", "role") for w in _PARTS.findall(given.get(k, "").lower())}
    return int(bool(words & (ZONE_WORDS - {"header"} if in_article else ZONE_WORDS)))


def _short(path: str) -> str:
    """A path of bounded length: a long one is named by its hash, so that roles of any depth stay apart."""
    return path if len(path) <= LONG_PATH else f"#{xxhash.xxh3_128_hexdigest(path)}"


def parse(page: str) -> tuple[list[tuple[str, tuple[str, ...], bool, str]], list[str], str]:
    """Text blocks (path, paths of the zones around it, in the article, text), the roles of the tags, in page order, and the layout.

    The empty path stands for a zone whatever the template says. The layout is the roles of the
    body and of the first article or main element.
    """
    blocks: list[tuple[str, tuple[str, ...], bool, str]] = []
    roles: list[str] = []
    marks: dict[str, str] = {}
    stack: list[tuple[str, str, tuple[str, ...], bool]] = [("", "", (), False)]
    text: list[str] = []

    def close_block() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                blocks.append((stack[-1][1], stack[-1][2], stack[-1][3], words))
            text.clear()

    def pop(at: int) -> None:
        if any(x[0] in BLOCKS for x in stack[at:]):
            close_block()
        del stack[at:]

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            text.append(page[last : m.start()])
        last = m.end()
        tag = m[0]
        if m[1] or tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                text.append(entities.escape(tag[9:].removesuffix("]]>")))
            elif m[1]:
                text.append(" ")
            continue
        found = _NAME.search(tag)
        if found is None:
            continue
        name = found[0].lower()
        if name in SPACES:
            text.append(" ")
        if tag[1] == "/":
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if at:
                pop(at)
            elif name in BLOCKS:
                close_block()
            continue
        if name in CLOSES_P or name == "li":
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in BLOCKS), 0)
            if at and (stack[at][0] == "p" or stack[at][0] == name == "li"):
                pop(at)
            close_block()
        given = attributes(tag[found.end() :])
        _, path, zone, article = stack[-1]
        article = article or name in ("article", "main")
        kind = "".join(f"{k[0]}:{given[k]}" for k in ("class", "id", "role") if given.get(k))
        path = _short(f"{path}/{name}{kind}")
        roles.append(path)
        if name in ("body", "article", "main"):
            marks.setdefault("body" if name == "body" else "article", path)
        if name not in VOID and not tag.endswith("/>"):
            sure = is_zone(name, given, article)
            stack.append((name, path, (*zone, path if sure == 1 else "") if sure else zone, article))
    text.append(page[last:])
    close_block()
    return blocks, roles, f"{marks.get('body', '')}\x00{marks.get('article', '')}"


def _role(path: str, text: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\x00{text}") - (1 << 63)


def page_tokens(page: str) -> tuple[dict[int, int], int]:
    """How often each token role occurs in a page, and the page's layout."""
    blocks, roles, layout = parse(page)
    counts: dict[int, int] = {}
    for r in [_role(p) for p in roles] + [_role(p, t) for p, _, _, t in blocks]:
        counts[r] = counts.get(r, 0) + 1
    return counts, _role(layout)


def extract(page: str, template: set[int] | dict[int, list[int]]) -> str:
    """Blocks of a page that stand in the template's slots for the article, joined by empty lines.

    ``template``: that of the page's layout, or those of its host by layout. Where a page has an
    article or main element, its slots are those inside. An article of nothing but template text
    is one of a group of copies, and stays.
    """
    blocks, _, layout = parse(page)
    if isinstance(template, dict):
        template = set(template.get(_role(layout), ()))
    open_ = [(article, text, _role(path, text) in template) for path, zones, article, text in blocks if not any(not z or not template or _role(z) in template for z in zones)]
    marked = any(article for article, _, _ in open_)
    slots = [(text, known) for article, text, known in open_ if article or not marked]
    copied = marked and all(known for _, known in slots)
    return "\n\n".join(text for text, known in slots if copied or not known)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, layout, role, level): the roles of each layout's valid equivalence classes; level 0 is the outermost class."""

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, layouts, roles, marks = [], [], [], []
            for host, page in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass"))
                counts, layout = page_tokens(page)
                for role, n in (counts | {PAGE: 1}).items():
                    hosts.append(host)
                    layouts.append(layout)
                    roles.append(role)
                    marks.append((key * (2 * n + 1) ^ n * 0x9E3779B97F4A7C15) & (1 << 62) - 1)
            arrays = [pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(roles, pa.int64()), pa.array(np.array(marks, np.int64), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["host", "layout", "role", "mark"])

        return step

    tokens = map_slices(pages, kernel, "host string, layout long, role long, mark long")
    of = ["host", "layout"]
    halves = (F.pmod("mark", F.lit(1 << 31)), F.shiftright("mark", 31))  # sums of 2^32 such marks fit a long
    vectors = tokens.groupBy(*of, "role").agg(F.count("*").alias("support"), F.struct(*(F.sum(x).alias(f"v{i}") for i, x in enumerate(halves))).alias("vector"))
    sizes = vectors.where(F.col("role") == PAGE).select(*of, F.col("support").alias("pages"))
    vectors = vectors.where(F.col("role") != PAGE)
    classes = vectors.groupBy(*of, "support", "vector").agg(F.count("*").alias("tokens"))
    valid = classes.join(sizes, of).where((F.col("support") >= F.greatest(F.lit(MIN_PAGES), F.col("pages") * MIN_SHARE)) & (F.col("tokens") >= MIN_TOKENS))
    nested = valid.select(*of, "support", "vector", (F.dense_rank().over(Window.partitionBy(*of).orderBy(F.desc("support"))) - 1).alias("level"))
    return vectors.join(nested, [*of, "support", "vector"]).select(*of, "role", "level")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text.

    Null or empty html gives an empty text; pages without a host share the empty one; null ids
    and urls stay null; repeated rows each get their row; an empty table gives an empty result;
    other columns are ignored. Pages are parsed whole.
    """
    hosted = _hosted(pages)
    found = Spool(pages.sparkSession).save(templates(hosted), "templates")
    small = found.count() <= BROADCAST_ROLES
    by_layout = found.groupBy("host", "layout").agg(F.sort_array(F.collect_list("role")).alias("roles"))
    by_host = by_layout.groupBy("host").agg(F.collect_list(F.struct("layout", "roles")).alias("template"))
    joined = hosted.join(F.broadcast(by_host) if small else by_host, "host", "left").select("page_id", "url", "html", "template")

    def kernel():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(page, {x["layout"]: x["roles"] for x in given or ()}) for page, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        return step

    return map_slices(joined, kernel, "page_id long, url string, text string")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLE_SQL: dict[str, str] = {}
