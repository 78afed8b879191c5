"""Main text of web pages: elements of page furniture and subtrees that recur on a host are deleted."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from .common import materialize

#: A subtree is a template where it recurs on so many different pages of its host, and on this share of them ...
MIN_PAGES, MIN_SHARE = 5, 0.25
#: ... or, a container, on so many pages, however large the host is.
MANY_PAGES = 20
#: Inside an article, templates go if at least this share of its characters stays.
ARTICLE_REST = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements without any text of the page.
HARD = frozenset("head script style noscript template iframe button select textarea svg canvas object audio video map datalist title".split())
#: Elements that are page furniture unless they hold the article.
SOFT = frozenset("nav footer aside form menu dialog".split())
HEAD = frozenset("title meta link base style script noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that close an open element of the given names, if no container lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table td th article section div aside body main".split())
#: An end tag closes nothing outside these.
BOUNDS = frozenset("article main body".split())
#: Text of these inside an article is the article's own, however often it recurs.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th b i em strong a span code sup sub br u small mark".split())
#: Lists, tables and figures of an article are its own too, unless they hold links or forms.
LISTS = frozenset("ul ol li dl table caption thead tbody tfoot tr figure figcaption".split())
LINKS = frozenset("a form input button select textarea iframe".split())
#: A container in which so many links hold this share of the text is a list of links, in an article too.
LINK_SHARE, LEAST_LINKS = 0.8, 2
#: Containers that can be such a list.
CONTAINERS = frozenset("div section ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These are never furniture inside an article, whatever their attributes say.
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 blockquote pre code b i em strong sub sup u small mark".split())
#: Single lines, items and rows of any text can recur by chance: for these the share decides alone.
ITEMS = TEXTUAL | frozenset("li tr caption figcaption summary".split())
#: Words that mark the roles which a page's main text lacks: menus, footers, sidebars, notices, adverts, forms, comments.
ARTICLE_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox sponsor sponsors sponsored promo cookie cookies consent gdpr notice"
    " notices popup modal overlay sidebar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments disqus replies"
    " respond share sharing social newsletter subscribe subscription signup login pagination pager".split()
)
#: Outside an article also other lists of links and the head of the page.
MARKS = ARTICLE_MARKS | frozenset("banner masthead related recommended search contentinfo complementary skip widget toolbar topbar".split())
#: A paragraph of an article with these can be the article's own remark.
NOTICE_MARKS = frozenset("notice notices".split())
COMMENT_MARKS = frozenset("comment comments reply replies".split())
ROLES = frozenset("navigation menu menubar banner contentinfo complementary search form dialog alertdialog".split())
#: Words that say nothing: a name is a mark where it has a word of the marks and else only these.
NEUTRAL = frozenset(
    "site main page top bottom left right box bar wrapper wrap container area list section block panel inner outer slot unit item items row"
    " col column group text link links button buttons icon icons field header head title body layer message msg alert policy law eu global"
    " primary secondary mobile desktop small large big mini fixed sticky trail post blog js".split()
)
#: And those beside which the word header names the head of the page, outside an article.
HEADS = frozenset("site page main global top mobile sticky fixed wrapper wrap container inner outer bar header".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TAG_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
WORDS = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*)")


@dataclass
class Node:
    """``level``: 1 in a main element, 2 in an article. ``outer``: text of the line around furniture."""

    tag: str
    level: int
    hard: bool
    soft: bool
    literal: bool
    first_block: int
    first_node: int
    outer: list[str] | None = None
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link_chars: int = 0
    own_chars: int = 0
    holds: int = 0
    titled: bool = False
    headed: bool = False


@dataclass
class Page:
    """``blocks``: (text, level); ``nodes``: (hash, odd for one of ITEMS, first block, end), those that can be templates."""

    blocks: list[tuple[str, int]]
    nodes: list[tuple[int, int, int]]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page: kinds are text, start, end. Linear in its length."""
    at, n, strict = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = page[lt + 1 : lt + 2] == "/"
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            yield "text", "<", ""
            at = lt + 1
            continue
        m = TAG_END.match(page, name.end()) if strict else None
        if m:
            end = m.end()
        else:  # a quote never ends: from here on the next > ends a tag
            strict = False
            end = page.find(">", name.end()) + 1 or n
        tag = name.group().lower()
        yield ("end" if closing else "start"), tag, page[name.end() : end - 1]
        at = end
        if not closing and tag in RAW:
            close = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = close.start() if close else n


@lru_cache(maxsize=20_000)
def named(value: str, marks: frozenset[str]) -> bool:
    """Whether a token of a class or id consists of words of the marks, and else of neutral ones.

    Words end at other characters than letters and before capitals; a word may be two run together.
    """

    def is_mark(w: str) -> bool:
        return w in marks or any(
            (w[:i] in marks and (w[i:] in NEUTRAL or w[i:] in marks)) or (w[:i] in NEUTRAL and w[i:] in marks) for i in range(2, len(w) - 1)
        )

    for token in value.split():
        words = [w.lower() for w in WORDS.findall(token)]
        found = [is_mark(w) for w in words]
        if any(found) and all(m or w in NEUTRAL for m, w in zip(found, words)):
            return True
    return False


@lru_cache(maxsize=20_000)
def _attributes(text: str) -> tuple[str, str, bool]:
    """(class and id, role, hidden) of a start tag."""
    names, role, hidden = [], "", False
    for m in ATTRIBUTE.finditer(text):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name in ("class", "id"):
            names.append(value)
        elif name == "role":
            role = value.lower()
        elif name == "hidden" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            hidden = True
    return " ".join(names), role, hidden


def is_furniture(tag: str, attributes: str, level: int, literal: bool = False) -> bool:
    """Whether an element has a role of page furniture by its name, or by its attributes.

    ``level`` is that of its parent; ``literal``: it lies in preformatted text.
    """
    if tag in SOFT or tag == "header" and level < 2:
        return True
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False
    names, role, hidden = _attributes(attributes)
    if tag == "article":
        return hidden or named(names, COMMENT_MARKS)
    if level == 2 and (literal or tag in PLAIN):
        return False
    if hidden or not ROLES.isdisjoint(role.split()):
        return True
    if named(names, (ARTICLE_MARKS - NOTICE_MARKS if tag == "p" else ARTICLE_MARKS) if level == 2 else MARKS):
        return True
    return not level and any(
        "header" in words and HEADS.issuperset(words) for words in ({w.lower() for w in WORDS.findall(t)} for t in names.split())
    )


def _hash(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def parse(page: str) -> Page:
    """Blocks outside page furniture, and every element subtree that holds some. Linear in the page's length.

    Furniture that holds an article counts as such only where the page has an article outside it; a
    form that holds a first heading is a wrapper, no form. Containers inside an article whose text is mostly
    links are furniture. Where nothing else is left, the furniture
    with a heading and most text besides links comes back.
    """
    root = Node("#", 0, False, False, False, 0, 0)
    stack, blocks, nodes, text = [root], [], [], []
    open_at: dict[str, list[int]] = {}
    bounds: list[int] = []
    rescued: list[tuple[int, int]] = []
    removed: tuple[int, list[tuple[str, int]]] = (0, [])

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                blocks.append((joined, stack[-1].level))

    def push(tag: str, attributes: str) -> None:
        nonlocal text
        top = stack[-1]
        soft = not top.hard and is_furniture(tag, attributes, top.level, top.literal)
        level = top.level if soft and tag == "article" else max(top.level, {"article": 2, "main": 1}.get(tag, 0))
        node = Node(tag, level, top.hard or tag in HARD, soft, top.literal or tag in ("pre", "code"), len(blocks), len(nodes))
        if soft:
            node.outer, text = text, []
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BOUNDS:
            bounds.append(len(stack))
        stack.append(node)

    def pop() -> None:
        nonlocal text, removed
        if stack[-1].tag in BLOCKS:
            flush()
        node = stack.pop()
        open_at[node.tag].pop()
        if node.tag in BOUNDS:
            bounds.pop()
        h = _hash(f"{node.tag}({'|'.join(node.parts)})")
        top = stack[-1]
        top.parts.append(str(h))
        if node.tag == "a":
            node.linked, node.link_chars = 1, node.own_chars
        top.linked += node.linked or node.tag in LINKS
        top.link_chars += node.link_chars
        top.own_chars += node.own_chars
        top.headed |= node.headed or node.tag in HEADINGS
        own = node.own_chars - node.link_chars
        if node.level == 2 and node.tag in CONTAINERS and not node.holds and not node.soft and not node.hard:
            if node.linked >= LEAST_LINKS and node.link_chars >= LINK_SHARE * node.own_chars:
                del blocks[node.first_block :], nodes[node.first_node :]
                return
        if node.soft:
            wraps = node.holds > top.level or node.titled and node.tag == "form"
            if not wraps:  # furniture: its blocks and subtrees go
                if node.headed and own > max(removed[0], node.link_chars) and node.tag not in ("nav", "menu", "footer", "header"):
                    removed = (own, blocks[node.first_block :])
                del blocks[node.first_block :], nodes[node.first_node :]
                text = node.outer
                return
            if node.holds > top.level:
                rescued.append((node.first_block, len(blocks)))
            text = node.outer + text
        top.holds = max(top.holds, node.holds, {"article": 2, "main": 1}.get(node.tag, 0))
        top.titled |= node.titled or node.tag == "h1"
        if len(blocks) > node.first_block:
            whole = node.holds > 0 or node.tag in ("html", "body", "article", "main")
            its_own = node.tag in TEXTUAL or node.tag in LISTS and not node.linked
            if not whole and not (node.level == 2 and its_own):
                nodes.append((h & ~1 | (node.tag in ITEMS), node.first_block, len(blocks)))

    for kind, value, attributes in tokens(page):
        top = stack[-1]
        if kind == "text":
            if value.strip():
                top.parts.append(value.strip())
                top.own_chars += 0 if top.hard else len(value.strip())
            if not top.hard:
                text.append(_html.unescape(value))
        elif kind == "start":
            if value == "br":
                text.append(" ")
                continue
            if value not in HEAD and open_at.get("head") and value != "head":
                while open_at["head"]:
                    pop()
            if value in BLOCKS:
                flush()
                if any(n.tag == "p" for n in stack[-8:]):
                    while stack[-1].tag == "p" or any(n.tag == "p" for n in stack[-8:]) and stack[-1].tag not in SCOPES:
                        done = stack[-1].tag == "p"
                        pop()
                        if done:
                            break
            for name in CLOSES.get(value, ()):
                for depth in range(1, min(len(stack), 16)):
                    if stack[-depth].tag == name:
                        for _ in range(depth):
                            pop()
                        break
                    if stack[-depth].tag in SCOPES - {name}:
                        break
            if value in VOID:
                continue
            push(value, attributes)
            if attributes.endswith("/") and value in ("svg", "path"):
                pop()
        else:
            if value in BLOCKS:
                flush()
            at = open_at.get(value)
            if at and (value in BOUNDS or value == "html" or not bounds or bounds[-1] < at[-1]):
                last = at[-1]
                while len(stack) > last:
                    pop()
    flush()
    while len(stack) > 1:
        pop()
    flush()
    if not blocks:
        blocks = [(t, 0) for t, _ in removed[1]]
    if rescued:
        inside = [0] * (len(blocks) + 1)
        for a, z in rescued:
            inside[a] += 1
            inside[z] -= 1
        inside = list(accumulate(inside))
        if any(level and not i for (_, level), i in zip(blocks, inside)):
            blocks = [(t, 0) if i else (t, level) for (t, level), i in zip(blocks, inside)]
    return Page(blocks, nodes)


def main_text(blocks: list[str], levels: list[int], nodes: list[tuple[int, int, int]], templates: set[int]) -> str:
    """Blocks of the article (of the page, where it has none), less those in a template subtree.

    Templates stay inside an article if less than ``ARTICLE_REST`` of its characters would be left, and
    everywhere if nothing would be: such a page is a copy.
    """
    in_article = any(levels)
    mine = [level > 0 for level in levels] if in_article else [True] * len(levels)
    edges = [0] * (len(blocks) + 1)
    for h, first, end in nodes:
        if h in templates:
            edges[first] += 1
            edges[end] -= 1
    gone = [n > 0 for n in accumulate(edges)][: len(blocks)]
    of_all = sum(len(t) for t, m in zip(blocks, mine) if m)
    rest = sum(len(t) for t, m, g in zip(blocks, mine, gone) if m and not g)
    if rest < of_all * ARTICLE_REST and in_article or not rest:
        gone = [False] * len(blocks)
    return "\n".join(t for t, m, g in zip(blocks, mine, gone) if m and not g)


def page_text(page: str, templates: frozenset[int] = frozenset()) -> str:
    """Main text of one page, given the templates of its host."""
    found = parse(page)
    return main_text([t for t, _ in found.blocks], [level for _, level in found.blocks], found.nodes, templates)


def host_of(url_col: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_key(url_col: str, html_col: str) -> F.Column:
    """Pages of equal address host and content are one page where pages are counted."""
    return F.xxhash64(host_of(url_col), html_col)


def parsed_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``__key, __host``, the blocks (``__text, __size``: a compressed line
    each, ``__level``) and the subtrees that can be templates (``__subtree, __first, __end``) of each:
    pages are parsed once."""
    kept = [f for f in pages.schema.fields if f.name != html_col]
    kinds = [pa.binary(), pa.int64(), *(pa.list_(k) for k in (pa.int8(), pa.int64(), pa.int32(), pa.int32()))]
    lists = {"__level": ByteType(), "__subtree": LongType(), "__first": IntegerType(), "__end": IntegerType()}
    schema = StructType([*kept, StructField("__key", LongType()), StructField("__host", StringType()), StructField("__text", BinaryType())])
    schema = StructType([*schema.fields, StructField("__size", LongType()), *(StructField(n, ArrayType(k)) for n, k in lists.items())])
    rows = pages.select(*(F.col(f.name) for f in kept), page_key(url_col, html_col).alias("__key"), host_of(url_col).alias("__host"), F.col(html_col).alias("__html"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [parse(h or "") for h in part.column(part.num_columns - 1).to_pylist()]
                texts = ["\n".join(t for t, _ in p.blocks).encode("utf-8", "replace") for p in found]  # no block holds a newline
                columns = [[pa.compress(t, "zstd", asbytes=True) for t in texts], [len(t) for t in texts]]
                columns += [[[level for _, level in p.blocks] for p in found], *([[n[k] for n in p.nodes] for p in found] for k in range(3))]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], schema.names)

    return rows.mapInArrow(apply, schema)


def template_subtrees(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """``host, subtree``: subtrees that recur on enough different pages of a host."""
    on_host = parsed.select("__key", "__host").distinct().groupBy("__host").agg(F.count("*").alias("host_pages"))
    each = parsed.select("__key", "__host", F.explode("__subtree").alias("subtree")).distinct()
    enough = (F.col("n") >= min_share * F.col("host_pages")) | (F.col("n") >= many_pages) & (F.col("subtree").bitwiseAND(1) == 0)
    often = each.groupBy("__host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).join(on_host, "__host")
    return often.where(enough).select(F.col("__host").alias("host"), "subtree")


def extract_text(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    many_pages: int = MANY_PAGES,
) -> DataFrame:
    """``pages`` without its html, with ``text`` (blocks joined by newlines) and ``n_chars``.

    Menus, headers, footers, sidebars, notices, adverts, forms and comments go by element name, role
    and whole names of class and id, but never what alone holds the article. Then subtrees that recur
    on at least ``min_pages`` different pages and ``min_share`` of the pages of a host go, and
    containers that recur on ``many_pages``, whatever their share and whatever they are called; the
    article itself, its paragraphs and headings stay, and a page of nothing but templates keeps its
    text. A null or empty page gives an empty text; a null address has an empty host; input columns
    named text and n_chars are replaced; repeated rows all stay, and count as one page.
    """
    pages = pages.drop("text", "n_chars")
    parsed = materialize(parsed_pages(pages, url_col, html_col), "pages-parsed")
    often = materialize(template_subtrees(parsed, min_pages, min_share, many_pages), "page-templates")
    each = parsed.select("__key", F.col("__host").alias("host"), F.explode("__subtree").alias("subtree")).distinct()
    gone = each.join(often, ["host", "subtree"]).groupBy("__key").agg(F.collect_list("subtree").alias("__gone"))
    joined = parsed.join(gone, "__key", "left")
    kept = [f for f in pages.schema.fields if f.name != html_col]
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                columns = [c.to_pylist() for c in part.columns[len(kept) :]]
                texts = []
                for t, size, level, h, a, z, gone in zip(*columns):
                    lines = pa.decompress(t, size, "zstd", asbytes=True).decode().split("\n") if level else []
                    texts.append(main_text(lines, level, list(zip(h, a, z)), set(gone or ())))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names
                )

    return joined.select(*(f.name for f in kept), "__text", "__size", "__level", "__subtree", "__first", "__end", "__gone").mapInArrow(apply, schema)
