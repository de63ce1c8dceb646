"""HTML extraction by site template removal (operator 8).

Every page is parsed into its element tree, and the subtrees of its elements are hashed twice: exactly
(tag, names, text), and by shape (the tags and names above it, and its own tags and names with text masked
and equal neighbours taken as one), so that a menu is known again whatever it says. A first pass hands the
hashes on; Spark counts on how many different pages (by what their main part says) of a host each occurs. A
second pass deletes the subtrees whose hash stands on many pages of the host and returns the blocks of text
that are left. Scripts, styles, forms and the like, and what by its tag or class is a menu, header, footer,
sidebar, notice, advert or comment, go too: that covers hosts with too few pages to tell. Where templates
told nothing on a page, its article (or main) elements are taken, if it has any.

Shapes count only beside the way to the main part: from the page down, as long as one container holds half
the words or more of what it stands in, but not into an article or main element. Inside these, boxes (div,
section, ...) count by their exact hash: a sentence or heading that articles share stays. Copies of one
article count as one page, so copied articles stay. A subtree is template from LEAST_PAGES different pages
of a host on if that is SHARE of them, or from MANY_PAGES on whatever the share; hosts with fewer pages than
LEAST_PAGES have no template.

Defined cases: a null or empty html gives the empty text; unclosed, crossed and stray tags are
repaired as far as needed for block structure; markup cut off at the end of a page is dropped; a
null or odd url belongs to the host with the empty name; repeated rows give equal rows and count once
for templates; a share of SHARE exactly is enough; white space is what str.split() splits at; a page is
parsed whole, with its tree in memory; columns of any other name stay as they are, whatever they are
called, but one called text is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, materialise, texts_of

#: A subtree is template when it stands on this share of the different pages of its host and on this many of
#: them, or on so many that the share does not matter.
SHARE, LEAST_PAGES, MANY_PAGES = 0.2, 5, 1_000
#: Most template rows that are broadcast; beyond that they are joined by host.
BROADCAST_ROWS = 500_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("nav footer aside form script style noscript template iframe svg button select textarea dialog head title object canvas menu input option label fieldset noembed noframes".split())
_SILENT = frozenset("script style noscript template head title iframe noembed noframes textarea select".split())
_BOX = frozenset("div section aside nav header footer form ul ol table dl figure details".split())
_MAIN = frozenset(("article", "main"))
_HOLDS = _BOX | _MAIN | frozenset("html body center tbody thead tfoot tr td th dd fieldset".split())
_INLINE = frozenset("b i u s em strong small big span font mark sub sup code abbr cite q tt kbd samp var ins del strike bdo bdi br wbr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended recommendations widget comment comments disqus respond reply replies pagination pager skip".split()
)


class Node:
    __slots__ = ("tag", "marks", "items", "digest", "shape", "words", "heading")

    def __init__(self, tag: str, marks: frozenset[str]):
        self.tag, self.marks = tag, marks
        self.items: list[Node | str] = []
        self.digest = self.shape = self.words = 0
        self.heading = tag == "h1"


def _marks(attrs: str) -> frozenset[str]:
    if not attrs or "=" not in attrs:
        return frozenset()
    return frozenset(p for _, v in _ATTR.findall(attrs) for p in _PART.findall(v.lower()))


def parse(text: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", frozenset())
    stack, at, n = [root], 0, len(text)
    for_token = _TOKEN.search
    while at < n:
        m = for_token(text, at)
        if not m:
            stack[-1].items.append(text[at:])
            break
        if m.start() > at:
            stack[-1].items.append(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if any(x.tag == tag for x in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in _BLOCK:
            _close(stack, ("p",), _BLOCK - {"p"})  # a block ends an open paragraph
        if tag in _CLOSES:
            _close(stack, _CLOSES[tag], _SCOPE[tag])
        attrs = m[3] if m[3] is not None else m[6] or ""
        node = Node(tag, _marks(attrs))
        stack[-1].items.append(node)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK | _RAW:
            continue
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(text, at)
            node.items.append(text[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], tags: tuple[str, ...], scope) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scope:
            return


def digest(root: Node) -> None:
    """Set of every subtree the digest (tag, marks, text with white space folded, and children), the shape (the
    same with text masked, without inline markup, equal neighbours as one) and the number of words."""
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo.extend((x, False) for x in node.items if isinstance(x, Node))
            continue
        name = f"{node.tag} {' '.join(sorted(node.marks))}\x00".encode()
        exact, shape, last = xxhash.xxh64(name), xxhash.xxh64(name), b""
        silent = node.tag in _SILENT
        for x in node.items:
            if isinstance(x, Node):
                exact.update(x.digest.to_bytes(8, "little"))
                part = b"\x01" if x.tag in _INLINE else x.shape.to_bytes(8, "little")
                node.words += 0 if silent else x.words
                node.heading |= x.heading
            else:
                words = x.encode("utf-8", "replace").split()
                exact.update(b" ".join(words) + b"\x01")
                part = b"\x01" if words else last
                node.words += 0 if silent else len(words)
            if part != last:
                shape.update(part)
                last = part
        node.digest, node.shape = exact.intdigest(), shape.intdigest()


def _under(path: int, node: Node) -> int:
    """The path (a number for the tags and marks from the page down) of what stands in node."""
    return xxhash.xxh64_intdigest(f"{path:x} {node.tag} {' '.join(sorted(node.marks))}")


def _by_shape(path: int, node: Node) -> int:
    return xxhash.xxh64_intdigest(f"{path:x} {node.shape:x}")


def _shaped(node: Node) -> bool:
    """Whether a subtree outside the main parts can be template by its shape."""
    return node.tag in _BOX and not (node.heading and node.tag not in ("nav", "aside", "footer", "form"))


def beside_the_way(root: Node) -> Iterator[int]:
    """Shapes of the boxes beside the way from the page to its main part."""
    node, path = root, 0
    while node.tag not in _MAIN:
        inside = [x for x in node.items if isinstance(x, Node)]
        big = next((x for x in inside if x.tag in _HOLDS and x.words and 2 * x.words >= node.words), None)
        if big is None:
            return
        path = _under(path, node)
        yield from (_by_shape(path, x) for x in inside if x is not big and _shaped(x))
        node = big


def _dropped(node: Node, inside: bool) -> bool:
    tag = node.tag
    if tag in _DROP or tag == "header" and not (inside and any(isinstance(x, Node) and x.tag in ("h1", "h2", "hgroup") for x in node.items)):
        return True
    return bool(node.marks & _MARKS) and tag not in ("html", "body", "article", "main", "h1", "#root")


def mains(root: Node) -> list[Node]:
    """The article elements, else the main ones, else the page; none inside another or in what goes."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, frozenset())]
    while todo:
        node, above = todo.pop()
        if node.tag in found and node.tag not in above:
            found[node.tag].append(node)
        todo.extend((x, above | {node.tag}) for x in reversed(node.items) if isinstance(x, Node) and not _dropped(x, bool(above & {"article", "main"})))
    return found["article"] or found["main"] or [root]


def candidates(root: Node) -> tuple[int, set[int]]:
    """(digest of what the main parts say, hashes of the subtrees that may be template)."""
    digest(root)
    parts = mains(root)
    chosen = set(map(id, parts))
    say = xxhash.xxh64(b"".join(p.digest.to_bytes(8, "little") for p in parts)).intdigest()
    holds: set[int] = set()  # what a main part stands in can't be template

    out = set(beside_the_way(root))
    whole = parts == [root]
    if not whole:
        todo = [(root, ())]
        while todo:
            node, above = todo.pop()
            if id(node) in chosen:
                holds.update(map(id, (*above, node)))
                continue
            todo.extend((x, (*above, node)) for x in node.items if isinstance(x, Node))
    todo = [(root, whole)]
    while todo:
        node, inside = todo.pop()
        inside = inside or id(node) in chosen
        if id(node) not in holds and node.tag not in ("#root", "html", "body", "article", "main") and (node.tag in _BOX or not (inside and not whole) and node.tag in _BLOCK):
            out.add(node.digest)
        todo.extend((x, inside) for x in node.items if isinstance(x, Node))
    return say, out


def extract(root: Node, template: set[int]) -> tuple[str, bool]:
    """(the text of the page without template and what is no article text; whether templates told its main part)."""
    digest(root)
    blocks, told = _left(root, template)
    if not told and (parts := mains(root)) != [root]:
        blocks = [x for p in parts for x in _left(p, template, inside=True)[0]]
    return "\n\n".join(blocks), told


def _left(root: Node, template: set[int], inside: bool = False) -> tuple[list[str], bool]:
    """(blocks of text left in the subtree of root; whether template outside the main parts was deleted)."""
    blocks: list[str] = []
    line: list[str] = []
    told = False
    without_main = not inside and mains(root) == [root]

    def end() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    todo: list = [(root, 0, inside, True)]
    while todo:
        x, path, inside, first = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(html_lib.unescape(x) if "&" in x else x)
        elif x.tag in ("br", "wbr", "img"):
            line.append(" " if x.tag != "wbr" else "")
        else:
            if not first:
                known = x.tag not in ("html", "body", "article", "main") and (
                    (x.tag in _BOX or without_main and x.tag in _BLOCK) and x.digest in template
                    or not inside and _shaped(x) and _by_shape(path, x) in template
                )
                told |= known and not inside
                if known or _dropped(x, inside):
                    if x.tag in _BLOCK:
                        end()
                    continue
            if x.tag in _BLOCK:
                end()
                todo.append((None, 0, inside, False))
            inside = inside or x.tag in _MAIN
            path = 0 if inside else _under(path, x)
            todo.extend((y, path, inside, False) for y in reversed(x.items))
    end()
    return blocks, told


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES, many: int = MANY_PAGES) -> DataFrame:
    """host, digest of its recurring subtrees; per host at most the subtrees of a page / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, say, got = [], [], []
            for host, text in zip(texts_of(b.column(0)).to_pylist(), texts_of(b.column(1)).to_pylist(), strict=True):
                key, found = candidates(parse(text))
                for d in (0, *found):  # 0 stands for the page
                    hosts.append(host)
                    say.append(key)
                    got.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(say, pa.uint64()).view(pa.int64()), pa.array(got, pa.uint64()).view(pa.int64())], names=["host", "say", "digest"])

    found = mapped(pages.select("host", "html"), run, "host string, say long, digest long").distinct()
    counts = materialise(found.groupBy("host", "digest").count().where(F.col("count") >= least), "subtree-counts")
    n = counts.where("digest = 0").select(F.col("host").alias("h"), F.col("count").alias("pages"))
    often = counts.where("digest <> 0").join(n, F.col("host") == F.col("h")).where((F.col("count") >= share * F.col("pages")) | (F.col("count") >= many))
    out = materialise(often.select("host", "digest"), "templates")
    discard(counts)
    return out


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = LEAST_PAGES, many: int = MANY_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of pages with their main text in place of the html, as column text; by_template: whether
    templates told it."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    keep = [c for c in pages.columns if c not in (html_col, "text", "by_template")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(html_col).alias("html"), host.alias("host"))
    known = templates(rows, share, least, many)
    shared = None
    if known.count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for r in known.collect():  # broadcast_rows rows at most
            by_host.setdefault(r["host"], set()).add(r["digest"] & 0xFFFFFFFFFFFFFFFF)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
    else:
        lists = known.groupBy(F.col("host").alias("t_host")).agg(F.collect_list("digest").alias("template"))
        rows = rows.join(lists, F.col("host") == F.col("t_host"), "left").select("row", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, t in zip(texts_of(b.column(1)).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = shared.value.get(t, set()) if shared is not None else {d & 0xFFFFFFFFFFFFFFFF for d in t or ()}
                out.append(extract(parse(text), found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.bool_())], names=["row", "text", "told"])

    out = mapped(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, text string, told boolean")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("text"), F.col("told").alias("by_template"))


def op8(spark, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "by_template")
