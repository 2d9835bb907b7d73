"""Operator 10: main text of web pages by wrapper induction.

Every page is read into a small tree of blocks and aligned with the reference page of its
host (that with the smallest id) by simple tree matching: roots of one tag match, and
their children by the order-keeping assignment that matches most nodes, and of these most equal texts. Each distinct
content but the reference's own votes on the reference's text slots: the same text, or another. Slots
whose text stays the same are the host's template, and blocks that match them with that text are dropped;
varying slots, blocks with another text, and blocks that match none, are content. What varies but is no
article (menus, headers, footers, sidebars, notices, adverts, forms, comments) goes by its
tag or by a whole name in its class, id or role, unless it holds the page's only article or main part or most of its
text; where a page marks its article or main part, only that counts.

Pages that share less than half of their tag skeleton with the reference do not vote on it; they meet a second
reference, the first page of the host with their own skeleton, and what is template by either goes.

Counts combine on the map side, and pages meet their host's reference and template by
joins on the host that Spark can split; no host's pages come together in one task.

Defined cases: null and empty pages have an empty text; pages without a host are
read by tags and names alone, as are hosts with fewer than three distinct pages besides the reference; repeated rows are pages
of their own; broken markup is read as far as it goes; children beyond a million
combinations are aligned greedily in order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

MIN_VOTES = 3
TEMPLATE_SHARE = 0.6            # votes for "the same text" that make a slot template
MOST_CELLS = 1_000_000          # weights of child pairs held at once
NODE = 1 << 31                  # weight of a matched node; an equal text adds one

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img picture".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button select option textarea dialog menu template svg math object "
                             "canvas audio video script style noscript iframe".split())
BOILERPLATE_NAMES = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts banner promo "
                              "sponsor sponsored notice notices cookie cookies consent comment comments reply replies disqus "
                              "related share sharing social breadcrumb breadcrumbs newsletter subscribe signup login popup modal "
                              "widget toolbar pagination pager copyright complementary contentinfo search alert hidden "
                              # real compounds; else only whole names count, so has-sidebar or no-ads is none
                              "nav-bar nav-menu main-nav main-menu site-nav top-nav side-bar site-header site-footer page-footer ad-banner "
                              "ad-container ad-slot ad-unit cookie-banner cookie-notice cookie-consent social-share share-buttons "
                              "related-posts related-articles newsletter-signup search-form search-box comment-list comments-area "
                              "comment-section comment-body".split())
COMMENT_NAMES = frozenset("comment comments reply replies disqus comment-list comments-area comment-section comment-body".split())
UNSEEN_TAGS = frozenset("head button select option textarea dialog template svg math object canvas audio video script style noscript "
                        "iframe".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}

_TOKEN = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|=|$)|aria-hidden\s*=\s*["']?true)""", re.I)


class Node:
    __slots__ = ("tag", "names", "children", "text", "slot", "drop")

    def __init__(self, tag: str, names: frozenset = frozenset(), text: str = "", drop: bool = False):
        self.tag, self.names, self.text, self.drop = tag, names, text, drop
        self.children: list[Node] = []
        self.slot = -1


def _names(attrs: str) -> frozenset:
    if "=" not in attrs and "hidden" not in attrs:
        return frozenset()
    found = {p for m in _NAMES.finditer(attrs) for p in (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split()}
    if "hidden" in attrs and _HIDDEN.search(attrs):
        found.add("hidden")
    else:
        found.discard("hidden")
    return frozenset(found)


def _boilerplate(tag: str, names: frozenset) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return not names.isdisjoint(COMMENT_NAMES)
    return tag in BOILERPLATE_TAGS or not names.isdisjoint(BOILERPLATE_NAMES)


def parse(page: str) -> Node:
    """Tree of block elements; text leaves have the tag ``#``; white space is one space."""
    root = Node("#root")
    stack, text = [root], []

    def flush() -> None:
        own = " ".join(_html.unescape("".join(text)).split())
        text.clear()
        if own:
            stack[-1].children.append(Node("#", text=own))

    raw_until, at, size = "", 0, len(page)
    while at < size:
        if raw_until:           # the content of scripts and the like is no markup
            m = re.compile(rf"</{raw_until}(?=[\s/>])", re.I).search(page, at)
            at = m.start() if m else size
            raw_until = ""
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[7] is not None:
            text.append(m[7])
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in INLINE and not any(n.tag == tag for n in stack):
                continue
            if any(n.tag == tag for n in stack):
                flush()
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag == "br":
            text.append(" ")
            continue
        names = _names(attrs)
        drop = _boilerplate(tag, names)
        if tag in INLINE and not drop:
            continue
        flush()
        if tag not in INLINE:
            if stack[-1].tag == "p":
                stack.pop()
            closes = CLOSES.get(tag, ())
            if stack[-1].tag in closes:
                stack.pop()
                if stack[-1].tag in closes:
                    stack.pop()
        if tag in VOID:
            continue
        node = Node(tag, names, drop=drop)
        stack[-1].children.append(node)
        if tag in RAW:
            raw_until = re.escape(tag)
        if not attrs.endswith("/") or tag in RAW:
            stack.append(node)
    flush()
    _reopen(root)
    return root


def _reopen(root: Node) -> None:
    """Clear the drop marks above the article: where no article or main part lies outside all dropped parts, of those
    that hold one, or else of one dropped for its name only that holds most of the page's text."""
    order, todo = [], [(root, None, False)]
    above: dict[int, Node | None] = {}
    outside, held = False, []
    while todo:
        node, parent, dropped = todo.pop()
        if node.tag in UNSEEN_TAGS:
            continue
        order.append(node)
        above[id(node)] = parent
        if node.tag in ("article", "main") and not node.drop and node.children:
            outside = outside or not dropped
            held.append(node)
        todo.extend((c, node, dropped or node.drop) for c in node.children)
    if outside:
        return
    if held:
        for node in held:
            way, up = [], above[id(node)]
            while up is not None:
                way.append(up)
                up = above[id(up)]
            if not any(n.drop and not n.names.isdisjoint(COMMENT_NAMES) for n in way):
                for n in way:
                    n.drop = False
        return
    if not any(n.drop for n in order):
        return
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = len(node.text) + sum(size.get(id(c), 0) for c in node.children)
    for node in order:
        if (node.drop and 2 * size[id(node)] > size[id(root)] and node.tag not in BOILERPLATE_TAGS - {"form"}
                and node.names.isdisjoint(COMMENT_NAMES) and "hidden" not in node.names):
            node.drop = False


def blocks(root: Node) -> list[Node]:
    """Text leaves in page order that no tag or name marks as no article."""
    found: list[tuple[Node, bool]] = []
    todo = [(root, False, False)]
    while todo:
        node, inside, title = todo.pop()
        if node.tag == "#":
            found.append((node, inside))
            continue
        if node.drop:
            if node.tag != "header" or not inside or not node.names.isdisjoint(BOILERPLATE_NAMES):
                continue
            title = True                                # of an article's header its headings stay
        inside = inside or node.tag in ("article", "main")
        for child in reversed(node.children):
            if not title or child.tag[:1] == "h" and child.tag[1:].isdigit() or child.tag in ("div", "hgroup"):
                todo.append((child, inside, title and child.tag in ("div", "hgroup")))
    marked = [node for node, inside in found if inside]
    return marked or [node for node, _ in found]


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of matched nodes, as many as an order-keeping alignment allows, of these with most equal texts."""
    known: dict[tuple[int, int], tuple[int, list]] = {}

    def solve(x: Node, y: Node) -> tuple[int, list]:
        if x.tag != y.tag:
            return 0, []
        key = id(x), id(y)
        if key not in known:
            n, pairs = align(x.children, y.children)
            known[key] = n + NODE + (x.tag == "#" and x.text == y.text), [(x, y), *pairs]
        return known[key]

    def align(xs: list[Node], ys: list[Node]) -> tuple[int, list]:
        if not xs or not ys:
            return 0, []
        lo, hi = 0, 0
        total, head, tail = 0, [], []
        short = min(len(xs), len(ys))
        while lo < short and _alike(xs[lo], ys[lo]):
            n, pairs = solve(xs[lo], ys[lo])
            total, lo = total + n, lo + 1
            head += pairs
        while hi < short - lo and _alike(xs[-1 - hi], ys[-1 - hi]):
            n, pairs = solve(xs[-1 - hi], ys[-1 - hi])
            total, hi = total + n, hi + 1
            tail.append(pairs)
        tail = [p for pairs in reversed(tail) for p in pairs]
        xs, ys = xs[lo:len(xs) - hi], ys[lo:len(ys) - hi]
        if not xs or not ys:
            return total, head + tail
        n, pairs = middle(xs, ys)
        return total + n, head + pairs + tail

    def weights(xs: list[Node], ys: list[Node]) -> np.ndarray:
        w = _plain_weights(xs, ys)
        rest = [j for j, y in enumerate(ys) if not _plain(y)]
        for i, x in enumerate(xs):
            for j in rest if _plain(x) else range(len(ys)):
                w[i, j] = solve(x, ys[j])[0]
        return w

    def scores(xs: list[Node], ys: list[Node]) -> np.ndarray:
        """The weight of the best alignment of ``xs`` with the first 0, 1, ... of ``ys``, in memory for a few rows."""
        row, step = np.zeros(len(ys) + 1, np.int64), max(1, MOST_CELLS // len(ys))
        for at in range(0, len(xs), step):
            for own in weights(xs[at:at + step], ys):
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + own))
        return row

    def middle(xs: list[Node], ys: list[Node]) -> tuple[int, list]:
        if not xs or not ys:
            return 0, []
        if len(xs) > 1 and len(xs) * len(ys) > MOST_CELLS:      # divide where the best alignment passes the middle
            half = len(xs) // 2
            cut = int(np.argmax(scores(xs[:half], ys) + scores(xs[half:][::-1], ys[::-1])[::-1]))
            (n, before), (m, behind) = middle(xs[:half], ys[:cut]), middle(xs[half:], ys[cut:])
            return n + m, before + behind
        w = weights(xs, ys)
        best = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
        for i, row in enumerate(w):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + row))
        i, j, found = len(xs), len(ys), []
        while i and j:
            if w[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + w[i - 1, j - 1]:
                i, j = i - 1, j - 1
                found.append(solve(xs[i], ys[j])[1])
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        return int(best[-1, -1]), [p for pairs in reversed(found) for p in pairs]

    return solve(a, b)[1]


def _plain(node: Node) -> bool:
    """A text, or an element of one text."""
    return not node.children or len(node.children) == 1 and node.children[0].tag == "#"


def _text(node: Node) -> str:
    return node.children[0].text if node.children else node.text


def _alike(x: Node, y: Node) -> bool:
    """Plain nodes that are equal: some best alignment pairs them where they begin or end both lists."""
    return x.tag == y.tag and _plain(x) and _plain(y) and len(x.children) == len(y.children) and _text(x) == _text(y)


def _plain_weights(xs: list[Node], ys: list[Node]) -> np.ndarray:
    """Weights of all pairs of plain nodes, 0 where either is none."""
    tags: dict[str, int] = {}
    texts: dict[str, int] = {}

    def codes(nodes: list[Node], none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = [_plain(n) for n in nodes]
        return (np.array([tags.setdefault(n.tag, len(tags)) if p else none for n, p in zip(nodes, plain, strict=True)]),
                np.array([texts.setdefault(_text(n), len(texts)) if p and _text(n) else none for n, p in zip(nodes, plain, strict=True)]),
                np.array([p and len(n.children) for n, p in zip(nodes, plain, strict=True)], np.int64))

    (xt, xw, xc), (yt, yw, yc) = codes(xs, -1), codes(ys, -2)
    return np.equal.outer(xt, yt) * (NODE * (1 + np.multiply.outer(xc, yc)) + np.equal.outer(xw, yw))


class Reference:
    """The tree of a reference page, its text leaves numbered, with the number of its nodes and what its blocks are."""

    def __init__(self, page: str):
        self.root = parse(page)
        slot = self.size = 0
        todo = [self.root]
        while todo:
            node = todo.pop()
            self.size += 1
            if node.tag == "#":
                node.slot = slot
                slot += 1
            todo.extend(reversed(node.children))
        own = blocks(self.root)
        self.content, self.paths = _content(own), _paths(self.root, own)


def _content(own: list[Node]) -> bytes:
    return hashlib.blake2b("\n".join(n.text for n in own).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _paths(root: Node, own: list[Node]) -> frozenset:
    """The tag paths from the root to the blocks, as chained checksums: the tag skeleton, however often a part repeats."""
    wanted, out, todo = {id(n) for n in own}, set(), [(root, 0)]
    while todo:
        node, above = todo.pop()
        if node.tag == "#":
            if id(node) in wanted:
                out.add(above)
            continue
        path = zlib.crc32(node.tag.encode("utf-8", "surrogatepass"), above)
        todo.extend((c, path) for c in node.children)
    return frozenset(out)


MARK = "array<struct<slot: int, same: boolean>>"


def _aligner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each page with their slots in ``ref``. Pages whose skeleton is another one keep it and their html, the others vote."""
    kept: dict[str, Reference] = {}
    for batch in slices(batches, "html"):
        texts, marks, contents, layouts, pages = [], [], [], [], []
        for page, ref in zip(batch.column("html").to_pylist(), batch.column("ref").to_pylist(), strict=True):
            root = parse(page or "")
            own = blocks(root)
            slot: dict[int, Node] = {}
            content = layout = None
            if ref is not None and own:
                if ref not in kept:
                    if len(kept) >= 64:
                        kept.clear()
                    kept[ref] = Reference(ref)
                other = kept[ref]
                sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + 8 * other.size))
                slot = {id(x): y for x, y in match(root, other.root) if x.tag == "#"}
                paths = _paths(root, own)
                if 2 * len(paths & other.paths) < len(paths | other.paths):
                    layout = hashlib.blake2b(repr(sorted(paths)).encode(), digest_size=16).digest()
                elif slot and (own_content := _content(own)) != other.content:
                    content = own_content
            texts.append([n.text for n in own])
            marks.append([{"slot": -1 if y is None else y.slot, "same": y is not None and y.text == n.text}
                          for n in own for y in (slot.get(id(n)),)])
            contents.append(content)
            layouts.append(layout)
            pages.append(None if layout is None else page)
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("same", pa.bool_())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.list_(pa.string())), pa.array(marks, kind),
             pa.array(contents, pa.binary()), pa.array(layouts, pa.binary()), pa.array(pages, pa.string()),
             *(batch.column(c) for c in ("own", "first") if c in batch.schema.names)],
            names=["page_id", "url", "host", "texts", "marks", "content", "layout", "html", *(c for c in ("own", "first") if c in batch.schema.names)])


def _template(aligned: DataFrame, *keys: str) -> DataFrame:
    """(keys, fixed): the template slots. One vote for each distinct content, so copies count once."""
    votes = (aligned.where("content is not null").groupBy(*keys, "content").agg(F.min(F.filter("marks", lambda m: m["slot"] >= 0)).alias("marks"))
             .select(*keys, F.explode("marks").alias("m")).groupBy(*keys, "m.slot")
             .agg(F.count("*").alias("n"), F.sum(F.col("m.same").cast("int")).alias("same")))
    template = votes.where((F.col("n") >= MIN_VOTES) & (F.col("same") >= TEMPLATE_SHARE * F.col("n")))
    return template.groupBy(*keys).agg(F.collect_set("slot").alias("fixed"))


def _is_template(marks: str, fixed: str) -> Column:
    """For each block, whether it has the text of a template slot that it matches."""
    return F.transform(marks, lambda m: m["same"] & F.coalesce(F.array_contains(fixed, m["slot"]), F.lit(False)))


def _text_of(dropped: Column) -> Column:
    kept = F.filter(F.arrays_zip(F.col("texts").alias("t"), dropped.alias("d")), lambda x: ~x["d"])
    return F.array_join(F.transform(kept, lambda x: x["t"]), " ").alias("text")


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page, empty if there is none."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    kind = rows.schema["page_id"].dataType.simpleString()
    url_kind = rows.schema["url"].dataType.simpleString()
    first = F.min(F.struct("page_id", "html")).alias("r")
    refs = rows.where("host is not null and trim(html) <> ''").groupBy("host").agg(first).select("host", F.col("r.html").alias("ref"))
    refs = written(refs, "wrapper-references")
    out = (f"page_id {kind}, url {url_kind}, host string, texts array<string>, marks {MARK}, content binary, layout binary, html string")
    aligned = written(rows.join(refs, "host", "left").select("page_id", "url", "host", "html", "ref").mapInArrow(_aligner, out), "wrapper-blocks")
    template = written(_template(aligned, "host"), "wrapper-templates")
    made = aligned.join(template, "host", "left").withColumn("dropped", _is_template("marks", "fixed"))

    # Pages of another skeleton meet a second reference, the first page of their own.
    odd = aligned.where("layout is not null")
    own_refs = (odd.groupBy("host", "layout").agg(first, F.count("*").alias("n")).where(F.col("n") > MIN_VOTES)
                .select("host", "layout", F.col("r.html").alias("ref")))
    own_refs = written(own_refs, "wrapper-layout-references")
    again = made.where("layout is not null").join(own_refs, ["host", "layout"], "left").select(
        "page_id", "url", "host", "html", "ref", F.col("layout").alias("own"), F.col("dropped").alias("first"))
    again = written(again.mapInArrow(_aligner, out + ", own binary, first array<boolean>"), "wrapper-layout-blocks")
    own_template = written(_template(again, "host", "own"), "wrapper-layout-templates")
    again = again.join(own_template, ["host", "own"], "left").withColumn(
        "dropped", F.zip_with("first", _is_template("marks", "fixed"), lambda x, y: x | y))
    return made.where("layout is null").select("page_id", "url", _text_of(F.col("dropped"))).unionAll(
        again.select("page_id", "url", _text_of(F.col("dropped"))))
