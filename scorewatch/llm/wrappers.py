"""Main text of web pages by wrapper induction.

Pages of one host are mostly made from one template. Each page becomes a tree of its block
elements in which runs of alike siblings are folded into one node; pages with the same folded
tree are counted together, with the smallest and largest digest of a page's text at each node. The
trees of a host are aligned by simple tree matching (the largest order-preserving mapping of
nodes with equal labels) and merged, some dozens at a time, until one wrapper is left. A node
whose text is the same on all pages is template, one whose text varies is a slot.

Slots hold the content, but also menus and adverts that vary. A page's region is its
article, else its main element, else the lowest node with most of the varying text that is no
link; menus, headers, footers, asides, forms, notices, adverts and reader comments, by element
or by the words of class, id and role, are left out of it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import bounded_batches, slices, written
from scorewatch.session import BROADCAST_BYTES

# Elements of HTML by how they are parsed.
RAW = "script style textarea title noscript iframe xmp noembed noframes template".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | set(
    """address article aside blockquote body button canvas caption center datalist dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset head header hgroup html label legend li main map math menu nav object ol optgroup
    option p pre search section select summary svg table tbody td tfoot th thead tr ul video audio""".split()
)
CONTAINERS = set("html body main article section div center table thead tbody tfoot tr td th details fieldset".split())
# An opening tag closes an open element of the first group unless one of the second stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup"}, {"select"}),
}
BARRIERS = {"td", "th", "caption", "button", "object", "table"}

# What is never content, by element and by the words in class, id and role.
NOT_CONTENT = set("aside button canvas datalist dialog footer form head label legend math menu nav object optgroup option search select svg".split())
REMARKS = set("comment comments disqus replies reply respond discussion".split())
ADVERTS = set("ad ads adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted".split())
BESIDE = set(
    """alert alertdialog aside banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright
    disclaimer footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification
    overlay pager pagination popup recommendations recommended related search share sharing sidebar signup skip social
    subscribe subscription tablist toast toolbar widget widgets""".split()
)
NEGATED = {"has", "have", "no", "with", "without", "not", "hide", "show"}
FRONT = {"header", "masthead", "banner"}  # the head of an article may bear these names

ATTRIBUTES = r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+"""
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){ATTRIBUTES}>(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*\Z)"
    rf"|</(?P<end>[a-z][^\s/>]*)[^>]*>|<(?P<start>[a-z][^\s/>]*)(?P<attributes>{ATTRIBUTES})>|<[!?/][^>]*>|<[a-z/!?][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    """A block element or a run of text (label "#text"); in wrappers it stands for many."""

    __slots__ = ("label", "kids", "texts", "pages", "least", "most", "chars", "linked")

    def __init__(self, label: str):
        self.label, self.kids, self.texts = label, [], []
        self.pages, self.least, self.most, self.chars, self.linked = 1, None, None, 0, 0


def label_of(tag: str, attributes: str) -> str:
    """tag:words of role, id, class and itemprop without digits; `!` after the tag if it is hidden."""
    if not attributes.strip(" /"):
        return tag
    words, hidden = [], ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape("".join(values))
        if name in ("class", "id", "role", "itemprop"):
            words += [w.lower() for w in WORD.findall(value)]
        elif name == "hidden" or name == "style" and HIDDEN.search(value) or name == "aria-hidden" and value == "true":
            hidden = "!"
    return f"{tag}{hidden}:{' '.join(words)}" if words or hidden else tag


def parse(page: str) -> tuple[Node, list[str]]:
    """The block tree of a page and its blocks of text in page order; leaves number them."""
    root = Node("#page")
    stack, tags, blocks = [root], ["#page"], []
    pieces: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                if "head" in tags:
                    close(tags.index("head"))
                leaf = Node("#text")
                leaf.texts, leaf.chars, leaf.linked = [len(blocks)], len(text), min(linked, len(text))
                stack[-1].kids.append(leaf)
                blocks.append(text)
            pieces.clear()
        linked = 0

    def close(at: int) -> None:
        del stack[at:], tags[at:]

    def close_open(kinds: set[str], barriers: set[str]) -> None:
        for at in range(len(tags) - 1, 0, -1):
            if tags[at] in kinds:
                return close(at)
            if tags[at] in barriers:
                return None

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text)

    place = 0
    for m in TOKEN.finditer(page):
        if m.start() > place:
            add(page[place : m.start()])
        place = m.end()
        if tag := m["start"]:
            tag = tag.lower()
            if tag not in BLOCKS:
                if tag == "a":
                    links = 1
                elif tag == "br":
                    pieces.append(" ")
                elif tag == "hr":
                    flush()
                continue
            flush()
            if tag in ("html", "body") and tag in tags:
                continue
            if tag != "head" and "head" in tags:
                close(tags.index("head"))
            if tag in CLOSES:
                close_open(*CLOSES[tag])
            elif tag not in ("option", "button", "label", "select", "svg", "math", "object", "video", "audio", "canvas", "map"):
                close_open({"p"}, BARRIERS)
            if tag in HEADINGS and tags[-1] in HEADINGS:
                close(len(tags) - 1)
            node = Node(label_of(tag, m["attributes"]))
            stack[-1].kids.append(node)
            if not (tag in ("svg", "math") and m["attributes"].endswith("/")):
                stack.append(node)
                tags.append(tag)
        elif tag := m["end"]:
            tag = tag.lower()
            if tag == "a":
                links = 0
            elif tag == "br":
                pieces.append(" ")
            elif tag in BLOCKS:
                flush()
                if tag in HEADINGS and tag not in tags and tags[-1] in HEADINGS:
                    close(len(tags) - 1)
                elif tag in tags and tag not in ("html", "body"):
                    close(len(tags) - 1 - tags[::-1].index(tag))
    add(page[place:])
    flush()
    return root, blocks


def alike(a: Node, b: Node) -> bool:
    """Whether two trees have the same shape and labels."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if a.label != b.label or len(a.kids) != len(b.kids):
            return False
        todo += zip(a.kids, b.kids)
    return True


def matched(a: Node, b: Node, memo: dict) -> int:
    """Nodes in the largest mapping of two trees that keeps labels, order and parents."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + table_of(a.kids, b.kids, memo)[-1][-1]
    return memo[key]


def table_of(a: list[Node], b: list[Node], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(b) + 1)]
    for one in a:
        row, above = [0], rows[-1]
        for j, other in enumerate(b):
            best = max(above[j + 1], row[j])
            if one.label == other.label:
                best = max(best, above[j] + matched(one, other, memo))
            row.append(best)
        rows.append(row)
    return rows


def aligned(a: list[Node], b: list[Node], memo: dict) -> list[tuple[Node | None, Node | None]]:
    """Both lists in one order, matched nodes side by side."""
    if [x.label for x in a] == [x.label for x in b]:
        return list(zip(a, b))
    rows, out, i, j = table_of(a, b, memo), [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1].label == b[j - 1].label and rows[i][j] == rows[i - 1][j - 1] + matched(a[i - 1], b[j - 1], memo):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif j and rows[i][j] == rows[i][j - 1]:
            j -= 1
            out.append((None, b[j]))
        else:
            i -= 1
            out.append((a[i], None))
    return out[::-1]


def merge(a: Node, b: Node, count) -> None:
    """Put `b` into `a`, the nodes that simple tree matching pairs together; `count` adds their figures."""
    memo: dict = {}
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        count(a, b)
        pairs = aligned(a.kids, b.kids, memo)
        todo += [(x, y) for x, y in pairs if x is not None and y is not None]
        a.kids = [x if x is not None else y for x, y in pairs]


def in_a_page(a: Node, b: Node) -> None:
    a.texts += b.texts
    a.chars, a.linked = a.chars + b.chars, a.linked + b.linked


def between_pages(a: Node, b: Node) -> None:
    a.pages, a.chars, a.linked = a.pages + b.pages, a.chars + b.chars, a.linked + b.linked
    if b.least is not None:
        a.least, a.most = (b.least, b.most) if a.least is None else (min(a.least, b.least), max(a.most, b.most))


def fold(root: Node) -> Node:
    """Merge runs of neighbouring siblings with one label, innermost first."""
    order, todo = [], [root]
    while todo:
        order.append(node := todo.pop())
        todo += node.kids
    for node in reversed(order):
        kept: list[Node] = []
        for kid in node.kids:
            if kept and kept[-1].label == kid.label:
                merge(kept[-1], kid, in_a_page)
            else:
                kept.append(kid)
        node.kids = kept
    return root


def listed(root: Node) -> list[tuple[Node, int]]:
    """Nodes in tree order with the number of their parent."""
    out, todo = [], [(root, -1)]
    while todo:
        node, parent = todo.pop()
        out.append((node, parent))
        todo += [(kid, len(out) - 1) for kid in reversed(node.kids)]
    return out


def key_of(nodes: list[tuple[Node, int]]) -> str:
    return xxhash.xxh3_128_hexdigest("\0".join(f"{parent} {node.label}" for node, parent in nodes))


def words_of(label: str) -> set[str]:
    """Words of class, id and role, without those that a negation stands before."""
    words = label.partition(":")[2].split()
    return {w for before, w in zip(["", *words], words) if before not in NEGATED}


def not_content(node: Node, inside: bool) -> bool:
    """Whether element or names tell that a node is no content; `inside` an article more is."""
    tag = node.label.partition(":")[0]
    if tag.endswith("!") or tag in NOT_CONTENT or tag == "header" and not inside:
        return True
    if tag in ("#text", "#page", "html", "body", "main"):
        return False
    words = words_of(node.label)
    if tag == "article":
        return bool(words & (REMARKS | ADVERTS))
    return bool(words & (REMARKS | ADVERTS | BESIDE - (FRONT if inside else set())))


def content_of(page: Node, slot: dict[int, Node]) -> list[Node]:
    """Leaves of a folded page that hold content; `slot` has the wrapper's node of each leaf."""

    def leaves(node: Node, inside: bool) -> list[Node]:
        out, todo = [], [node]
        while todo:
            node = todo.pop()
            if node.label == "#text":
                out.append(node)
            todo += [kid for kid in reversed(node.kids) if not not_content(kid, inside)]
        return out

    def varies(leaf: Node) -> bool:
        known = slot.get(id(leaf), leaf)
        return known.pages < 3 or known.least != known.most

    def is_main(node: Node) -> bool:
        tag, _, words = node.label.partition(":")
        return tag == "main" or words in ("main", "content", "main content", "article", "article body", "post", "post content", "entry content")

    for chosen in (lambda n: n.label.partition(":")[0] == "article", is_main):
        found, todo = [], [page]
        while todo:
            node = todo.pop()
            if chosen(node) and not not_content(node, True):
                found += leaves(node, True)
                continue
            # Something that holds the article may well be named after what stands beside it.
            tag, words = node.label.partition(":")[0], words_of(node.label)
            if tag not in NOT_CONTENT and not tag.endswith("!") and not words & (REMARKS | ADVERTS):
                todo += reversed(node.kids)
        if found:
            slots = [leaf for leaf in found if varies(leaf)]
            return slots or found
    # No such element: the lowest container with most of the varying text that is no link, and
    # the headings that stand before it.
    fit = [leaf for leaf in leaves(page, False) if varies(leaf) and 2 * leaf.linked <= leaf.chars] or leaves(page, False)
    here, total = {id(leaf) for leaf in fit}, sum(leaf.chars for leaf in fit)
    node, before = page, []

    def inside(kid: Node) -> list[Node]:
        return [leaf for leaf in leaves(kid, False) if id(leaf) in here] if not not_content(kid, False) else []

    while total:
        own = [inside(kid) for kid in node.kids]
        at = next((i for i, kid in enumerate(node.kids) if kid.label.partition(":")[0] in CONTAINERS and 5 * sum(x.chars for x in own[i]) >= 4 * total), None)
        if at is None:
            break
        before += [leaf for kid, some in zip(node.kids[:at], own) if kid.label.partition(":")[0] in HEADINGS for leaf in some]
        node = node.kids[at]
    return before + inside(node)


KINDS = "host string, key string, node int, parent int, label string, pages long, least long, most long, chars long, linked long"
FIELDS = [kind.split()[0] for kind in KINDS.split(", ")]


def rows_of(host: str, root: Node) -> list[tuple]:
    nodes = listed(root)
    key = key_of(nodes)
    return [(host, key, at, parent, n.label, n.pages, n.least, n.most, n.chars, n.linked) for at, (n, parent) in enumerate(nodes)]


def tree_of(rows: list) -> Node:
    """The tree of rows with node, parent, label and figures."""
    made: dict[int, Node] = {}
    for row in sorted(rows, key=lambda r: r["node"]):
        node = made[row["node"]] = Node(row["label"])
        node.pages, node.chars, node.linked = row["pages"], row["chars"], row["linked"]
        node.least, node.most = (None if pd.isna(row[c]) else int(row[c]) for c in ("least", "most"))
        if row["parent"] >= 0:
            made[row["parent"]].kids.append(node)
    return made[0]


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def page_rows(pages: DataFrame) -> DataFrame:
    bounded_batches(pages.sparkSession)
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def page_shapes(rows: DataFrame) -> DataFrame:
    """Folded trees of the pages of each host, pages of one shape counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[tuple, Node] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                root, texts = parse(page)
                nodes = listed(fold(root))
                for node, _ in nodes:
                    if node.texts:
                        node.least = node.most = xxhash.xxh3_64_intdigest("\n".join(texts[at] for at in node.texts)) - 2**63
                at = (host, key_of(nodes))
                if at in found:
                    merge(found[at], root, between_pages)
                else:
                    found[at] = root
            out = [row for (host, _), root in found.items() for row in rows_of(host, root)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.string() if i in (0, 1, 4) else pa.int32() if i in (2, 3) else pa.int64()) for i in range(len(FIELDS))], names=FIELDS
            )

    sums = [F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")]
    return written(rows.select("host", "html").mapInArrow(run, KINDS).groupBy(*FIELDS[:5]).agg(*sums), "shapes")


FAN_IN = 64


def host_wrappers(shapes: DataFrame) -> DataFrame:
    """One merged tree per host, as rows like those of `shapes`.

    A host's trees are dealt into buckets of about FAN_IN, merged, and dealt again until one
    bucket is left, so no task meets all trees of a host with many shapes.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        trees = [(key, tree_of(part.to_dict("records"))) for key, part in rows.groupby("key")]
        trees.sort(key=lambda t: (-t[1].pages, t[0]))
        whole = trees[0][1]
        for _, tree in trees[1:]:
            merge(whole, tree, between_pages)
        return pd.DataFrame(rows_of(rows["host"].iloc[0], whole), columns=FIELDS).astype({"least": "Int64", "most": "Int64"})

    most = shapes.where("node = 0").groupBy("host").count().agg(F.max("count")).first()[0] or 0
    merged, buckets = shapes, most
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        dealt = merged.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        merged = dealt.groupBy("host", "bucket").applyInPandas(run, KINDS)
        # Two buckets may have merged into the same tree; they count as one.
        if buckets > 1:
            merged = merged.groupBy(*FIELDS[:5]).agg(*[f.alias(c) for c, f in (("pages", F.sum("pages")), ("least", F.min("least")), ("most", F.max("most")), ("chars", F.sum("chars")), ("linked", F.sum("linked")))])
        merged = written(merged, "wrappers")
    return merged


def content_rules(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, key, kept: numbers of the nodes of each shape that hold content."""
    figures = F.struct(*FIELDS[2:])
    own = shapes.groupBy("host", "key").agg(F.collect_list(figures).alias("shape"))
    whole = written(wrappers.groupBy("host").agg(F.collect_list(figures).alias("wrapper")), "whole")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                page, wrapper = tree_of(list(row.shape)), tree_of(list(row.wrapper))
                memo, slot, todo = {}, {}, [(wrapper, page)]
                while todo:
                    a, b = todo.pop()
                    slot[id(b)] = a
                    todo += [(x, y) for x, y in aligned(a.kids, b.kids, memo) if x is not None and y is not None]
                kept = {id(leaf) for leaf in content_of(page, slot)}
                out.append((row.host, row.key, [at for at, (node, _) in enumerate(listed(page)) if id(node) in kept]))
            yield pd.DataFrame(out, columns=["host", "key", "kept"])

    return written(written(own, "own").join(whole, "host").mapInPandas(run, "host string, key string, kept array<int>"), "rules")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of `pages` (page_id, url, html).

    Character references are decoded, white space in a block becomes one space, blocks are
    joined by one. Null pages count as empty ones and have an empty text; pages without a host
    are taken as one host's. Repeated rows are rows of their own. A host with fewer than three
    pages tells nothing about constant text, nor does a page whose text is all constant: there
    the region alone decides.
    """
    rows = page_rows(pages)
    shapes = page_shapes(rows)
    rules = content_rules(shapes, host_wrappers(shapes))
    blocks = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, found = [], []
            for page in batch.column("html").to_pylist():
                root, texts = parse(page)
                nodes = listed(fold(root))
                keys.append(key_of(nodes))
                place = {at: number for number, (node, _) in enumerate(nodes) for at in node.texts}
                found.append([{"node": place[at], "text": text} for at, text in enumerate(texts)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(keys, pa.string()), pa.array(found, blocks)], names=["page_id", "url", "host", "key", "blocks"])

    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("key") + 4 * F.size("kept"))).first()[0] or 0
    lookup = F.broadcast(rules) if size <= BROADCAST_BYTES else rules
    parsed = rows.mapInArrow(run, "page_id long, url string, host string, key string, blocks array<struct<node int, text string>>")
    kept = F.filter("blocks", lambda b: F.array_contains(F.col("kept"), b["node"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return parsed.join(lookup, ["host", "key"], "left").select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
