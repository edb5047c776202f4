"""Main text of web pages, with removal of each site's template.

Every element subtree of a page has a hash of its tags and text. Spark counts, for
each host, on how many of its distinct pages a subtree occurs; subtrees on many pages
of the host are template and are deleted: those on a large share of the pages, and
containers on a great number of pages already at a small share (the menu of one
section of a large site). That includes menus, headers and footers, whatever they are
called. Inside an article or main element, and for the paragraphs of running text,
repetition is no sign of a template (an article quotes), so there only container
elements go. What differs from page to page, as an advert does, or is on a host of
fewer than LEAST_PAGES pages, goes by tag, role, or the words in class and id. An
element that holds the article stays, and so do a form around most of the page and
the heading of an article.

Copies say nothing about a template: pages of one host with the same tree of tags and
text count once. Pages that differ in a word are not copies.

Hosts differ in size: copies are dropped by (host, whole tree), counting combines on
the map side by (host, subtree), and the share decides before a host's list is put
together, so the list is bounded by one page's number of subtrees over the share. That
is why containers need a share too: what is on less than MANY_SHARE of a host's pages
is left to the other rules. A host of more than SALT_PAGES pages is dealt over parts
of that many, each of which gets a copy of its list.

Nulls: a null html is an empty page and gives an empty text; a null url is a host
of its own. Broken, cut-off, very long and deeply nested html is read as far as it
goes, in time proportional to its length. Repeated rows and ties give equal texts; an
empty table gives no rows. Extra columns stay, but for one named as the result, which
the result replaces.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import HIDE, cut, table

#: A subtree is template if it is on so many pages of its host, and on this share of them.
LEAST_PAGES, SHARE = 3, 0.3
#: A container is template on so many pages of its host as well, if they are this share of them.
MANY_PAGES, MANY_SHARE = 1000, 0.01
#: Pages of a host in one part for the join with its template, and hosts with several parts up to which these are broadcast.
SALT_PAGES, BROADCAST_ROWS = 1024, 50_000

#: Fixed values of HTML: elements without content, those whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements that are never main text.
DROP = frozenset("head script style noscript template iframe object embed svg canvas nav header footer aside form menu dialog button select option input textarea label audio video map applet title noembed noframes".split())
#: Elements that end a line.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: What closes an open p.
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption dd dt li".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt tr ul ol table tbody dl b i em strong a span u s code q cite small sub sup mark br figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog form toolbar".split())
#: Words of class and id that mark what is not main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|commentlist|respond|disqus|replies|share|sharing|social|related|"
    r"recommend\w*|widget|pagination|pager|toolbar|login|signup|search|skip-link)(?:$|[\s_-])",
    re.IGNORECASE,
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
#: A tag with a quote that is never closed ends at its first bracket.
OPEN = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
SPACE = re.compile(r"\s+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element: ``kids`` holds strings and nodes in page order."""

    __slots__ = ("kids", "marked", "headed", "tag", "key")

    def __init__(self, tag: str, marked: str) -> None:
        self.tag, self.marked, self.headed, self.kids, self.key = tag, bool(marked), marked == "header", [], 0


def _marked(tag: str, attributes: str) -> str:
    """What in the attributes says that this is not main text: "" if nothing, "header" if only that word."""
    out = ""
    if not attributes or tag in ("html", "body", "article", "main"):
        return out
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and (word := MARKS.search(value)):
            if word[0].strip(" \t\r\n\f_-").lower() != "header" or MARKS.search(value, word.end() - 1):
                return "marked"
            out = "header"
        if (name == "role" and value.strip().lower() in ROLES) or (name == "hidden") or (name == "aria-hidden" and value == "true"):
            return "marked"
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return "marked"
    return out


class _Stack:
    """Open elements, with the places of each tag, so that no search walks the stack."""

    def __init__(self) -> None:
        self.nodes = [Node("", "")]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of this tag, 0 if there is none."""
        return own[-1] if (own := self.places.get(tag)) else 0

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            gone = self.nodes.pop()
            self.places[gone.tag].pop()
            if gone.tag in BLOCKS:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        """Closes the innermost element of this tag; an inline end tag does not end the block around it."""
        place = self.last(tag)
        if place and (tag in BLOCKS or not self.blocks or self.blocks[-1] < place):
            self.cut(place)

    def close(self, tag: str, walls: tuple[str, ...]) -> None:
        place = self.last(tag)
        if place and all(self.last(w) < place for w in walls):
            self.cut(place)


def parse(page: str) -> Node:
    """A lenient tree: unknown ends are skipped, open elements end with their parent."""
    stack = _Stack()
    root = stack.nodes[0]
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            stack.nodes[-1].kids.append(entities.unescape(page[at:]))
            break
        if start > at:
            stack.nodes[-1].kids.append(entities.unescape(page[at:start]))
        m = TOKEN.match(page, start)
        opened = (m[2], m[3]) if m else None
        if not m and (m := OPEN.match(page, start)):
            opened = (m[1], m[2])
        if not m:
            stack.nodes[-1].kids.append("<")
            at = start + 1
            continue
        at = m.end()
        if opened[0] is None:
            if m[1]:
                stack.end(m[1].lower())
            continue
        tag, attributes = opened[0].lower(), opened[1] or ""
        if tag in CLOSES_P:
            stack.close("p", ("button", "td", "th", "object"))
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for one in same:
                stack.close(one, ("ul", "ol", "dl", "table", "select"))
        node = Node(tag, _marked(tag, attributes))
        stack.nodes[-1].kids.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            node.kids.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else n
        else:
            stack.push(node)
    return root


def _postorder(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in node.kids if isinstance(k, Node))
    return order[::-1]


def key_subtrees(root: Node) -> list[Node]:
    """Gives each element the hash of its subtree, odd for containers; elements with text, in no particular order."""
    import xxhash

    out = []
    for node in _postorder(root):
        h = xxhash.xxh64(node.tag)
        text = False
        for kid in node.kids:
            if isinstance(kid, str):
                if kid := SPACE.sub(" ", kid).strip():
                    h.update("\0" + kid)
                    text = True
            elif kid.key:
                h.update(kid.key.to_bytes(8, "little"))
                text = True
        node.key = ((h.intdigest() & ~1) or 2) | (node.tag not in TEXT_BLOCKS) if text else 0
        if text and node.tag and node.tag not in RAW and node.tag != "head":
            out.append(node)
    return out


def _holders(root: Node) -> set[int]:
    """Elements around an article or main element, and these."""
    out: set[int] = set()
    for node in _postorder(root):
        if node.tag in ("article", "main") or any(isinstance(k, Node) and id(k) in out for k in node.kids):
            out.add(id(node))
    return out


def removable(root: Node) -> list[Node]:
    """Elements that may be template: outside the article any, inside it containers only."""
    keyed = key_subtrees(root)
    inside: set[int] = set()
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        if within:
            inside.add(id(node))
        for kid in node.kids:
            if isinstance(kid, Node):
                todo.append((kid, within or node.tag in ("article", "main")))
    whole = _holders(root)  # what holds an article is never deleted
    return [n for n in keyed if id(n) not in whole and n.tag not in ("html", "body") and not (id(n) in inside and n.tag in TEXT_BLOCKS)]


def _amounts(root: Node) -> dict[int, tuple[int, bool]]:
    """For each element the letters inside it, but for raw ones, and whether it has a heading."""
    out: dict[int, tuple[int, bool]] = {}
    for node in _postorder(root):
        kids = [out[id(k)] if isinstance(k, Node) else (len(k) - k.count(" "), False) for k in node.kids]
        size = 0 if node.tag in RAW or node.tag == "head" else sum(n for n, _ in kids)
        out[id(node)] = size, node.tag in HEADINGS or any(h for _, h in kids)
    return out


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the article, or of the page without one, joined by newlines."""
    gone = {id(n) for n in removable(root) if n.key in template} if template else set()
    order = _postorder(root)
    holders = _holders(root)
    amounts = _amounts(root)
    half = amounts[id(root)][0] / 2
    main = [n for n in order if n.tag == "main"]
    articles = [n for n in order if n.tag == "article" and not n.marked]
    body = [n for n in order if n.tag == "body"]
    roots = set(map(id, articles or main or body or [root]))
    lines: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if line := SPACE.sub(" ", "".join(parts)).strip():
            lines.append(line)
        parts.clear()

    # (node, are we in the main part?, is it the end?)
    todo: list[tuple[Node | str, bool, bool]] = [(root, False, False)]
    while todo:
        node, inside, end = todo.pop()
        if isinstance(node, str):
            if inside:
                parts.append(node)
            continue
        if end:
            flush()
            continue
        dropped = id(node) not in holders and (node.tag in DROP or node.marked)
        if dropped and ((inside and (articles or main) and amounts[id(node)][1] and (node.tag == "header" or (node.headed and node.tag not in DROP))) or (node.tag == "form" and amounts[id(node)][0] > half)):
            dropped = False  # the heading of the article, or a form around the page
        if dropped or id(node) in gone:
            # what stood around a deleted block does not run together
            if node.tag in BLOCKS or node.tag not in DROP:
                flush()
            continue
        inside = inside or id(node) in roots
        if node.tag in BLOCKS:
            flush()
            todo.append((node, inside, True))
        elif node.tag in ("br", "wbr"):
            parts.append(" " if node.tag == "br" else "")
        todo.extend((k, inside, False) for k in reversed(node.kids))
    flush()
    return "\n".join(lines)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _counted(pages: DataFrame, url: str, page: str, least: int, share: float, many: int, many_share: float) -> tuple[DataFrame, DataFrame]:
    """(host, pages, rows): distinct pages of every host, and all; and (host, keys): hashes of the subtrees on many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, keys, ends = [], [], [0]
            for text in batch.column(1).to_pylist():
                root = parse(text or "")
                found = {n.key for n in removable(root)} | {0}  # 0 counts the pages
                trees.append(root.key)
                keys += found
                ends.append(len(keys))
            trees, keys = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (trees, keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), trees, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)], names=["host", "tree", "keys"])

    rows = pages.select(host(F.col(url)).alias("host"), F.col(page)).mapInArrow(run, "host string, tree long, keys array<long>")
    distinct = rows.groupBy("host", "tree").agg(F.first("keys").alias("keys"), F.count("*").alias("copies"))
    per_key = distinct.select("host", "copies", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    per_key = cut(per_key.filter((F.col("n") >= least) | (F.col("key") == 0)))
    hosts = per_key.filter("key = 0").select("host", F.col("n").alias("pages"), "rows")
    template = (F.col("n") >= F.col("pages") * share) | ((F.col("key") % 2 != 0) & (F.col("n") >= many) & (F.col("n") >= F.col("pages") * many_share))
    frequent = per_key.filter("key != 0").drop("rows").join(hosts, "host").filter(template)
    return hosts, frequent.groupBy("host").agg(F.collect_list("key").alias("keys"))


def template_subtrees(pages: DataFrame, url: str = "url", page: str = "html", least: int = LEAST_PAGES, share: float = SHARE, many: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """(host, keys): hashes of the subtrees on many distinct pages of the host."""
    return _counted(pages, url, page, least, share, many, many_share)[1]


def extract(pages: DataFrame, url: str = "url", page: str = "html", into: str = "text", least: int = LEAST_PAGES, share: float = SHARE, many: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """``pages`` with the main text in ``into`` instead of the html."""
    kept = [c for c in pages.columns if c not in (page, into)]
    name, keys, salt, parts = (HIDE + x for x in ("host", "keys", "salt", "parts"))
    hosts, lists = _counted(pages, url, page, least, share, many, many_share)
    # every host of many pages is dealt, whether it has a template or not
    large = cut(hosts.select(F.col("host").alias(name), F.ceil(F.col("rows") / SALT_PAGES).cast("long").alias(parts)).filter(F.col(parts) > 1))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    count = F.coalesce(parts, F.lit(1).cast("long"))
    row = F.xxhash64(*(pages[c] for c, kind in pages.dtypes if c in (*kept, page) and "map<" not in kind))
    named = pages.select(*(pages[c] for c in kept), pages[page], host(pages[url]).alias(name), row.alias(salt)).join(large, name, "left")
    salted = named.withColumn(salt, F.pmod(F.col(salt), count))
    lists = lists.select(F.col("host").alias(name), F.col("keys").alias(keys)).join(large, name, "left")
    dealt = lists.select(name, keys, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias(salt))
    joined = salted.join(dealt, [name, salt], "left").select(*kept, page, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
                template = frozenset(k & 0xFFFFFFFFFFFFFFFF for k in found or ())
                texts.append(main_text(parse(text or ""), template))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept) + f", `{into}` string"
    return joined.mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
