"""Main text of web pages by wrapper induction.

1. Every page becomes a DOM tree. Each host has one reference page: of those whose number of tags is nearest to the
   host's median, the one with the smallest page_id, so that an empty or odd page is none.
2. Every page of a host is aligned with the reference by simple tree matching (the largest common ordered top-down
   tree). For each node of the reference, Spark counts the pages that have a match for it, and those in which the
   match holds the same text. Counts are combined in each task first, so a host with a third of all pages is counted
   by all tasks.
3. Nodes that match in most pages with the same text are template; nodes whose texts vary are slots. A page is then
   aligned with its host's wrapper: template text goes, slots and all that the reference doesn't have stay.

Advertisements, menus and footers may vary from page to page too, so what an element says of itself counts as well:
navigation, forms, scripts and the like, and blocks whose class, id or role names furniture, are never content. If a
page marks its article, the text is what lies inside it, if that is at least half of the page's text without furniture
and template; else the articles are teasers or the like, and the whole page is taken. Articles named as readers'
comments, or named as furniture within another article, are none of the text. Template goes inside of an article too,
unless less than `article_share` of the article's text would be left: then the article itself is what repeats, as in
copies of one page, and stays whole.

Matching starts with the children that two nodes have in common at both ends, whole equal subtrees, which a largest
common tree can always pair. For what lies between it is exact up to `match_cells` pairs of children; wider lists are
cut at the equal subtrees that stand once in each, and children between two cuts that are still too many are paired in
order with the next one alike. Trees may be as deep and wide as they like.

Defined cases: a NULL or empty html gives an empty text. A NULL url is a host of its own. Repeated rows give equal
results. Further columns are ignored; a broken page is read as far as tags make sense, like browsers do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import settled, small_broadcast


@dataclass(frozen=True)
class Wrapper:
    """From how many pages a host has a template, and in what share of them a text must be the same."""

    min_pages: int = 5
    constant_share: float = 0.6
    article_share: float = 0.5
    match_cells: int = 40_000


# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
FURNITURE = frozenset(
    "head nav header footer aside form script style noscript template iframe button select option textarea input svg "
    "canvas object embed audio video map dialog menu label fieldset legend datalist noembed noframes xmp title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
# Start tags that end an open element of these kinds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_ENDERS = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option"}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span mark sub sup".split())
# Words of class, id or role that name what isn't content.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promoted|promotion|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|rail|header|masthead|footer|foot|cookie|cookies|consent|gdpr|"
    r"notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|share|sharing|social|"
    r"related|recommended|recommendations|comment|comments|disqus|discussion|reply|replies|respond|toolbar|widget|widgets|"
    r"pagination|pager|skip|search|login|copyright|legal|disclaimer|contentinfo|complementary|hidden)(?:$|[\s_-])"
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
# With or without a value; values are taken whole, so that no word of theirs is read as a name.
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
# Words that name readers' articles.
REPLIES = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|discussion|reply|replies|respond)(?:$|[\s_-])")
SPACE = re.compile(r"\s+")


@dataclass(eq=False, slots=True)
class Node:
    """An element: its tag, its children (elements and strings), whether its own names call it furniture.

    `shape` is equal for subtrees of equal tags and labels, `size` is the number of their elements.
    """

    tag: str
    furniture: bool = False
    label: str = ""
    children: list[Node | str] = field(default_factory=list)
    shape: int = 0
    size: int = 1

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def _named_furniture(attributes: str) -> tuple[bool, bool, str]:
    """Whether the element is hidden or named as furniture, whether it is named as a reader's, and its class."""
    if not attributes or attributes.isspace():
        return False, False, ""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of equal names counts
    # An aria-label is free text, so its words name nothing.
    names = unescape(" ".join(found.get(k, "") for k in ("class", "id", "role"))).lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    hidden = hidden or "display:none" in found.get("style", "").replace(" ", "").lower()
    return hidden or NAMES.search(names) is not None, REPLIES.search(names) is not None, found.get("class", "")


def parse(html: str) -> Node:
    """DOM tree of a page; tags that aren't closed end where their parents do."""
    root = Node("#root")
    stack = [root]
    # Open elements by tag, so that no look through a deep stack is needed to learn that there is none.
    open_: Counter[str] = Counter()

    def cut(depth: int) -> None:
        open_.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    place, size = 0, len(html)
    while place < size:
        start = html.find("<", place)
        if start < 0:
            start = size
        if start > place:
            stack[-1].children.append(unescape(html[place:start]))
        if start == size:
            break
        match = TAG.match(html, start)
        if match is None:
            # No tag: the character stands for itself, unless the page ends inside of a tag.
            if html.find(">", start) < 0 and re.match(r"</?[a-zA-Z!]", html[start : start + 3]):
                break
            stack[-1].children.append("<")
            place = start + 1
            continue
        place = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if not open_[tag]:
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and not (tag in FORMATTING and any(n.tag in BLOCKS for n in stack[depth + 1 :])):
                cut(depth)
            continue
        if tag in P_ENDERS and open_["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in ENDS and any(open_[t] for t in ENDS[tag][0]):
            ended, within = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in ended:
                    cut(i)
                    break
        furniture, reply, label = _named_furniture(match[3])
        # A page or its article may carry any name, unless it is a reader's or lies in another article.
        if tag in ("html", "body", "main"):
            furniture = False
        elif tag == "article":
            furniture = reply or furniture and open_["article"] > 0
        node = Node(tag, tag in FURNITURE or furniture, label)
        stack[-1].children.append(node)
        if tag in VOID or match[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, place)
            place = end.end() if end else size
            continue
        stack.append(node)
        open_[tag] += 1
    for node in reversed(nodes_in_order(root)):
        inner = node.elements
        node.shape = hash((node.tag, node.label, *(c.shape for c in inner)))
        node.size = 1 + sum(c.size for c in inner)
    return root


def _own_text(node: Node) -> str:
    return SPACE.sub(" ", " ".join(c for c in node.children if isinstance(c, str))).strip()


def nodes_in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.elements))
    return out


Pairs = list[tuple[Node, Node]]


def _alike(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.label == b.label


def _common_ends(x: list[Node], y: list[Node]) -> tuple[Pairs, list[Node], list[Node]]:
    """Equal subtrees at the beginnings and ends of two lists, and what lies between them."""
    n = min(len(x), len(y))
    first = next((i for i in range(n) if x[i].shape != y[i].shape), n)
    last = next((i for i in range(n - first) if x[-1 - i].shape != y[-1 - i].shape), n - first)
    ends = len(x) - last, len(y) - last
    pairs = [*zip(x[:first], y[:first], strict=True), *zip(x[ends[0] :], y[ends[1] :], strict=True)]
    return pairs, x[first : ends[0]], y[first : ends[1]]


def _cuts(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Places of a longest ascending run of the subtrees that stand once in each list."""
    once = Counter(c.shape for c in x), Counter(c.shape for c in y)
    place = {c.shape: j for j, c in enumerate(y) if once[1][c.shape] == 1}
    found = [(i, place[c.shape]) for i, c in enumerate(x) if once[0][c.shape] == 1 and c.shape in place]
    tails: list[int] = []
    ends: list[int] = []  # for each length, the number of the pair with the smallest end
    before: list[int] = []
    for number, (_, j) in enumerate(found):
        at = bisect_left(tails, j)
        tails[at : at + 1], ends[at : at + 1] = [j], [number]
        before.append(ends[at - 1] if at else -1)
    out, number = [], ends[-1] if ends else -1
    while number >= 0:
        out.append(found[number])
        number = before[number]
    return out[::-1]


def _in_order(x: list[Node], y: list[Node]) -> Pairs:
    """Each child of x with the next one alike of y, if there is any left."""
    places: dict[tuple[str, str], list[int]] = {}
    for j, c in enumerate(y):
        places.setdefault((c.tag, c.label), []).append(j)
    pairs, at = [], 0
    for c in x:
        own = places.get((c.tag, c.label), [])
        k = bisect_left(own, at)
        if k < len(own):
            pairs.append((c, y[own[k]]))
            at = own[k] + 1
    return pairs


def _parts(a: Node, b: Node, cells: int) -> tuple[Pairs, list[tuple[list[Node], list[Node]]]]:
    """Pairs of children that are settled from the start, and pairs of lists, small enough, that are to be aligned."""
    pairs, x, y = _common_ends(a.elements, b.elements)
    if len(x) * len(y) <= cells:
        return pairs, [(x, y)] if x and y else []
    parts, i, j = [], 0, 0
    for m, n in [*_cuts(x, y), (len(x), len(y))]:
        more, left, right = _common_ends(x[i:m], y[j:n])
        pairs += more
        if len(left) * len(right) > cells:
            pairs += _in_order(left, right)
        elif left and right:
            parts.append((left, right))
        if m < len(x):
            pairs.append((x[m], y[n]))
        i, j = m + 1, n + 1
    return pairs, parts


def match_trees(reference: Node, page: Node, cells: int) -> dict[int, Node]:
    """Simple tree matching: by identity of reference nodes, the page's nodes that a largest common tree pairs them with."""
    # For each pair that has been scored: nodes of the largest common tree, and which children it pairs.
    scored: dict[tuple[Node, Node], tuple[int, Pairs]] = {}

    def score(a: Node, b: Node) -> int:
        return a.size if a.shape == b.shape else scored[a, b][0]

    def align(x: list[Node], y: list[Node]) -> Pairs:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x, 1):
            row, above = best[i], best[i - 1]
            for j, d in enumerate(y, 1):
                row[j] = max(row[j - 1], above[j], above[j - 1] + score(c, d) if _alike(c, d) else 0)
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x[i], y[j]))
        return pairs

    if not _alike(reference, page):
        return {}
    open_: list[tuple[Node, Node, tuple | None]] = [(reference, page, None)]
    while open_:
        a, b, parts = open_.pop()
        if a.shape == b.shape or (a, b) in scored:
            continue
        if parts is None:
            parts = _parts(a, b, cells)
            open_.append((a, b, parts))
            wanted = [*parts[0], *((c, d) for x, y in parts[1] for c in x for d in y if _alike(c, d))]
            open_.extend((c, d, None) for c, d in wanted if c.shape != d.shape and (c, d) not in scored)
            continue
        pairs = [*parts[0], *(pair for x, y in parts[1] for pair in align(x, y))]
        scored[a, b] = 1 + sum(score(c, d) for c, d in pairs), pairs

    matched, stack = {}, [(reference, page)]
    while stack:
        a, b = stack.pop()
        matched[id(a)] = b
        stack.extend(zip(a.elements, b.elements, strict=True) if a.shape == b.shape else scored[a, b][1])
    return matched


def _articles(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, outside of furniture."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.furniture:
                continue
            if node.tag == tag:
                found.append(node)
                continue
            stack.extend(reversed(node.elements))
        if found:
            return found
    return []


def blocks_of(roots: list[Node], template: set[int]) -> list[str]:
    """Texts of the blocks in page order, without furniture and template nodes."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    for root in roots:
        stack: list[Node | str | None] = [root]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                held.append(item)
            elif item.furniture:
                continue
            elif item.tag == "br":
                held.append(" ")
            else:
                block = item.tag in BLOCKS
                if block:
                    flush()
                    stack.append(None)
                # A template node's own text goes; what it holds is judged for itself.
                skip = id(item) in template
                stack.extend(c for c in reversed(item.children) if not (skip and isinstance(c, str)))
        flush()
    return out


def content_blocks(page: Node, template: set[int], article_share: float = 0.5) -> list[str]:
    """Blocks of the articles, if they hold no less text than the rest without template and furniture; else of the page."""
    articles = _articles(page)
    if not articles:
        return blocks_of([page], template)
    whole = blocks_of(articles, set())
    length = sum(map(len, whole))
    for node in articles:
        node.furniture = True
    rest = sum(map(len, blocks_of([page], template)))
    for node in articles:
        node.furniture = False
    if length < rest:
        return blocks_of([page], template)
    blocks = blocks_of(articles, template) if template else whole
    return blocks if sum(map(len, blocks)) >= article_share * length else whole


def host_of() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("-"))


# Reference trees that a task keeps, and bytes of references that are broadcast.
TREES_KEPT = 64
MAX_BROADCAST_BYTES = 16_000_000


def _reference(host: str, html: str, cache: dict[str, tuple[Node, list[Node]]]) -> tuple[Node, list[Node]]:
    if host not in cache:
        if len(cache) >= TREES_KEPT:
            cache.pop(next(iter(cache)))
        tree = parse(html)
        cache[host] = tree, nodes_in_order(tree)
    return cache[host]


def _aligned(rows: dict, cache: dict, cells: int) -> tuple[Node, list[Node], dict[int, Node]]:
    tree, nodes = _reference(rows["host"], rows["reference"] or "", cache)
    page = parse(rows["html"] or "")
    return page, nodes, match_trees(tree, page, cells)


def _with_reference(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages with their hosts, and for each host its reference page and number of pages (settled)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    marks = settled(
        rows.select("host", "page_id", F.xxhash64("html").alias("mark"), F.regexp_count("html", F.lit("<[a-zA-Z]")).alias("tags"))
    )
    hosts = marks.groupBy("host").agg(F.percentile_approx("tags", 0.5).alias("middle"), F.count("*").alias("pages"))
    order = F.struct(F.abs(F.col("tags") - F.col("middle")), F.col("page_id").isNull(), "page_id", "mark")
    least = marks.join(small_broadcast(settled(hosts)), "host").groupBy("host").agg(F.min(order).alias("first"), F.max("pages").alias("pages"))
    chosen = (
        rows.join(small_broadcast(settled(least)), "host")
        .where(
            F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.xxhash64("html") == F.col("first.mark"))
        )
        .groupBy("host")
        .agg(F.min("html").alias("reference"), F.max("pages").alias("pages"))
    )
    return rows, settled(chosen)


def _at_hosts(rows: DataFrame, table: DataFrame, salts: int = 16) -> DataFrame:
    """Join by host. The hosts' table is broadcast if its size, as summed up, is small, so that no page is shuffled.

    Else each host's row is repeated for `salts` salts, so that no host's pages meet in one task, and rows are sorted
    by host, so that a task parses each reference once.
    """
    if (table.agg(F.sum(F.octet_length("reference"))).first()[0] or 0) <= MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "host")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    right = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["host", "salt"]).drop("salt").sortWithinPartitions("host")


def induce_wrappers(rows: DataFrame, references: DataFrame, wrapper: Wrapper) -> DataFrame:
    """host, pages, reference, template: numbers of the reference's nodes whose text is constant. Settled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        counts: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    _, nodes, matched = _aligned(row, cache, wrapper.match_cells)
                    for number, node in enumerate(nodes):
                        other = matched.get(id(node))
                        if other is not None and (text := _own_text(node)):
                            entry = counts.setdefault((row["host"], number), [0, 0])
                            entry[0] += 1
                            entry[1] += _own_text(other) == text
                # What a task holds is bounded by the nodes of a few references.
                if len(counts) > 50_000:
                    yield _counts(counts)
                    counts = {}
        if counts:
            yield _counts(counts)

    def _counts(counts: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
        keys = list(counts)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [counts[k][0] for k in keys], [counts[k][1] for k in keys]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "node", "matched", "equal"])

    with_template = references.where(F.col("pages") >= wrapper.min_pages)
    nodes = (
        _at_hosts(rows, with_template)
        .select("host", "html", "reference")
        .mapInArrow(count, "host string, node bigint, matched bigint, equal bigint")
        .groupBy("host", "node")
        .agg(F.sum("matched").alias("matched"), F.sum("equal").alias("equal"))
    )
    constant = (
        nodes.join(with_template.select("host", "pages"), "host")
        .where(F.col("equal") >= wrapper.constant_share * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("node").alias("template"))
    )
    none = F.array().cast("array<bigint>")
    return settled(references.join(constant, "host", "left").withColumn("template", F.coalesce("template", none)))


def extract_main_text(pages: DataFrame, wrapper: Wrapper = Wrapper()) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`."""
    rows, references = _with_reference(pages)
    wrappers = induce_wrappers(rows, references, wrapper)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    template: set[int] = set()
                    if row["template"]:
                        page, nodes, matched = _aligned(row, cache, wrapper.match_cells)
                        constant = [nodes[i] for i in row["template"]]
                        # Only where the page shows the template's text; another text in its place is content.
                        template = {
                            id(matched[id(n)])
                            for n in constant
                            if id(n) in matched and _own_text(matched[id(n)]) == _own_text(n)
                        }
                    else:
                        page = parse(row["html"])
                    blocks = content_blocks(page, template, wrapper.article_share)
                    text = "\n\n".join(blocks)
                    out.append((row["page_id"], row["url"], text, len(text)))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return (
        _at_hosts(rows, wrappers)
        .select("page_id", "url", "html", "host", "reference", "template")
        .mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
    )
