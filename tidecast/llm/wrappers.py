"""Main text of web pages by wrappers that are inferred per host.

A wrapper is a union-free regular expression over the tokens of a host's pages (Crescenzi, Mecca and Merialdo,
2001). It starts as one page and is aligned with one page after the other:

* text against other text makes a text slot;
* a tag on one side only makes the element an optional group, found by looking for where both sides agree again;
* the same element several times in a row makes a repeated group, whose copies are aligned with each other.

Groups nest as elements do, so the expression is kept as a tree: every node is an element (tag, and class, id
or role) with the range of its number in a row and the children in order. Aligning is associative enough to fold
pages in any order and to fold wrappers with wrappers: each task folds its own pages per host, then the
wrappers of the tasks are folded, in two steps for hosts with many tasks. What is shuffled are wrappers, whose
size is bounded by the host's markup and not by its pages.

In a wrapper the template part is found once per host: elements for navigation, notices, adverts, forms
and comments by what they are called; in pages without an article or main element also the slots whose text never
changes over several pages of the host. The rest is the main text: the page's articles, else its main element, else
its body. A host's pages may have different layouts; each is read by what it holds itself.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import plain, rows_of
from tidecast.llm.urls import host_of
from tidecast.session import settle

#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are blocks of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that close an open element of the first kind when they start.
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
          "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
          "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"])}
#: Elements that never hold main text.
TEMPLATE = frozenset(
    "head nav footer aside form script style noscript template iframe textarea select button svg math object embed canvas audio "
    "video menu dialog title xmp noembed noframes".split()
)
#: A header is template unless it stands in an article, where it holds the headline.
OUTSIDE_ONLY = frozenset(["header"])
#: Words of a class, id or role that name a template part.
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|cookies?|consent|comments?|commentlist|disqus|respond|notice|notices|gdpr|"
    r"nav|navbar|navigation|menu|sidebar|side-bar|footer|masthead|site-header|page-header|topbar|promo|promoted|sponsor\w*|"
    r"newsletter|subscribe|signup|social|share|sharing|related|recommended|pagination|pager|popup|modal|overlay|toolbar|"
    r"skip-link|complementary|contentinfo|search|search-?form|login)(?:$|[\s_-])",
    re.I,
)
#: The same for elements outside of articles only, and for articles themselves.
_NAMED_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|rail|widgets?)(?:$|[\s_-])", re.I)
_NAMED_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|promo|promoted|sponsor\w*|comments?|related|recommended)(?:$|[\s_-])", re.I)
#: A text slot counts as template text if it was equal on so many pages.
LEAST_PAGES = 3
#: A wrapper knows elements down to this depth. Elements with more children than the first number are known by which
#: children they have, not by their order; with more different children than the second by their tags only.
DEPTH, ORDERED, NAMED = 60, 40, 200
#: Parts in which the wrappers of a host's tasks are folded first.
FANOUT = 64
#: Hosts whose wrappers a task holds before it hands them on.
HOSTS_HELD = 5000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _name(tag: str, attributes: str) -> str:
    """What an element is called in a wrapper: its tag, and the class, id and role without numbers."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag
    found = []
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = re.sub(r"\d+", "", " ".join(next((v for v in values if v), "").split()))
        if key.lower() in ("hidden", "aria-hidden"):
            if value.lower() in ("", "true", "hidden"):
                found.append("hidden")
        elif value:
            found.append(value)
    return f"{tag} {' '.join(found)}" if found else tag


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, value): ``open`` with the element's name, ``close``, ``text`` still encoded. Elements left open are closed
    as a browser does; closing tags that fit nothing are dropped; content of raw elements is dropped."""
    opened: list[str] = []
    at = 0
    while at < len(page):
        match = _TOKEN.search(page, at)
        if match is None:
            if at < len(page):
                yield "text", "", page[at:]
            break
        if match.start() > at:
            yield "text", "", page[at : match.start()]
        at = max(match.end(), match.start() + 1)
        if match[0].startswith("<![CDATA["):
            continue
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag in opened:
                while (last := opened.pop()) != tag:
                    yield "close", last, ""
                yield "close", tag, ""
            elif tag == "br":
                yield "break", tag, ""
            elif tag == "p":
                yield "open", "p", "p"
                yield "close", "p", ""
            continue
        while opened and tag in CLOSES.get(_innermost(opened), ()):
            yield from _closing(opened, _innermost(opened))
        if tag in VOID:
            yield "break", tag, ""
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|/|\s[^>]*>)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        opened.append(tag)
        yield "open", tag, _name(tag, match[3])
    while opened:
        yield "close", opened.pop(), ""


def _innermost(opened: list[str]) -> str:
    """The innermost open block: inline elements do not keep a start tag from closing it."""
    for tag in reversed(opened):
        if tag in BLOCKS:
            return tag
    return opened[-1]


def _closing(opened: list[str], tag: str) -> Iterator[tuple[str, str, str]]:
    while (last := opened.pop()) != tag:
        yield "close", last, ""
    yield "close", tag, ""


class Node:
    """An element of a wrapper: how often it stands in a row, whether its text varies, and its children.

    ``loose``: any number of the children in any order, a repeated group of optional ones.
    """

    __slots__ = ("name", "least", "most", "pages", "text", "varies", "loose", "children")

    def __init__(self, name: str):
        self.name, self.least, self.most, self.pages = name, 1, 1, 1
        self.text, self.varies, self.loose, self.children = "", False, False, []

    def to_list(self) -> list:
        own = [self.name, self.least, self.most, self.pages, self.text, self.varies, self.loose]
        return [*own, [c.to_list() for c in self.children]]

    @classmethod
    def from_list(cls, values: list) -> Node:
        node = cls(values[0])
        node.least, node.most, node.pages, node.text, node.varies, node.loose = values[1:7]
        node.children = [cls.from_list(c) for c in values[7]]
        return node

    def settle(self) -> None:
        """Folds children of one name in a row into repeated groups, and all of them if there are too many."""
        found: list[Node] = []
        for child in self.children:
            if found and found[-1].name == child.name:
                _repeat(found[-1], child)
            else:
                found.append(child)
        self.children = found
        if self.loose or len(found) > ORDERED:
            self.loosen()

    def loosen(self) -> None:
        self.loose = True
        for plain in (False, True):
            kinds: dict[str, Node] = {}
            for child in self.children:
                if plain:
                    child.name = child.name.split(" ")[0]
                if child.name in kinds:
                    _repeat(kinds[child.name], child)
                else:
                    kinds[child.name] = child
                kinds[child.name].least = 0
            self.children = sorted(kinds.values(), key=lambda c: c.name)
            if len(kinds) <= NAMED:
                break


def _repeat(one: Node, other: Node) -> None:
    """A further copy of an element on the same page."""
    pages = max(one.pages, other.pages)
    merge(one, other)
    one.most, one.pages, one.varies = 2, pages, True


def merge(one: Node, other: Node) -> Node:
    """Aligns two nodes of one name; the first becomes the expression for both."""
    one.least, one.most = min(one.least, other.least), max(one.most, other.most)
    one.pages += other.pages
    one.varies = one.varies or other.varies or one.text != other.text
    if one.loose or other.loose:
        one.children += other.children
        one.loosen()
    else:
        one.children = _aligned(one.children, other.children)
        one.settle()
    return one


def _aligned(ours: list[Node], theirs: list[Node]) -> list[Node]:
    """The alignment with the most agreeing elements; what stands on one side only becomes optional."""
    n, m = len(ours), len(theirs)
    if [c.name for c in ours] == [c.name for c in theirs]:
        return [merge(a, b) for a, b in zip(ours, theirs)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ours[i].name == theirs[j].name else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and ours[i].name == theirs[j].name:
            found.append(merge(ours[i], theirs[j]))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            ours[i].least = 0
            found.append(ours[i])
            i += 1
        else:
            theirs[j].least = 0
            found.append(theirs[j])
            j += 1
    return found


def page_tree(page: str) -> Node:
    """A page as the wrapper of itself alone. Own texts are kept as short hashes: a wrapper asks only whether they differ."""
    stack, texts, deeper = [Node("")], [[]], 0
    for kind, _, value in tokens(page):
        if kind == "open":
            if deeper or len(stack) > DEPTH:
                deeper += 1
                continue
            node = Node(value)
            stack[-1].children.append(node)
            stack.append(node)
            texts.append([])
        elif kind == "text":
            if not value.isspace():
                texts[-1].append(value)
        elif kind == "close":
            if deeper:
                deeper -= 1
                continue
            node, own = stack.pop(), texts.pop()
            if own:
                node.text = xxhash.xxh64_hexdigest(" ".join(own).encode("utf-8", "surrogatepass"))
            node.settle()
    stack[0].settle()
    return stack[0]


def expression(node: Node) -> str:
    """A wrapper as text: ``( )?`` optional, ``( )+`` and ``( )*`` repeated groups, ``#text`` a slot."""
    inner = "".join(map(expression, node.children))
    inner = f"({inner})+" if node.loose else inner
    slot = "#text" if node.varies else "text" if node.text else ""
    if not node.name:
        return inner
    body = f"<{node.name}>{slot}{inner}</{node.name.split(' ')[0]}>"
    mark = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[node.least, node.most]
    return f"({body}){mark}" if mark else body


def _is_main(name: str) -> bool:
    """A main element, or one with that role or class."""
    return "main" in name.split(" ")


class Wrapper:
    """A host's wrapper made ready to read pages: which elements, by their path of names, are template."""

    def __init__(self, root: Node):
        self.paths: dict[tuple, bool] = {}
        self._mark(root, (), False)

    def _mark(self, node: Node, path: tuple, inside: bool) -> None:
        tag = node.name.split(" ")[0]
        constant = bool(node.text) and not node.varies and node.pages >= LEAST_PAGES and tag != "body"
        template = is_template(node.name, inside) or constant
        self.paths[path] = template and self.paths.get(path, True)
        for child in node.children:
            self._mark(child, (*path, child.name), inside or tag in ("article", "main"))

    def read(self, page: str) -> str:
        """The main text of a page: decoded, white space inside a block as one blank, blocks joined by an empty line.

        The main text is in the page's own article elements, else in its main element, else in its body without the
        template part of the host. A page of which the wrapper holds all for template (copies of one page) is read
        without what never changes being left out.
        """
        low = page.lower()
        for root in ("article", "main"):
            if root in low:
                text, found = self._read(page, {}, root)
                if found:
                    return text
        return self._read(page, self.paths, "")[0] or self._read(page, {}, "")[0]

    @staticmethod
    def _read(page: str, paths: dict, root: str) -> tuple[str, bool]:
        """The text inside the elements of the kind ``root`` (all for none), and whether the page has one."""
        blocks: list[str] = []
        parts: list[str] = []
        path: list[str] = []
        skipping, wanted, articles, found = 0, 0, 0, False

        def holds(name: str) -> bool:
            return name.split(" ")[0] == "article" if root == "article" else _is_main(name)

        def end_block() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    blocks.append(text)

        for kind, tag, value in tokens(page):
            if kind == "open":
                path.append(value)
                if tag in BLOCKS:
                    end_block()
                if skipping:
                    skipping += 1
                else:
                    known = paths.get(tuple(path)) if len(path) <= DEPTH else None
                    if is_template(value, articles > 0) if known is None else known:
                        skipping = 1
                    elif root:
                        wanted += holds(value)
                        found = found or wanted > 0
                articles += tag in ("article", "main")
            elif kind == "close":
                value = path.pop()
                if tag in BLOCKS:
                    end_block()
                articles -= tag in ("article", "main")
                if skipping:
                    skipping -= 1
                elif root:
                    wanted -= holds(value)
            elif not skipping and (wanted or not root):
                parts.append(entities.unescape(value) if kind == "text" else " " if tag in ("br", "hr") else "")
                if tag == "hr":
                    end_block()
        end_block()
        return "\n\n".join(blocks), found


@functools.lru_cache(maxsize=4096)
def is_template(name: str, inside: bool) -> bool:
    """Whether an element of this name holds no main text; ``inside``: in an article or main element."""
    tag, _, called = name.partition(" ")
    if tag in TEMPLATE or tag in OUTSIDE_ONLY and not inside:
        return True
    if not called or tag in ("html", "body", "main"):
        return False
    if "hidden" in called.split(" "):
        return True
    if tag == "article":
        return bool(_NAMED_ARTICLE.search(called))
    return bool(_NAMED.search(called) or not inside and _NAMED_OUTSIDE.search(called))


@functools.lru_cache(maxsize=256)
def ready(wrapper: str) -> Wrapper:
    """A wrapper from its written form, kept per worker."""
    return Wrapper(Node.from_list(json.loads(wrapper)))


def _folded_runs(rows: DataFrame) -> DataFrame:
    """Rows (host, part, wrapper) sorted by host: the wrappers of a run of one host as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []
        for batch in batches:
            for host, part, wrapper in rows_of(batch, "host", "part", "wrapper"):
                node = Node.from_list(json.loads(wrapper))
                if held and held[:2] == (host, part):
                    held = (host, part, merge(held[2], node))
                else:
                    if held:
                        done.append(held)
                    held = (host, part, node)
            if done:
                yield _as_batch(done)
                done = []
        if held:
            yield _as_batch([held])

    return rows.mapInArrow(run, "host string, part int, wrapper string")


def _as_batch(rows: list[tuple[str, int, Node]]) -> pa.RecordBatch:
    hosts, parts, nodes = zip(*rows)
    texts = [json.dumps(n.to_list(), ensure_ascii=False, separators=(",", ":")) for n in nodes]
    return pa.RecordBatch.from_arrays(
        [pa.array(hosts), pa.array(parts, pa.int32()), pa.array(texts)], names=["host", "part", "wrapper"]
    )


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host: host, wrapper (JSON). All pages of all hosts take part; a NULL page is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() % FANOUT, {}
        for batch in batches:
            for host, page in rows_of(batch, "host", "page"):
                node = page_tree(page)
                held[host] = merge(held[host], node) if host in held else node
                if len(held) >= HOSTS_HELD:
                    yield _as_batch([(h, part, n) for h, n in held.items()])
                    held = {}
        if held:
            yield _as_batch([(h, part, n) for h, n in held.items()])

    chosen = pages.select(host_of(F.col(url)).alias("host"), plain(html).alias("page"))
    own = chosen.mapInArrow(run, "host string, part int, wrapper string")
    first = _folded_runs(own.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper"))
    second = first.withColumn("part", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper")
    return _folded_runs(second).select("host", "wrapper")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Hosts are those of the url; pages without a host are one group. Text is empty if there is none; NULL
    is the empty page. Repeated rows give repeated rows, an empty table an empty result.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    wrappers = settle(infer(pages, url, html))
    chosen = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), plain(html).alias("page"), host_of(F.col(url)).alias("host")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [ready(wrapper).read(page) for page, wrapper in rows_of(batch, "page", "wrapper")]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    joined = chosen.join(wrappers, "host").select("page_id", "url", "page", "wrapper")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
