"""HTML extraction by a site style tree.

Every page is parsed to a tree of elements; the trees of one host are merged:
elements that stand on the same path of tags and classes are one node of the
site's style tree. Over the host's pages a node collects presentation styles
(the sequences of its children) and content features (its texts). Both have an
entropy: styles that differ from page to page make a node important, and texts
that recur over the pages make it noise. A node's importance combines that of
its presentation, which weighs more the more children it has, with that of the
content below it. A host's main branch holds its most important text; branches
beside it whose importance is below a share of its own are cut from each page.

The tree is over all elements. Besides it there is a prior: elements whose tag,
role, class or id says that they are no content (navigation, adverts, notices,
forms, comments and the like) are left out, as on a host of one page, or with
menus that change from page to page, entropies cannot tell. Names count by their
words: what tells of the layout (``no-sidebar``) says nothing, what stands around
an article (headers, notices) is content inside it, and an element that turns
out to have the article in it is kept from there on.

Pages of a host that have the same blocks are one content, and count once.
Features are counted as hashes with partial sums before the shuffle, so a host
with a third of all pages is no hot task; a site's tree is bounded by the number
of its distinct paths. Elements below ``MAX_DEPTH`` belong to their ancestor's
node at that depth.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, frugal, rows_to_batches, scratch, small_batches
from .url_filters import host_and_path

#: Share of the main branch's importance below which a branch goes, and what each child takes from the weight of a node's content.
LEAST_IMPORTANCE = 0.75
ATTENUATION = 0.9
MAX_DEPTH = 64
#: Hosts' cut nodes are broadcast up to so many, and else joined with salted keys.
BROADCAST_NODES = 1 << 18
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
#: Elements that are never part of the main text, and words of a class, id or role that say so.
DROPPED = frozenset("head script style noscript template iframe svg math object embed canvas nav footer aside form button select option input textarea label fieldset dialog menu title xmp audio video".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption center".split())
#: Words of a class, id or role that say that an element is no content: those of what stands around an article, and the others.
#: ``OWN`` are content inside an article: its heading's wrapper, its warnings.
OWN = frozenset("header alert".split())
AROUND = frozenset("banner notice notification alert widget header masthead footer contentinfo complementary copyright toolbar login signup search sidebar".split())
NOISE = AROUND | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs comment comments commentlist respond replies disqus"
    " share sharing social related recommend recommended recommendations newsletter subscribe pagination pager".split()
)
#: A token that begins so tells of a page's layout, not of an element's kind.
LAYOUT = frozenset("no not non without with has have is hide hides show shows layout page body".split())
_JOINED = re.compile("side[-_]bar|skip[-_]link")
#: An open element of the first kind ends where one of the second begins.
_CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_CLOSED_BY = {tag: [kind for kind, by in _CLOSES.items() if tag in by] for tag in frozenset().union(*_CLOSES.values())}
_SCOPES = frozenset("html body article aside section div main nav header footer table ul ol dl form blockquote td th li figure".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)  # the last form: a quote is never closed
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_DIGITS = re.compile(r"\d+")
_SPACES = re.compile(r"\s+")


#: How the prior sees an element: content; dropped but for an article, or but for a ``main``, inside it; and dropped.
KEPT, BUT_ARTICLE, BUT_MAIN, GONE = range(4)


class Element:
    """An open element: its path in the style tree, how the prior sees it, and what it is in: the block, and whether an article."""

    __slots__ = ("tag", "path", "dropped", "children", "block", "in_article")

    def __init__(self, tag: str, path: tuple[str, ...], dropped: int, above: Element | None):
        self.tag, self.path, self.dropped, self.children = tag, path, dropped, []
        self.block = self if above is None or tag in BLOCK else above.block
        self.in_article = tag in ("article", "main") or (above is not None and above.in_article)

    def holder(self) -> Element:
        """The innermost element that holds this one's text: no inline one, unless it is dropped otherwise."""
        return self.block if self.block.dropped == self.dropped else self


def _noise(marks: str, in_article: bool) -> int:
    """What the tokens of a class, id or role say of an element, by their words."""
    found = KEPT
    for token in _JOINED.sub("sidebar", marks.lower()).split():
        words = re.split("[-_]", token)
        if words[0] in LAYOUT:
            continue
        said = NOISE.intersection(words) - (OWN if in_article else frozenset())
        if said:
            found = max(found, BUT_MAIN if said - AROUND else BUT_ARTICLE)
    return found


def _signature(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """The element's name in the style tree, and how the prior sees it."""
    dropped = GONE if tag in DROPPED or (tag == "header" and not in_article) else KEPT
    if not attributes.strip():
        return tag, dropped
    named = {m[0].lower(): m[1] or m[2] or m[3] for m in _NAMED.findall(attributes)}
    name = tag
    for key in ("id", "class", "role"):
        if value := named.get(key):
            name += f"{'#.@'[('id', 'class', 'role').index(key)]}{_DIGITS.sub('0', _SPACES.sub('.', value.strip().lower()))}"
    hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true"
    marks = " ".join(named.get(k, "") for k in ("class", "id", "role"))
    if tag not in ("html", "body", "main"):
        dropped = max(dropped, _noise(marks, in_article))
    return name, GONE if hidden else dropped


def parse(page: str) -> tuple[list[tuple[tuple[str, ...], bool, str]], list[tuple[tuple[str, ...], bool, tuple[str, ...]]]]:
    """(blocks, elements) of a page.

    A block is (path of the element that holds it, dropped by the prior, text);
    text is decoded, its white space made single spaces. An element is (path,
    dropped, names of its children). Open tags need not be closed: a new block
    ends a paragraph, and end tags close what was left open inside them.
    """
    blocks: list[tuple[tuple[str, ...], bool, str]] = []
    elements: list[tuple[tuple[str, ...], bool, tuple[str, ...]]] = []
    root = Element("", (), KEPT, None)
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack a tag is open
    scopes: list[int] = [0]  # and where elements are that an end inside them does not leave
    text: list[str] = []
    holder = root

    def flush() -> None:
        if text:
            whole = _SPACES.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                blocks.append((holder.path, holder.dropped > KEPT, whole))
            text.clear()

    def close(count: int) -> None:
        nonlocal holder
        for _ in range(count):
            element = stack.pop()
            places[element.tag].pop()
            if scopes[-1] == len(stack):
                scopes.pop()
            if element.tag in BLOCK or element.dropped != stack[-1].dropped:
                flush()
            elements.append((element.path, element.dropped > KEPT, tuple(element.children)))
        if not text:
            holder = stack[-1].holder()

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        run = page[at : found.start() if found else end]
        if run:
            if not text:
                holder = stack[-1].holder()
            text.append(run)
        if not found:
            break
        at = found.end()
        ending, tag, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            depth = innermost((tag,))
            if depth and (tag in BLOCK or depth >= scopes[-1]):
                close(len(stack) - depth)
            continue
        if tag == "br":
            text.append(" ") if text else None
            continue
        if tag in _CLOSED_BY:
            depth = innermost(_CLOSED_BY[tag])
            if depth and depth >= scopes[-1]:
                close(len(stack) - depth)
        parent = stack[-1]
        name, dropped = _signature(tag, attributes, parent.in_article)
        if dropped or parent.dropped > {"article": BUT_ARTICLE, "main": BUT_MAIN}.get(tag, KEPT):
            dropped = max(dropped, parent.dropped)
        parent.children.append(name)
        if tag in BLOCK or dropped != parent.dropped:
            flush()
        if tag in VOID:
            continue
        element = Element(tag, (*parent.path, name) if len(parent.path) < MAX_DEPTH else parent.path, dropped, parent)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>|$", re.I).search(page, at)
            elements.append((element.path, True, ()))
            at = max(stop.end(), at)
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPES:
            scopes.append(len(stack))
        stack.append(element)
        if not text:
            holder = element.holder()
    close(len(stack) - 1)
    flush()
    return blocks, elements


def node_id(path: tuple[str, ...]) -> int:
    return xxhash.xxh3_64_intdigest("/".join(path)) - (1 << 63)


_FEATURES = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("node", T.LongType()),
        T.StructField("above", T.ArrayType(T.LongType())),
        T.StructField("kind", T.IntegerType()),
        T.StructField("feature", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("content", T.LongType()),
    ]
)
_STYLE, _TEXT, _PAGE, _NODE = range(4)


def _hashed(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, once each: a node's styles (``size`` children) and texts (``size`` characters), as hashes, and a row for the page, beside the hash of its blocks; and the nodes with the ids from the root down to them."""
    wanted = arrow_schema(_FEATURES)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, elements = parse(page or "")
                seen = {(path, _STYLE, _hashed(*children), len(children)) for path, _, children in elements if children}
                seen |= {(path, _TEXT, _hashed(text), len(text)) for path, _, text in blocks}
                content = _hashed(*("/".join(path) + "\0" + text for path, dropped, text in blocks if not dropped))
                yield host, 0, None, _PAGE, 0, 0, content
                for path in {path for path, *_ in seen}:
                    yield host, node_id(path), [node_id(path[:k]) for k in range(len(path) + 1)], _NODE, 0, 0, 0
                for path, kind, feature, size in seen:
                    yield host, node_id(path), None, kind, feature, size, content

    yield from rows_to_batches(rows(), wanted)


def importances(pages: DataFrame) -> DataFrame:
    """``host, node, above, importance, amount, main, main_above, main_importance``: the nodes of each host's style tree that have text below them.

    ``pages`` has ``host`` and ``html``. Pages with the same kept blocks are one.
    With m pages, a text that n of them have is worth 1 - log_m n, and content
    the mean of its texts; presentation is worth the entropy of a node's styles
    (base: the pages that have it; 1 if one has it). ``amount`` is the characters
    of texts in the node itself times their worth; the main branch is the parent
    of the node with most of it, or, where all texts are below that, the node.
    """
    features = pages.select("host", "html").mapInArrow(frugal(_features), _FEATURES)
    counts = scratch(features.distinct().groupBy("host", "node", "above", "kind", "feature", "size").agg(F.count("*").alias("n")), "counts")
    hosts = counts.where(F.col("kind") == _PAGE).select("host", F.col("n").alias("m"))
    nodes = counts.where(F.col("kind") == _NODE).select("host", "node", "above")
    sums = [F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("n_ln"), F.sum(F.ln("n")).alias("ln"), F.count("*").alias("kinds"), F.sum(F.col("size") * F.col("n")).alias("sized")]
    own = counts.where(F.col("kind") <= _TEXT).groupBy("host", "node", "kind").agg(*sums).join(hosts, "host")
    worth = 1 - F.col("ln") / F.col("kinds") / F.ln(F.greatest(F.lit(2), F.col("m")))
    texts = own.where(F.col("kind") == _TEXT).select("host", "node", worth.alias("worth"), "kinds", (worth * F.col("sized")).alias("amount"))
    entropy = F.when(F.col("total") > 1, F.least(F.lit(1.0), (F.ln("total") - F.col("n_ln") / F.col("total")) / F.ln("total"))).otherwise(1.0)
    styles = own.where(F.col("kind") == _STYLE).select("host", "node", entropy.alias("style"), F.pow(F.lit(ATTENUATION), F.col("sized") / F.col("total")).alias("left"))
    placed = scratch(nodes.join(texts, ["host", "node"], "left").join(styles, ["host", "node"], "left"), "nodes")
    # A branch's content: the texts of all nodes below it, by one aggregation over their ancestors.
    below = placed.where("worth is not null").select("host", F.explode("above").alias("node"), "worth", "kinds")
    below = below.groupBy("host", "node").agg((F.sum(F.col("worth") * F.col("kinds")) / F.sum("kinds")).alias("held"), F.count("*").alias("n_texts"))
    left = F.coalesce("left", F.lit(1.0))
    valued = placed.join(below, ["host", "node"]).select("host", "node", "above", ((1 - left) * F.coalesce("style", F.lit(0.0)) + left * F.col("held")).alias("importance"), F.coalesce("amount", F.lit(0.0)).alias("amount"), "n_texts")
    valued = scratch(valued, "importances")
    main = valued.groupBy("host").agg(F.max_by("above", F.struct("amount", "node")).alias("path"), F.max("n_texts").alias("every"))
    main = main.withColumn("node", F.get("path", F.size("path") - 2)).join(valued.select("host", "node", "n_texts"), ["host", "node"], "left")
    main = main.select("host", F.when(F.col("n_texts") < F.col("every"), F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path")).alias("main_above"))
    main = main.withColumn("main", F.element_at("main_above", -1))
    worth_of_main = valued.select("host", F.col("node").alias("main"), F.col("importance").alias("main_importance"))
    return valued.drop("n_texts").join(main.join(worth_of_main, ["host", "main"]), "host")


def low_nodes(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """``host, low``: of each host, the nodes whose branches are cut; none of them is above, or below, the main one."""
    beside = ~F.array_contains("main_above", F.col("node")) & ~F.array_contains("above", F.col("main"))
    low = importances(pages).where(beside & (F.col("importance") < F.lit(least) * F.col("main_importance")))
    return low.groupBy("host").agg(F.collect_set("node").alias("low"))


def page_text(page: str | None, low: frozenset[int] | set[int] = frozenset(), prior: bool = True) -> str:
    """The page's main text: its blocks but for those that the prior drops and those below a node in ``low``.

    Without ``prior`` only scripts, styles and what else no browser shows goes.
    """
    blocks, _ = parse(page or "")
    verdicts: dict[tuple[str, ...], bool] = {}

    def is_low(path: tuple[str, ...]) -> bool:
        if path not in verdicts:
            verdicts[path] = any(node_id(path[:k]) in low for k in range(1, len(path) + 1))
        return verdicts[path]

    return "\n".join(text for path, dropped, text in blocks if not (dropped and (prior or "head" in path)) and not (low and is_low(path)))


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, prior: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    A null page has an empty text. Pages of a null url, or one without host,
    count to the host of the empty name. Every row gets its text, repeated ones too,
    but copies weigh as one page in the site's tree; an empty table gives no rows; other columns are not looked at.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", host_and_path(F.col("url"))[0].alias("host"), "html")
    low = scratch(low_nodes(rows, least), "low")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    wanted = arrow_schema(schema)
    shared = None
    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_NODES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: frozenset(r["low"]) for r in low.toLocalIterator()})  # BROADCAST_NODES at most
        joined = rows
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                page_ids, urls, hosts, pages, *lows = (c.to_pylist() for c in batch.columns)
                for page_id, url, page, low in zip(page_ids, urls, pages, lows[0] if lows else map(shared.value.get, hosts), strict=True):
                    text = page_text(page, frozenset(low or ()), prior)
                    yield page_id, url, text, len(text)

        yield from rows_to_batches(rows(), wanted, lambda r: len(r[2]))

    columns = ["page_id", "url", "host", "html"] + ([] if shared else ["low"])
    return joined.select(*columns).mapInArrow(frugal(run), schema)
