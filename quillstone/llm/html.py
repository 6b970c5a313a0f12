"""Main text of web pages with a site style tree.

All pages of a host are merged into one tree: a node is the path of tags with their classes and identifiers (digits
left out).  Three entropies over the host's pages say how much each node's branch changes from page to page, each
divided by the logarithm of the number of pages (0: all pages have the same, 1: all differ): of what it looks like (the
order of its children), of what it says, and of what its own words say.  Copies of one page count once.  Then

* content importance is the entropy of what the branch says;
* presentation importance is the entropy of what it looks like;
* weight is the number of its words times its content importance, by that of the own words of the host's heaviest node;
* importance is content importance times the larger of presentation importance and weight.

So a branch is of low importance if it repeats, or if it always looks the same and says little beside the host's texts.
Walking down from the root, branches of low importance are taken off every page.  Within a branch whose presentation
importance is high, and inside what a page marks as its article, only those go that repeat (content importance), and
there only what isn't a line of the text itself: blocks that hold further blocks, links for the most part, a button or a
field, or that are named a thing (below).  Words within a line, bylines, notes, listings, tables, headings and single entries
or rows belong to what stands around them.  An article that repeats as a whole stays whole.

The tree can't know what it sees on few pages, nor a reader's comment by its entropy.  Therefore
elements that are menus, headers, footers, sidebars, forms, scripts or hidden by their tag, role or attribute go on every
host; a block whose class or id has a word for comments or adverts goes, unless it holds the page's first heading or the tree
finds the host's heaviest text in it; and so does one that names nothing but another such thing (``NAMES`` and ``THINGS``),
inside an article only if it is no table or list of the text.  If a page has article elements (outside of what goes) their
text is the page's, unless it has main elements with more than twice as much; then theirs is, else that of the whole page.

The text is cut into blocks at block elements; white space in a block (line breaks, too) becomes one space; blocks are
joined by an empty line; character references are decoded.

Cases: null or empty html gives an empty text; a null or odd url belongs to the host of its own empty name; pages that
break off or nest wrongly are closed as browsers close them; a self-closed svg, object or iframe is empty; very long pages
and any depth of nesting are read in time and memory in proportion to their length (no recursion); repeated pages are
answered row by row; an empty table gives no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh3_64_intdigest

from .common import by_rows, table, through_disk

#: Pages that a node must stand on to be judged, the importance below which it goes, and the presentation importance from
#: which its parts are judged by what they say alone.
LEAST_PAGES, LOW, HIGH = 5, 0.2, 0.5
#: Judged nodes (some 50 bytes each) that are sent to all tasks at most, and tasks that a host's pages are dealt over beyond.
BROADCAST_NODES, SALTS = 100_000, 64
#: What the tree says of a node: it repeats; it is of low importance; it looks different from page to page; it holds the
#: host's heaviest text, though its name says otherwise.
REPEATS, UNIMPORTANT, VARIES, HEAVIEST = 1, 2, 4, 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|object|iframe)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|textarea|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<apart>template|select|svg|object)\b[^>]*>(?:(?!<(?P=apart)\b).)*?</(?P=apart)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/a-zA-Z][^<>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")

# Element names, and the words of a class or id that names a thing beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
DROPPED = frozenset("head nav footer aside form button menu input datalist audio video canvas map".split())
#: Go outside of an article only.
OUTER = frozenset("header dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations pagination pager login signup toolbar".split()
)
OUTER_NAMES = frozenset("header masthead notice notices alert search topbar legal copyright skip".split())
#: One of these words is enough.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors".split())
NOTICES = frozenset("cookie cookies consent gdpr".split())
#: Words that may stand beside those: "share-bar" is such a thing, "share-price" isn't.
THINGS = frozenset("area bar block box button buttons container content form icons item items left link links list main notice page panel placeholder posts articles stories right section site slot top unit widget widgets wrap wrapper".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Beside these a word for comments tells of a page's state: "comments-open", "no-comments".
STATES = frozenset("open closed off on no has enabled disabled allowed without".split())
#: Elements that a class or id may name a thing: not paragraphs, headings and words within a line.
HOLDERS = frozenset("div section ul ol dl table td article aside details dialog figure iframe center".split())
#: Of these those that are part of a text as often as not: inside an article their names count if they hold links mostly.
LISTS = frozenset("ul ol dl table td figure".split())
#: What a page may put a whole thing of several blocks into.
BOXES = frozenset("div section aside details center article".split())
CONTROLS = frozenset("button input form fieldset".split())
CLOSES_P = BLOCK - {"html", "body", "legend", "caption", "tbody", "tfoot", "thead", "tr"}
SAME_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that are left out with all they hold; if one isn't closed, it ends with the element around it.
UNSEEN = frozenset("template select svg object".split())
#: Blocks that say something only with their neighbours: inside an article they go with the branch that holds them.
PARTS = frozenset("html body main h1 h2 h3 h4 h5 h6 hgroup li dt dd thead tbody tfoot tr caption figcaption legend summary".split())
#: Outside of an article the tree takes none of these off as such.
TRUNK = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup".split())
FENCES = frozenset("article main section div table td th ul ol dl body html nav aside header footer form".split())


class Node:
    """at: a number that names the node of the site's tree that this one is merged into."""

    __slots__ = ("tag", "attrs", "children", "name", "at")

    def __init__(self, tag: str, attrs: dict[str, str], above: int):
        self.tag, self.attrs, self.children = tag, attrs, []
        label = " ".join(_NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) if attrs else ""
        self.name = f"{tag}.{label}" if label else tag
        self.at = xxh3_64_intdigest(self.name, above)


class _Open:
    """The elements that are open, with the places of each tag among them, so that none is looked for twice."""

    def __init__(self, root: Node):
        self.stack, self.places, self.fences = [root], {}, []

    def add(self, node: Node) -> None:
        if node.tag in FENCES:
            self.fences.append(len(self.stack))
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, *tags: str) -> int:
        """The place of the last open element of these tags; 0 if there is none."""
        return max(self.places[t][-1] if self.places.get(t) else 0 for t in tags)

    def fence(self) -> int:
        return self.fences[-1] if self.fences else 0

    def close(self, place: int) -> None:
        """Closes the element at a place (but the root) and all within it."""
        while place and len(self.stack) > place:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            if gone.tag in FENCES:
                self.fences.pop()


def parse(text: str) -> Node:
    """The tree of a page; children are nodes and decoded strings."""
    root = Node("#", {}, 0)
    opened, at = _Open(root), 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            opened.stack[-1].children.append(markup.unescape(text[at : m.start()]))
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            place = opened.last(tag)
            if tag in FENCES or place >= opened.fence():
                opened.close(place)
            continue
        if tag in BLOCK and (place := opened.last("svg")) > max(opened.fence(), opened.last("foreignobject", "template", "object")):
            opened.close(place)  # as in browsers, a block ends an open drawing
        if tag in CLOSES_P and (place := opened.last("p")) > opened.fence():
            opened.close(place)
        if tag in SAME_CLOSE and (place := opened.last(*SAME_CLOSE[tag])) >= opened.fence():
            opened.close(place)
        raw = m["attrs"]
        attrs = {k.lower(): markup.unescape(a or b or c) for k, a, b, c in _ATTR.findall(raw)} if raw and not raw.isspace() else {}
        node = Node(tag, attrs, opened.stack[-1].at)
        if tag not in UNSEEN:
            opened.stack[-1].children.append(node)
        if tag not in VOID and not raw.endswith("/"):
            opened.add(node)
    if at < len(text):
        opened.stack[-1].children.append(markup.unescape(text[at:]))
    return root


ROOT = Node("#", {}, 0).at


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def styles(root: Node) -> dict[int, tuple]:
    """For each node of the merged tree that the page has: hashes of its looks, of what it says and of its own words (null
    without any), the number of its words and of its own words, and whether its class or id may name a thing."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    said: dict[int, tuple[bytes, int]] = {}
    found: dict[int, list] = {}
    for node in reversed(order):  # what a node holds comes before it
        looks, parts, own, words = [], [], [], 0
        for c in node.children:
            if isinstance(c, str):
                if text := c.split():
                    own += text
                    parts.append(xxh3_64_digest(" ".join(text)))
            else:
                looks.append(c.name)
                digest, n = said.pop(id(c))
                parts.append(digest)
                words += n
        says = xxh3_64_digest(b"".join(parts))
        said[id(node)] = says, words + len(own)
        x = found.setdefault(node.at, [[], [], [], 0, 0, _named(node, False) or _commented(node)])
        x[0].append(" ".join(looks))
        x[1].append(says)
        x[2] += own
        x[3] += words + len(own)
        x[4] += len(own)
    return {
        at: (xxh3_64_intdigest("\n".join(a)), xxh3_64_intdigest(b"".join(b)), xxh3_64_intdigest(" ".join(c)) if c else None, w, o, named)
        for at, (a, b, c, w, o, named) in found.items()
    }


class Weight:
    """What a branch holds: letters, those in links, whether a first heading, a control, or further blocks."""

    __slots__ = ("letters", "linked", "heads", "controls", "blocks")

    def __init__(self, node: Node):
        self.letters = self.linked = 0
        self.heads, self.controls, self.blocks = node.tag == "h1", node.tag in CONTROLS, False


def weights(root: Node) -> dict[int, Weight]:
    """Of every node, by id(); each is looked at once."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    out: dict[int, Weight] = {}
    for node in reversed(order):  # what a node holds comes before it
        w = out[id(node)] = Weight(node)
        for c in node.children:
            if isinstance(c, str):
                w.letters += len(c.strip())
            else:
                x = out[id(c)]
                w.letters, w.linked, w.heads, w.controls = w.letters + x.letters, w.linked + x.linked, w.heads or x.heads, w.controls or x.controls
                w.blocks = w.blocks or x.blocks or c.tag in BLOCK
        if node.tag == "a":
            w.linked = w.letters
    return out


def _words(node: Node) -> Iterator[list[str]]:
    """The words of each class and of the id."""
    if node.attrs:
        for token in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split():
            yield _NAME.findall(token)


def _named(node: Node, inside: bool) -> bool:
    """Whether a class or the id names a thing beside the article."""
    names = NAMES if inside else NAMES | OUTER_NAMES
    for words in _words(node):
        if node.tag in HOLDERS and any(w in names for w in words) and all(w in names or w in THINGS for w in words):
            return True
        if any(w in ADVERTS for w in words) and node.tag in HOLDERS or node.tag == "p" and any(w in ADVERTS or w in NOTICES for w in words) and all(w in NAMES or w in OUTER_NAMES or w in THINGS for w in words):
            return True
    return False


def _commented(node: Node) -> bool:
    """Whether a class or the id speaks of readers' comments."""
    return node.tag in HOLDERS and any(any(w in COMMENTS for w in words) and not any(w in STATES for w in words) for words in _words(node))


def _marked(node: Node, inside: bool) -> bool:
    """Whether tag, role or attributes say that a branch is none of the article."""
    if node.tag in DROPPED or node.tag in OUTER and not inside:
        return True
    a = node.attrs
    if not a:
        return False
    return "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or "display:none" in a.get("style", "").replace(" ", "")


def _by_name(node: Node, inside: bool, said: int, w: Weight) -> bool:
    """Whether its names take a branch off; what the tree finds to be the host's heaviest text stays."""
    if said & HEAVIEST:
        return False
    if _commented(node):
        return not w.heads
    if inside and node.tag in LISTS and 2 * w.linked < w.letters and not any(x in ADVERTS for words in _words(node) for x in words):
        return False
    return _named(node, inside)


def _goes(node: Node, inside: bool, flags: dict[int, int], weight: dict[int, Weight]) -> bool:
    """Whether a branch is taken off.  inside: only what repeats goes by the tree."""
    if _marked(node, inside):
        return True
    said, w = flags.get(node.at, 0), weight[id(node)]
    if node.tag in BLOCK and not inside and said & UNIMPORTANT and node.tag not in TRUNK:
        return True
    if node.tag in BLOCK and inside and said & REPEATS and node.tag not in PARTS and (w.controls or 2 * w.linked >= w.letters > 0 or node.tag in BOXES and w.blocks):
        return True
    return _by_name(node, inside, said, w)


def main_text(root: Node, flags: dict[int, int] | None = None) -> str:
    """The blocks of the page's article; flags: what the host's tree says of its nodes."""
    flags, weight = flags or {}, weights(root)

    def texts(marked: list[Node]) -> str:
        return "\n\n".join(b for node in marked for b in _blocks(node, True, {} if flags.get(node.at, 0) & REPEATS else flags, weight))

    for known in (flags, {}) if flags else ({},):  # where the tree would take off all marked articles, it isn't asked
        articles, mains = [], []
        todo = [(root, False)]
        while todo:
            node, within = todo.pop()
            if node.tag == "article" and not _marked(node, False) and not _by_name(node, False, known.get(node.at, 0), weight[id(node)]):
                articles.append(node)
                continue
            if node is not root and _goes(node, False, known, weight):
                continue
            main = node.tag == "main" or node.attrs.get("role") == "main"
            if main and not within:
                mains.append(node)
            todo += [(c, within or main) for c in reversed(node.children) if not isinstance(c, str)]
        own, whole = texts(articles), texts(mains)
        if text := whole if len(whole) > 2 * len(own) else own:
            return text
        if articles:
            return ""
    return "\n\n".join(_blocks(root, False, flags, weight))


def _blocks(top: Node, inside: bool, flags: dict[int, int], weight: dict[int, Weight]) -> list[str]:
    """The blocks of text of a branch in page order."""
    out, run = [], []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    todo: list[tuple] = [(c, inside) for c in reversed(top.children)]
    while todo:
        c, within = todo.pop()
        if c is None:  # a block ends
            flush()
            continue
        if isinstance(c, str):
            run.append(c)
            continue
        block = c.tag in BLOCK
        if block:
            flush()
        if _goes(c, within, flags, weight):
            continue
        if c.tag in ("br", "td", "th"):
            run.append(" ")
        within = within or c.tag not in TRUNK and bool(flags.get(c.at, 0) & VARIES)
        if block:
            todo.append((None, within))
        todo += [(x, within) for x in reversed(c.children)]
    flush()
    return out


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_trees(pages: DataFrame, least: int = LEAST_PAGES, low: float = LOW, high: float = HIGH) -> DataFrame:
    """host, node, content, presentation, importance and flags of the nodes that stand on at least ``least`` pages.

    First grouped by (host, node, kind, what, page) for copies of a page, then without the page, where counts are summed
    in the tasks before the shuffle and even a host with most of the pages is spread by its words; then by (host, node)
    with partial sums.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = styles(parse(text or ""))
                page = _signed(found[ROOT][1])
                for node, (looks, says, own, words, own_words, named) in found.items():
                    node = _signed(node)
                    out += [(host, node, 0, _signed(looks), 0, page, named), (host, node, 1, _signed(says), words, page, named)]
                    if own is not None:
                        out.append((host, node, 2, _signed(own), own_words, page, named))
            kinds = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["host", "node", "kind", "what", "words", "page", "named"])

        return step

    rows = by_rows(pages.select(host_of(F.col("url")).alias("host"), "html"), make, "host string, node long, kind byte, what long, words long, page long, named boolean")
    once = rows.groupBy("host", "node", "kind", "what", "page").agg(F.max("words").alias("words"), F.max("named").alias("named"))
    counts = once.groupBy("host", "node", "kind", "what").agg(F.count("*").alias("n"), F.max("words").alias("words"), F.max("named").alias("named"))
    n, kinds = F.col("n"), {"looks": 0, "says": 1, "own": 2}
    sums = counts.groupBy("host", "node").agg(
        *(F.sum(F.when(F.col("kind") == k, n)).alias(f"pages_{c}") for c, k in kinds.items()),
        *(F.sum(F.when(F.col("kind") == k, n * F.log(n))).alias(f"nlogn_{c}") for c, k in kinds.items()),
        *(F.sum(F.when(F.col("kind") == k, n * F.col("words"))).alias(f"words_{c}") for c, k in kinds.items()),
        F.max("named").alias("named"),
    )

    def entropy(c: str):
        pages = F.col(f"pages_{c}")
        return F.when(pages > 1, (F.log(pages) - F.col(f"nlogn_{c}") / pages) / F.log(pages)).otherwise(F.lit(0.0))

    judged = through_disk(
        sums.where(F.col("pages_looks") >= least).select(
            "host", "node", "named", entropy("looks").alias("presentation"), entropy("says").alias("content"),
            (entropy("says") * F.col("words_says") / F.col("pages_looks")).alias("mass"), F.coalesce(entropy("own") * F.col("words_own") / F.col("pages_looks"), F.lit(0.0)).alias("own_mass"),
        ), "site-nodes",
    )
    heaviest = judged.groupBy("host").agg(F.max("own_mass").alias("heaviest"))
    weight = F.when(F.col("heaviest") > 0, F.least(F.lit(1.0), F.col("mass") / F.col("heaviest"))).otherwise(1.0)
    out = judged.join(heaviest, "host").withColumn("importance", F.col("content") * F.greatest("presentation", weight))
    flags = (
        F.when(F.col("content") < low, REPEATS).otherwise(0) + F.when(F.col("importance") < low, UNIMPORTANT).otherwise(0)
        + F.when(F.col("presentation") >= high, VARIES).otherwise(0) + F.when((F.col("heaviest") > 0) & (F.col("mass") >= F.col("heaviest")) & F.col("named"), HEAVIEST).otherwise(0)
    )
    return out.select("host", "node", "content", "presentation", "importance", flags.cast("int").alias("flags"))


def extract(pages: DataFrame, least: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    The nodes that the trees have something to say about are counted first: up to ``BROADCAST_NODES`` of them go to all
    tasks and no page is shuffled; more of them meet the pages by host and a salt, each host's nodes being repeated for
    every salt, so a hot host's pages are dealt over many tasks.
    """
    nodes = through_disk(site_trees(pages, least, low).where("flags <> 0").select("host", "node", "flags"), "site-trees")
    known = nodes.groupBy("host").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "flags")))).alias("flags"))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if nodes.count() <= BROADCAST_NODES:
        rows = rows.join(F.broadcast(known), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
        rows = rows.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    rows = rows.select("page_id", "url", "html", "flags", "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, dict[int, int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = []
                for text, flags, host in zip(part.column(2).to_pylist(), part.column(3), part.column(4).to_pylist(), strict=True):
                    if host not in trees:
                        trees = {**({} if len(trees) > 1000 else trees), host: {k % (1 << 64): v for k, v in flags.as_py() or ()}}
                    texts.append(main_text(parse(text or ""), trees[host]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
