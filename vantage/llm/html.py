"""Main text of pages: a style tree for each site, and the removal of branches of low importance.

The pages of a host are merged by path: tags and classes from the root, what the names say, and whether an article lies
within. An element's importance mixes two entropies over the pages that have its path, each to the base of their number: of
its presentation (the sequence of its children) and of its content (the text below it). What looks and reads alike on every
page of a site is furniture. The importance of every element, articles included, decides; tags, roles and class names only
set its prior:

- ``CORE``: an article or main element, or a wrapper of one: half of the importance is given, the other half is earned.
- ``PLAIN``: no name speaks for or against it.
- ``OUTSIDE``: plain, but beside the articles of a page that has some, or with a name that partly hints at furniture: half.
- ``NAMED``: named as furniture outright by tag, role or class: a tenth, so it goes on any site.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.storage import materialise, pages

#: Weight of content against presentation, and importance below which a branch goes.
GAMMA, LEAST_IMPORTANCE = 0.8, 0.15
#: An unseen page on which all is important counts as this many pages, so a host of few pages is trusted little.
PRIOR_PAGES = 0.5
CORE, PLAIN, OUTSIDE, NAMED = 0, 1, 2, 3
#: Importance is the first number plus the second times the entropies.
PRIOR = {CORE: (0.5, 0.5), PLAIN: (0.0, 1.0), OUTSIDE: (0.0, 0.5), NAMED: (0.0, 0.1)}
#: Low paths of all hosts that may be broadcast (about 40 bytes each). Beyond, pages are joined with those of their host.
BROADCAST_PATHS = 1_000_000
#: Pages of one host that a task reads then.
HOST_PAGES = 2_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select option button canvas audio video title".split())
FURNITURE = RAW | frozenset("head nav footer aside form dialog menu label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of these names, up to the nearest of the second set.
CLOSES = {
    **{t: ({"p"}, frozenset({"td", "th", "button"})) for t in BLOCK - {"caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}},
    "li": ({"li", "p"}, frozenset({"ul", "ol", "menu"})),
    "dt": ({"dt", "dd", "p"}, frozenset({"dl"})),
    "dd": ({"dt", "dd", "p"}, frozenset({"dl"})),
    "tr": ({"tr", "td", "th", "p"}, frozenset({"table"})),
    "td": ({"td", "th", "p"}, frozenset({"tr", "table"})),
    "th": ({"td", "th", "p"}, frozenset({"tr", "table"})),
    "option": ({"option"}, frozenset({"select"})),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of a class name or id that name furniture.
NAMES = re.compile(
    r"(?:ads?|adbox|advert\w*|adsense|sponsor\w*|promo\w*|banners?|nav\w*|menus?|breadcrumbs?|sidebars?|masthead|topbar|toolbar|footer|cookies?|consent|gdpr|notice|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|paywall|share|sharing|social|comments?|disqus|replies|reply|respond|related|recommend\w*|widgets?|pagination|pager|skip|skiplink|hidden)",
    re.I,
)
#: Parts that say nothing beside such a part, and parts that say nothing after one.
NEUTRAL = frozenset("area bar block bottom box btn button buttons card container cta form group icon icons inner item items left level link links list message mobile outer panel policy primary right secondary section side slot thread to top unit wrap wrapper".split())
AFTER = NEUTRAL | frozenset("author body content date header heading main meta page site text title".split())
READERS = frozenset("comment comments disqus replies reply".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
WHITE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    tag: str
    style: str = ""  # sorted class names, digits as 0
    named: int = PLAIN  # what the names say: PLAIN, OUTSIDE (a hint) or NAMED
    core: bool = False  # an article or main element, or a wrapper of one
    kind: int = PLAIN
    path: int = 0
    base: int = 0  # the path that the importance is measured against
    children: list = field(default_factory=list)  # nodes and strings in page order


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)


def hints(label: str, article: bool = False) -> int:
    """What class names and an id say: NAMED if one is made of furniture words, OUTSIDE if one has such a word among others.

    For an article element a hint at readers' comments, adverts or related articles is enough.
    """
    worst = PLAIN
    for name in label.split():
        parts = [x.lower() for x in re.split(r"[^0-9A-Za-z]+|(?<=[a-z])(?=[A-Z])", name) if x and not x.isdigit()]
        found = [NAMES.fullmatch(x) is not None for x in parts]
        if any(found):
            rest = {x for f, x in zip(found, parts, strict=True) if not f}
            named = rest <= NEUTRAL or found[0] and rest <= AFTER or parts[0] in READERS or article and re.match(r"comment|repl|ads?$|advert|promo|related", parts[found.index(True)])
            worst = max(worst, NAMED if named else OUTSIDE)
        elif parts == ["site", "header"]:
            worst = NAMED
    return worst


def parse(html: str) -> Node:
    """A tree of the page that forgives unclosed and misnested tags; comments, markup and raw-text elements leave no text."""
    root = Node("")
    stack, at, size = [root], 0, len(html)
    lowered = None
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None or not m[4]:  # comment, declaration, or a tag cut off by the end of the page
            continue
        name = name.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    del stack[depth:]
                    break
                if name not in BLOCK and stack[depth].tag in BLOCK:
                    break
            continue
        if name in CLOSES:
            closes, walls = CLOSES[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in walls:
                    break
                if stack[depth].tag in closes:
                    del stack[depth:]
        node = Node(name, named=NAMED if name in FURNITURE else PLAIN)
        if m[3].strip(" /\n\t"):
            attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])}
            node.style = DIGITS.sub("0", " ".join(sorted(attrs.get("class", "").split())))
            if name not in ("html", "body", "main"):
                node.named = max(node.named, hints(f"{attrs.get('class', '')} {attrs.get('id', '')}", name == "article"))
            if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
                node.named = NAMED
        stack[-1].children.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            lowered = html.lower() if lowered is None else lowered
            if len(lowered) != size:  # a few letters change their length in lower case
                end = re.compile(f"</{name}", re.I).search(html, at)
                stop = end.start() if end else size
            else:
                stop = lowered.find(f"</{name}", at)
                stop = size if stop < 0 else stop
            close = html.find(">", stop)
            at = size if close < 0 else close + 1
            continue
        stack.append(node)
    place(root)
    return root


def place(root: Node) -> None:
    """Set kind, path and base of every element.

    An element that holds a main or article element is a wrapper, unless its name is furniture outright and it holds
    articles alone. The importance of what lies in an article is measured against that of the article, so on a site that
    repeats whole articles sameness inside them tells nothing; all else is measured against the whole page.
    """
    order = list(elements(root))
    mains: set[int] = set()
    for node in reversed(order):
        inner = [c for c in node.children if not isinstance(c, str)]
        if node.tag == "main" or any(id(c) in mains for c in inner):
            mains.add(id(node))
        node.core = id(node) in mains or (node.named != NAMED or node.tag == "form") and (node.tag == "article" or any(c.core for c in inner))
    root.path = root.base = 1
    root.kind = CORE
    stack = [(root, False, False, root.core)]  # within an article, within furniture, and whether the page has a core
    while stack:
        node, inside, gone, cored = stack.pop()
        for c in node.children:
            if isinstance(c, str):
                continue
            named = NAMED if c.tag == "header" and not inside and not c.core else c.named
            if gone:
                c.kind = NAMED
            elif c.core or c.tag in ("html", "body"):
                c.kind = CORE
            else:
                c.kind = max(named, OUTSIDE if cored and not inside else PLAIN)
            c.path = _hash(node.path, c.tag, c.style, c.kind)
            within = inside or c.tag in ("article", "main") and c.core
            c.base = node.base if not within or inside else c.path
            stack.append((c, within, gone or c.kind == NAMED, cored))


def elements(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]


def styles(root: Node) -> Iterator[tuple[int, int, int, int, int]]:
    """(path, base, kind, presentation, content) of every element but those below furniture by name, which go with it."""
    order = list(elements(root))
    content: dict[int, int] = {}
    below: set[int] = set()
    for node in order:
        if node.kind == NAMED or id(node) in below:
            below.update(id(c) for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        if node.tag in RAW or node.tag == "head":
            content[id(node)] = 0  # never text
            continue
        if id(node) in below:
            parts = [content[id(c)] for c in node.children if not isinstance(c, str)]
            content[id(node)] = _hash(*parts, *(c for c in node.children if isinstance(c, str)))
            continue
        parts = [xxhash.xxh64_intdigest(WHITE.sub(" ", c).strip().encode("utf-8", "replace")) if isinstance(c, str) else content[id(c)] for c in node.children]
        content[id(node)] = _hash(*parts)
        yield node.path, node.base, node.kind, _hash(*dict.fromkeys(c.tag for c in node.children if not isinstance(c, str))), content[id(node)]


def main_text(root: Node, low: frozenset[int]) -> str:
    """Blocks in page order without branches of ``low`` paths, two line feeds between them. Markup that is never text is left out."""
    out: list[str] = []
    line: list[str] = []
    stack: list = [None, *reversed(root.children)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            line.append(item)
            continue
        if item is not None and item.tag == "br":
            line.append(" ")
            continue
        if item is None or item.tag in BLOCK:
            text = WHITE.sub(" ", entities.unescape("".join(line))).strip()
            if text:
                out.append(text)
            line.clear()
        if item is None or item.tag in RAW or item.tag == "head" or item.path in low:
            continue
        if item.tag in BLOCK:
            stack.append(None)
        stack += reversed(item.children)
    return "\n\n".join(out)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def style_tree(table: DataFrame) -> DataFrame:
    """``(host, path, pages, importance)`` of every path of every host.

    ``table`` has host and html. Counts by (host, path, feature) are combined in each task before the shuffle; entropies
    need sums of ``n log n`` alone, so a host with a third of the pages is no larger group than its distinct features.
    Both entropies are smoothed by ``PRIOR_PAGES``, so a single page is all-important but for its names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 2000):
                part, seen = whole.slice(row, 2000), Counter()
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own: dict[tuple, list] = {}
                    for path, base, kind, look, text in styles(parse(html or "")):
                        own.setdefault((path, base, kind), []).append((look, text))
                    for key, found in own.items():  # a page has one feature of each kind for each path
                        seen[host, *key, 0, _hash(*(x for x, _ in found))] += 1
                        seen[host, *key, 1, _hash(*(x for _, x in found))] += 1
                if seen:
                    cols = list(zip(*(k + (n,) for k, n in seen.items()), strict=True))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "path", "base", "kind", "part", "feature", "n"])

    key = ["host", "path", "base", "kind"]
    counts = table.mapInArrow(count, "host string, path long, base long, kind int, part int, feature long, n long").groupBy(*key, "part", "feature").agg(F.sum("n").alias("n"))
    paths = counts.groupBy(*key).agg(
        *(F.sum(F.when(F.col("part") == k, F.col("n") * F.log("n"))).alias(f"nlogn{k}") for k in (0, 1)),
        F.sum(F.when(F.col("part") == 1, F.col("n"))).alias("pages"),
    )
    log_pages = F.log(F.greatest("pages", F.lit(2)))
    entropy = [F.when(F.col("pages") > 1, (F.log("pages") - F.col(f"nlogn{k}") / F.col("pages")) / log_pages).otherwise(1.0) for k in (0, 1)]
    mixed = (1 - GAMMA) * entropy[0] + GAMMA * entropy[1]
    scored = materialise(paths.select(*key, "pages", ((F.col("pages") * mixed + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)).alias("own")))
    against = scored.select("host", F.col("path").alias("base"), F.col("own").alias("whole"))  # a path of a host is one row
    held = scored.join(against, ["host", "base"], "left").withColumn("relative", F.least(F.lit(1.0), F.col("own") / F.coalesce(F.greatest("whole", F.lit(1e-9)), F.lit(1.0))))
    given, earned = (F.element_at(F.create_map(*(F.lit(x) for k, p in PRIOR.items() for x in (k, p[i]))), F.col("kind")) for i in (0, 1))
    return held.select("host", "path", "pages", (given + earned * F.col("relative")).alias("importance"))


def extract(table: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row.

    Null html gives an empty text, a null or odd URL the empty host, and repeated rows are extracted each for itself. Of a
    host with few pages the names decide most. Other columns are left out. Html is shuffled only if the low paths
    of all hosts are too many to broadcast.
    """
    own = table.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    low = materialise(style_tree(own.select("host", "html")).where(F.col("importance") < LEAST_IMPORTANCE).groupBy("host").agg(F.collect_list("path").alias("low")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 500):
                part = whole.slice(row, 500)
                texts = [main_text(parse(h or ""), frozenset(p or ())) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = table.schema[page_id].dataType.simpleString()
    if (low.agg(F.sum(F.size("low") + 1)).first()[0] or 0) <= broadcast_paths:
        joined = own.join(F.broadcast(low), "host", "left")
    else:  # a host with a third of the pages is dealt over as many tasks as its pages fill
        parts = own.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).alias("parts"))
        spread = low.join(parts, "host").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("host", "salt", "low")
        most = parts.where("parts > 1")
        dealt = own.join(F.broadcast(most) if most.count() <= broadcast_paths // 10 else most, "host", "left")
        dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1).cast("long"))))
        joined = dealt.join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; nulls, empty and repeated pages as in ``extract``, and no rows from an empty table."""
    return extract(pages(spark, sf_dir))
