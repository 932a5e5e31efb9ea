"""Main text of web pages, with what a site repeats on its pages taken out.

Each page becomes a tree once; every element subtree gets a hash of its tag, its class and
its content. Spark counts on how many different pages of a host a subtree occurs. A subtree
that recurs on many of them at one place, or on most of a URL section, is template and goes, as do the elements whose tag, role or
class says what they are (menus, forms, adverts, comments and so on). Copies of one page
count once, so that an article published twice does not turn into template.
"""

from __future__ import annotations

import html
import itertools
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.runtime import write_stage

#: A subtree is template from this many pages of a host on whose other text differs, if it
#: sits at one place on this share of the pages that have it: half of them, or nearly all
#: where it is to go from a marked article. How many other pages the host has does not count.
MANY_PAGES, SAME_PLACE, ARTICLE_PLACE = 10, 0.5, 0.9
#: Fewer different pages are enough if they are most of a URL section of the host; inside a
#: marked article MANY_PAGES of them must be nearly all of one. Headings and paragraphs of
#: an article can be quotes wherever they stand, so there the place speaks only for boxes.
MIN_PAGES, SECTION_SHARE, ARTICLE_SHARE = 3, 0.5, 0.9
BOXES = frozenset("div section ul ol dl table aside details figure center".split())

# Elements by what they do in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button input select option optgroup textarea label fieldset"
    " iframe object embed applet svg canvas audio video map menu dialog datalist".split()
)
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr caption ul".split()
)
CLOSES_P = BLOCKS - {"html", "body", "tr", "tbody", "thead", "tfoot", "caption"}
P_BORDER = frozenset("html body table td th caption button object".split())
#: A start tag ends the nearest of these open elements, unless one of the borders lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies"
    " consent gdpr notice popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond disqus discussion"
    " share sharing social related recommended breadcrumb breadcrumbs pagination pager widget search masthead toolbar skip".split()
)
#: Inside an article or main element only these go by their class.
WRAPPERS = frozenset("div span ul ol dl table".split())
#: A form with this share of the page's text is its frame and not a form to fill in.
FRAME_SHARE = 0.5
#: Only outside an article, where a heading of the page is meant and not one of the article.
DROPPED_OUTSIDE = frozenset("header topbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CLASS_WORD = re.compile(r"[^a-z0-9]+")

#: Elements nested deeper become siblings at this depth, as in browsers; a page's work then grows with its length.
MAX_DEPTH = 64
#: Templates (host, subtree) up to this number are broadcast, at most about 20 MB; more are joined by shuffle.
BROADCAST_TEMPLATES = 200_000

_PAGE = "uid long, page_id long, url string, host long, body long, scoped boolean, texts array<string>, paths array<array<long>>, section int, nodes array<struct<node: long, place: int, rest: int, box: boolean>>"


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class _Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "article", "main", "framed", "number", "hash", "links", "chars", "linked", "mark", "depth")

    def __init__(self, tag: str, parent: "_Node | None", attributes: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.depth = 0 if parent is None else parent.depth + 1
        self.parts: list = []
        self.number = (0, 1)
        self.links = self.chars = self.linked = self.hash = 0
        role, kinds = attributes.get("role", "").lower(), attributes.get("class", "").lower().split()
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
        self.mark = names.strip()
        words = set(_CLASS_WORD.split(names))
        self.article = (parent is not None and parent.article) or tag == "article"
        self.main = (parent is not None and parent.main) or tag == "main" or role == "main"
        inside = self.article or self.main
        # the story's own sections, headings and slugs use such words too; there only a whole class of a wrapper counts
        named = (tag in WRAPPERS and not DROPPED_WORDS.isdisjoint(kinds)) if inside else not words.isdisjoint(DROPPED_WORDS)
        hidden = (
            "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        )
        self.framed = not hidden and not named and role not in DROPPED_ROLES - {"form"}
        self.dropped = (
            tag in DROPPED
            or role in DROPPED_ROLES
            or hidden
            or (tag not in ("html", "body", "article", "main") and named)
            or (tag == "article" and ("comment" in kinds or "comments" in kinds))
            or (not inside and (tag == "header" or not words.isdisjoint(DROPPED_OUTSIDE)) and tag not in ("html", "body"))
        )


def parse(source: str) -> _Node:
    """The element tree of a page; unclosed, misnested and cut-off tags are put right as browsers do."""
    root = node = _Node("#page", None, {})
    at, end = 0, len(source)
    while at < end:
        found = _TOKEN.search(source, at)
        text = source[at : found.start()] if found else source[at:]
        if text:
            node.parts.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag = name.lower()
        if found[1] or found[4]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(found[3] or found[6] or "")}
        if tag in CLOSES_P:
            node = _close(node, {"p"}, P_BORDER)
        if tag in ENDS:
            node = _close(node, *ENDS[tag])
        if tag == "body":
            while node.parent is not None and node.tag != "html":
                node = node.parent
        if node.depth >= MAX_DEPTH and tag not in VOID and tag not in RAW:
            node = node.parent
        child = _Node(tag, node, attributes)
        node.parts.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            child.parts.append(source[at : close.start()] if close else source[at:])
            at = close.end() if close else end
        elif tag not in VOID:
            node = child
    return root


def _close(node: _Node, ended, borders) -> _Node:
    up = node
    while up is not None and up.tag not in borders:
        if up.tag in ended:
            return up.parent
        up = up.parent
    return node


def _measure(root: _Node) -> None:
    """Hash, text length and linked length of every subtree, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, _Node)]
    for node in reversed(order):
        seen = [node.tag, node.mark]
        for part in node.parts:
            if isinstance(part, _Node):
                seen.append(f"<{part.hash}")
                node.chars += part.chars
                node.links += part.links
                node.linked += part.linked
            else:
                words = " ".join(part.split())
                node.chars += 0 if node.tag in RAW else len(words)
                if words:
                    seen.append(words)
        if node.tag == "a":
            node.links, node.linked = node.links + 1, node.chars
        node.hash = _hash("\x1f".join(seen))


def _drop(root: _Node) -> None:
    """Hands dropping down from an element to all below it, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "form" and node.framed and node.chars >= FRAME_SHARE * root.chars:
            node.dropped = False
        node.dropped = node.dropped or (node.parent is not None and node.parent.dropped)
        below = [p for p in node.parts if isinstance(p, _Node)]
        for i, child in enumerate(below):
            child.number = (i, len(below))
        stack += below


def _scope(blocks: list) -> tuple[bool, list]:
    """The blocks of the main elements, else of the articles, if most of the text is there; else all."""
    total = sum(len(b[0]) for b in blocks)
    for at in (3, 2):
        marked = [b for b in blocks if b[at]]
        if marked and 2 * sum(len(b[0]) for b in marked) >= total:
            return True, marked
    return False, blocks


def _is_menu(node: _Node) -> bool:
    """A list or box of links and nothing else."""
    return node.tag in ("ul", "ol", "div", "section", "p", "table") and node.links > 1 and node.linked >= 0.8 * node.chars


def _place(node: _Node) -> int:
    """Where an element sits: the tags above it, and its number among its siblings from the nearer end."""
    above, up = [], node.parent
    while up is not None:
        above.append(up.tag)
        up = up.parent
    number, of = node.number
    return _short(f"{node.tag} {number if 2 * number < of else number - of} {' '.join(above)}")


def _short(text: str) -> int:
    return (_hash(text) & 0xFFFFFFFF) - (1 << 31)


def _nodes(blocks: list[tuple[str, list[_Node]]]) -> list[tuple[int, int, int, bool]]:
    """(hash, place, longest block outside, is it a box) of every subtree around a block, each hash once."""
    first: dict[int, tuple[_Node, list[int]]] = {}  # hash: an element, [first block in it, last block, how many]
    for at, (_, path) in enumerate(blocks):
        for node in path:
            known = first.get(node.hash)
            if known is None:
                first[node.hash] = (node, [at, at, 1])
            else:  # at most once in a path: an element differs from what is in it
                known[1][1], known[1][2] = at, known[1][2] + 1
    keys = [(-len(text), text) for text, _ in blocks]
    before, after = list(itertools.accumulate(keys, min)), list(itertools.accumulate(reversed(keys), min))[::-1]
    inside: dict[int, set[int]] = {h: set() for h, (_, (lo, hi, n)) in first.items() if n != hi - lo + 1}
    if inside:  # copies with other blocks between them
        for at, (_, path) in enumerate(blocks):
            for node in path:
                if node.hash in inside:
                    inside[node.hash].add(at)
    longest = sorted(range(len(blocks)), key=keys.__getitem__) if inside else []
    out: dict[int, tuple[int, int, int, bool]] = {}
    for h, (node, (lo, hi, _)) in first.items():
        if h in inside:
            rest = next((blocks[i][0] for i in longest if i not in inside[h]), "")
        else:
            rest = min(before[lo - 1 : lo] + after[hi + 1 : hi + 2], default=(0, ""))[1]
        out[h] = (h, _place(node), _short(rest), node.tag in BOXES)
    return list(out.values())


def page_blocks(source: str) -> tuple[bool, list[str], list[list[int]]]:
    """(text is that of a marked article, block texts, hashes of the subtrees around each block)."""
    scoped, blocks = _blocks(source)
    return scoped, [text for text, _ in blocks], [[n.hash for n in path] for _, path in blocks]


def _blocks(source: str) -> tuple[bool, list[tuple[str, list[_Node]]]]:
    """The same with the elements around each block, nearest first."""
    root = parse(source)
    _measure(root)
    _drop(root)
    blocks: list[tuple[str, _Node, bool, bool]] = []
    buffer: list[str] = []

    def flush(node: _Node) -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            blocks.append((text, node, node.article, node.main))

    stack: list[tuple[_Node, int]] = [(root, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and (node.tag in BLOCKS):
            flush(node.parent or node)
        while i < len(node.parts):
            part = node.parts[i]
            i += 1
            if not isinstance(part, _Node):
                buffer.append(part)
            elif part.tag == "br" or part.tag in ("td", "th"):
                buffer.append(" ")
                if part.parts and not part.dropped:
                    stack += [(node, i), (part, 0)]
                    break
            elif part.dropped:
                if part.tag in BLOCKS:
                    flush(node)
            else:
                stack += [(node, i), (part, 0)]
                break
        else:
            if node.tag in BLOCKS:
                flush(node)
            elif node.tag in ("td", "th"):
                buffer.append(" ")
    flush(root)
    scoped, blocks = _scope(blocks)
    out = []
    for text, node, *_ in blocks:
        path, up, menu = [], node, False
        while up is not None and up.tag not in ("#page", "html", "body"):
            if not scoped and _is_menu(up):
                menu = True
            if up.tag not in ("article", "main"):
                path.append(up)
            up = up.parent
        if not menu:
            out.append((text, path))
    return scoped, out


def host_of(url: str | None) -> str | None:
    """Host of a URL in lower case; null when there is none, which then has no template."""
    try:
        return urlsplit(url or "").hostname or None
    except ValueError:
        return None


def _section(url: str | None) -> str:
    """First folder of the path of a URL, empty for pages at the top."""
    try:
        return "/".join(urlsplit(url or "").path.lstrip("/").split("/")[:-1][:1])
    except ValueError:
        return ""


def _pages(pages: DataFrame) -> DataFrame:
    def run(batches):
        names = "uid page_id url host body scoped texts paths section nodes".split()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))]
        kinds += [pa.int32(), pa.list_(pa.struct([("node", pa.int64()), ("place", pa.int32()), ("rest", pa.int32()), ("box", pa.bool_())]))]
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for lo in range(0, batch.num_rows, 512):
                out = []
                for uid, page_id, url, source in zip(*(c[lo : lo + 512] for c in columns)):
                    scoped, blocks = _blocks(source or "")
                    texts, paths = [text for text, _ in blocks], [[n.hash for n in path] for _, path in blocks]
                    host = host_of(url)
                    out.append((uid, page_id, url, None if host is None else _hash(host), _hash("\n".join(texts)), scoped, texts, paths, _short(_section(url)), [dict(zip(("node", "place", "rest", "box"), n)) for n in _nodes(blocks)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return write_stage(pages.mapInArrow(run, _PAGE), "pages")


def _templates(pages: DataFrame) -> DataFrame:
    """(host, node, strong) of the subtrees that recur; copies of a page count as one page."""
    hosted, at = pages.where("host IS NOT NULL"), ["host", "node"]
    sections = hosted.select("host", "section", "body").distinct().groupBy("host", "section").agg(F.count("*").alias("of"))
    each = hosted.select("host", "body", "section", F.inline("nodes")).distinct()
    # a copy in another section or place is no other page, so bodies count once per subtree first
    pages_of = each.groupBy(*at, "body").agg(F.min("place").alias("place"), F.min("rest").alias("rest"), F.first("box").alias("box"), F.collect_set("section").alias("sections"))
    often = pages_of.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    many = write_stage(pages_of.join(often, at), "recurring")
    placed = many.groupBy(*at, "place", "n", "box").agg(F.count("*").alias("here")).groupBy(*at).agg(F.max(F.col("here") / F.col("n")).alias("placed"), F.bool_or("box").alias("box"))
    rests = many.select(*at, "rest").distinct().groupBy(*at).agg(F.count("*").alias("rests"))
    shares = many.select(*at, F.explode("sections").alias("section")).groupBy(*at, "section").agg(F.count("*").alias("here")).where(F.col("here") >= MIN_PAGES)
    share = F.col("here") / F.col("of")
    shares = shares.join(sections, ["host", "section"]).groupBy(*at).agg(
        F.max(share).alias("share"), F.bool_or((F.col("here") >= MANY_PAGES) & (share >= ARTICLE_SHARE)).alias("nearly_all")
    )
    rows = placed.join(rests, at).join(shares, at, "left")
    weak = ((F.col("rests") >= MANY_PAGES) & (F.col("placed") >= SAME_PLACE)) | (F.coalesce("share", F.lit(0.0)) >= SECTION_SHARE)
    strong = (F.col("box") & (F.col("rests") >= MANY_PAGES) & (F.col("placed") >= ARTICLE_PLACE)) | F.coalesce("nearly_all", F.lit(False))
    return rows.where(weak | strong).select(*at, strong.alias("strong"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page.

    The text is that of the page's main element, else of its article elements, if these hold
    most of the kept text, else of its body, without dropped elements and template subtrees: white space in a block is one
    space, blocks are joined by a line feed in page order. Null, empty and text-free pages
    give an empty text. A page without a host has no template. Repeated rows and ids give a
    row each; other columns are not read.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    )
    stage = _pages(rows)
    template = write_stage(_templates(stage), "templates")
    if template.count() <= BROADCAST_TEMPLATES:
        # of checked size: each page meets the templates of its host without moving
        mine = template.groupBy("host").agg(
            F.collect_set("node").alias("weak"), F.collect_set(F.when(F.col("strong"), F.col("node"))).alias("strong")
        )
        out = stage.join(F.broadcast(mine), "host", "left").withColumn("template", F.when(F.col("scoped"), F.col("strong")).otherwise(F.col("weak")))
    else:
        marked = (
            stage.where("host IS NOT NULL")
            .select("uid", "host", "scoped", F.explode(F.array_distinct(F.flatten("paths"))).alias("node"))
            .join(template, ["host", "node"])
            .where(~F.col("scoped") | F.col("strong"))
            .groupBy("uid")
            .agg(F.collect_set("node").alias("template"))  # at most the subtrees of one page
        )
        out = stage.join(marked, "uid", "left")
    kept = F.filter(F.arrays_zip("texts", "paths"), lambda b: ~F.arrays_overlap(b["paths"], F.col("template")))
    text = F.when(F.coalesce(F.size("template") < 1, F.lit(True)), F.concat_ws("\n", "texts"))
    text = text.otherwise(F.concat_ws("\n", F.transform(kept, lambda b: b["texts"])))
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
