"""Main text of web pages, with site template removal.

A page is read into a tree once. The subtree of every element gets a hash of its tags, classes and text; Spark counts, for
each host, on how many pages of different main text a subtree occurs. The counts decide:

* outside ``article`` (or ``main``), and in pages that have neither, a subtree that recurs on LEAST_PAGES pages of its host
  is a template where it does so on a share LEAST_SHARE of them, or, outside an article, at all; a neutral container is one
  on MANY_PAGES pages too, however many the host has.
* within ``article`` only neutral containers can be templates, never a paragraph, heading, list or table of its own, so a
  text that is published twice isn't taken for one; copies of a page count once.
* the bar is low, NAMED_PAGES, for a subtree that calls itself, by tag, role, class or id, a menu, header, footer, sidebar,
  notice or advert, wherever it lies: it need only recur.
* Only what is too rare on its host to be judged so is judged by what it says of itself: it goes where it lies outside an
  article and occurs on under KNOWN_PAGES pages, or has such a name and occurs once. Reader comments, unlike on every page, go this way.

Scripts, styles, forms and the like have no text of the page and are never read.

Defined cases: null html is empty and gives empty text; a null url has the host ""; unclosed elements end with their
parents; a control character reference is decoded as HTML says; repeated rows each get a row; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted, steps, stored

#: A subtree is a template where it occurs in so many pages of its host, and in this part of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
#: A neutral container is one in so many pages too, however many the host has.
MANY_PAGES = 50
#: Names and places speak for subtrees on fewer pages of their host.
KNOWN_PAGES = 5
#: A subtree whose name says that it isn't main text is a template where it recurs at all.
NAMED_PAGES = 2
#: Bytes of decisions on blocks up to which they are sent to the texts; beyond, both are shuffled.
SENT = 8 << 20
#: Elements deeper than this stay at this depth, as in browsers.
DEEPEST = 512

# Fixed names of the HTML standard and of common page parts.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template", "xmp")
_INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr ins del br img".split())
_UNREAD = set("head form script style noscript template svg iframe button select textarea title object canvas audio video".split())
_NAMED = set("nav footer aside dialog menu".split())
_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_PARTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|notices|alert|comment|comments|commentlist|disqus\w*|respond|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|footer\w*|header|masthead|site-header|page-header|social|share|sharing|newsletter|subscribe|signup|related|popup|modal|overlay|pager|pagination|skip-link|widget\w*)(?:$|[\s_-])",
    re.I,
)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# what a tag holds, piece by piece: each piece is read once, and an open quote takes what is left
_INNER = re.compile(r"[^>\"'=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[=\"']")
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: An opening tag that ends open elements of the second set, up to the nearest of the third.
_P_ENDS = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_OWN = set("p h1 h2 h3 h4 h5 h6 hgroup header ul ol dl li dt dd td th tr tbody thead table blockquote pre figure figcaption".split())


class _Element:
    __slots__ = ("children", "hash", "named", "tag", "up")

    def __init__(self, tag: str, up, named: str = ""):
        self.tag, self.up, self.named, self.children, self.hash = tag, up, named, [], 0


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` ends: its ``>``, or the end of the page."""
    while at < len(page) and page[at] != ">":
        at = _INNER.match(page, at).end()
    return at


def tokens(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """kind ("/", "" for an opening tag, "!" for what isn't one), tag, attributes, start and end of all markup, each character read once."""
    at = page.find("<")
    while at >= 0:
        then = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            at = yield "!", "", "", at, end
        elif then in ("!", "?"):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            at = yield "!", "", "", at, end
        elif m := _NAME.match(page, at + 1 + (then == "/")):
            inner = _tag_end(page, m.end())
            end = min(len(page), inner + 1)
            at = yield "/" if then == "/" else "", m[0].lower(), page[m.end() : inner], at, end
        else:
            at, end = None, at + 1
        at = page.find("<", end if at is None else at)


def tree(page: str) -> _Element:
    """The page's elements; children are elements and undecoded texts."""
    root = top = _Element("#", None)
    at, depth, open_ = 0, 0, Counter()

    def up(x: _Element, k: int) -> tuple[_Element, int]:
        """From ``top`` to the parent of ``x``."""
        y = top
        while y is not x:
            open_[y.tag] -= 1
            y, k = y.up, k - 1
        open_[x.tag] -= 1
        return x.up, k - 1

    source, skip = tokens(page), None
    while True:
        try:
            kind, tag, held, start, end = source.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            top.children.append(page[at:start])
        at = end
        if kind == "!":
            continue
        if kind == "/":
            x = top if open_[tag] > 0 else None
            while x is not None and x.tag != tag:
                # an inline element's end doesn't end the block that it is in
                x = None if tag in _INLINE and x.tag not in _INLINE else x.up
            if x is not None and x.up is not None:
                top, depth = up(x, depth)
            continue
        if tag in _P_ENDS and open_["p"] > 0:
            x = top
            while x.tag in _INLINE:
                x = x.up
            if x.tag == "p":
                top, depth = up(x, depth)
        if tag in _ITEMS:
            ends, until = _ITEMS[tag]
            x, last = top, None
            while x.up is not None and x.tag not in until:
                last = x if x.tag in ends else last
                x = x.up
            if last is not None:
                top, depth = up(last, depth)
        named = ""
        if held:
            got = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(held) if k.lower() in ("class", "id", "role")}
            named = "\t".join(got.get(k, "") for k in ("class", "id", "role"))
        new = _Element(tag, top, named)
        top.children.append(new)
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            new.children.append(page[at : close.start() if close else len(page)])
            at = skip = close.end() if close else len(page)
        elif tag not in _VOID and not held.endswith("/") and depth < DEEPEST:
            top, depth = new, depth + 1
            open_[tag] += 1
    if at < len(page):
        top.children.append(page[at:])
    return root


def _boilerplate(x: _Element, inside: bool) -> bool:
    """Whether an element calls itself something else than main text."""
    if x.tag in _NAMED or x.tag == "header" and not inside:
        return True
    if not x.named or x.tag in ("html", "body", "article", "main"):
        return False
    *names, role = x.named.split("\t")
    return role in _ROLES or any(n and _PARTS.search(n) for n in names)


def parsed(page: str) -> tuple[list[tuple[str, list[int], list[int], bool]], list[int]]:
    """The blocks of text, each with the hashes of the subtrees around it that could be templates, those of them that go if they are rare, and whether it lies in the main part or there is none; and all such hashes of the page."""
    root = tree(page)
    order, i = [root], 0
    while i < len(order):  # parents before children
        order += [c for c in order[i].children if isinstance(c, _Element)]
        i += 1
    main = [x for x in order if x.tag == "article"] or [x for x in order if x.tag == "main" or x.named.endswith("\tmain")]
    around = {id(root)}
    for x in main:
        while id(x) not in around:
            around.add(id(x))
            x = x.up
    within = {id(x) for x in main}
    for x in order:
        if x.up is not None and id(x.up) in within:
            within.add(id(x))
    candidates = set()
    for x in reversed(order):
        text = "\x01".join(c if isinstance(c, str) else f"\x02{c.hash}" for c in x.children)
        x.hash = int.from_bytes(hashlib.blake2b(f"{x.tag}\x00{x.named}\x00{' '.join(text.split())}".encode(), digest_size=8).digest(), "big", signed=True)
        # the last bits: a neutral container; outside an article that the page has; named as something else than main text
        x.hash = x.hash & ~7 | (x.tag not in _OWN and x.tag not in _INLINE) | 2 * bool(main and id(x) not in within) | 4 * _boilerplate(x, id(x) in within)
        if id(x) not in around and x.tag not in ("#", "html", "head", "body", "main", "article", "meta", "br", "img", "link", "hr") and not (id(x) in within and (x.tag in _OWN or x.tag in _INLINE)):
            candidates.add(id(x))
    blocks, current, path, rare, stack = [], [], [], [], []

    def flush():
        if text := " ".join(html.unescape("".join(current)).split()):
            blocks.append((text, list(path), list(rare), not main or bool(stack) and id(stack[-1]) in within))
        current.clear()

    todo = [(root, False)]
    while todo:
        x, leave = todo.pop()
        if isinstance(x, str):
            current.append(x)
            continue
        # what lies between main parts has no subtree of its own
        block = x.tag not in _INLINE or id(x.up) in around and id(x) not in within
        if leave:
            if block:
                flush()
            if id(x) in candidates:
                path.pop()
                if rare and rare[-1] == x.hash:
                    rare.pop()
            stack.pop()
            continue
        if x.tag in _UNREAD and id(x) not in around:
            if block:
                flush()
            continue
        if block:
            flush()
        elif x.tag in ("br", "img"):
            current.append(" ")
        stack.append(x)
        if id(x) in candidates:
            path.append(x.hash)
            if x.hash & 6:
                rare.append(x.hash)
        todo.append((x, True))
        todo += [(c, False) for c in reversed(x.children)]
    flush()
    # text of its own that stands beside the main part belongs to no subtree that could be counted
    kept = [b for b in blocks if b[3] or b[1]]
    return kept, sorted({x.hash for x in order if id(x) in candidates})


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES, known_pages: int = KNOWN_PAGES, named_pages: int = NAMED_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    schema = "row long, page_id long, url string, host string, digest long, blocks array<struct<text: string, path: array<long>, rare: array<long>>>, subtrees array<long>"
    block = pa.struct([("text", pa.string()), ("path", pa.list_(pa.int64())), ("rare", pa.list_(pa.int64()))])
    arrow = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("digest", pa.int64()), ("blocks", pa.list_(block)), ("subtrees", pa.list_(pa.int64()))])

    def run(batches):
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        for part in steps(batches, "html"):
            rows = []
            for page_id, url, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                blocks, subtrees = parsed(page.decode())
                text = "\n".join(t for t, _, rare, inside in blocks if inside and not rare)
                digest = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)
                joined = []  # neighbours of one fate are one block
                for t, path, rare, _ in blocks:
                    if joined and (joined[-1]["path"], joined[-1]["rare"]) == (path, rare):
                        joined[-1]["text"] += "\n" + t
                    else:
                        joined.append({"text": t, "path": path, "rare": rare})
                rows.append({"row": task << 33 | count, "page_id": page_id, "url": url, "host": host(url), "digest": digest, "blocks": joined, "subtrees": subtrees})
                count += 1
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    read = stored(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).mapInArrow(run, schema), "pages", "zstd")
    neutral, beside, named = (F.col("subtree").bitwiseAND(F.lit(bit)) > 0 for bit in (1, 2, 4))
    # each main text counts once for a host, however many pages have it
    seen = read.select("host", "digest", F.explode("subtrees").alias("subtree")).distinct()
    often = seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(named, min(named_pages, least_pages)).otherwise(min(least_pages, known_pages)))
    sizes = read.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("of"))
    template = named & (F.col("n") >= named_pages) | (F.col("n") >= least_pages) & (beside | (F.col("n") >= least_share * F.col("of")) | neutral & (F.col("n") >= F.greatest(F.lit(many_pages), F.lit(least_pages))))
    judged = salted(often, sizes, ["host"]).select("host", "subtree", template.alias("gone"))
    mine = read.select("row", "host", F.explode(F.array_distinct(F.flatten("blocks.path"))).alias("subtree"))
    found = salted(mine, judged, ["host", "subtree"]).groupBy("row").agg(F.collect_set(F.when(F.col("gone"), F.col("subtree"))).alias("gone"), F.collect_set("subtree").alias("known"))
    # which blocks stay is worked out without texts; most pages keep just the blocks that no subtree could take away
    none = F.array().cast("array<long>")
    places = read.select("row", F.col("blocks.path").alias("paths"), F.col("blocks.rare").alias("rares")).where(F.exists("paths", lambda p: F.size(p) > 0))
    fate = places.join(found, "row", "left").withColumns({"gone": F.coalesce("gone", none), "known": F.coalesce("known", none)})
    stays = F.zip_with("paths", "rares", lambda p, r: ~F.arrays_overlap(p, F.col("gone")) & (F.size(F.array_except(r, F.col("known"))) == 0))
    fate = fate.select("row", "paths", stays.alias("stays"))
    more = stored(fate.where(F.exists(F.zip_with("paths", "stays", lambda p, k: k & (F.size(p) > 0)), lambda x: x)).select("row", "stays"), "stays")
    size = more.agg(F.coalesce(F.sum(F.size("stays") + 16), F.lit(0))).first()[0]
    out = read.select("row", "page_id", "url", "blocks").join(F.broadcast(more) if size <= SENT else more, "row", "left")
    sure = F.filter("blocks", lambda b: F.size(b["path"]) == 0)
    kept = F.when(F.col("stays").isNull(), sure).otherwise(F.filter("blocks", lambda b, i: F.col("stays")[i]))
    return out.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
