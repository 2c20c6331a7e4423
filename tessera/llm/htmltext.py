"""HTML extraction by template deduction from equivalence classes of tokens.

Tokens are block elements with their path and class, and texts with the path they stand at. The occurrence vector of a token
over the pages of one host is kept as two sums (count, and count times a hash of the page), which add up over any partitions,
so a host with a third of all pages needs no task of its own. Tokens of a host with equal vectors form an equivalence class. A
class is valid if it is large and frequent enough and, on the page, its tokens keep one order and their spans nest with
those of the other valid classes; valid classes are the host's template. Texts of the template go; the other texts are its
slots, and the deepest element of the template that holds most of the slots' characters is the region of the main text.
Article and main elements widen that region, or narrow it where it holds more than they do. Tag names and class words
only take page furniture (menus, comments, adverts) out of the slots. Hosts with too few pages have no vectors to compare:
every page stands for itself, and article and main elements alone give the region.

Pages are read by a tokenizer of one pass that accepts any text as HTML: work and memory grow with the page's length only,
whatever it nests or leaves open.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Elements without end tag, that end a block, whose text is never shown, and that are page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style head title template noscript iframe object svg canvas math audio video select textarea button".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
#: Elements whose content is no markup, that may stand in a head, and that a block element closes.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
IN_HEAD = frozenset("base link meta script style title noscript template".split())
FOREIGN = ("svg", "math", "select")
#: Elements that can be the region of a main text.
REGIONS = frozenset("article body div main section td center fieldset figure".split())
#: Words of class, id and role that name page furniture.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header masthead menu modal nav navbar navigation newsletter "
    "notice pagination popup promo related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: How classes begin that say what a region has or lacks, not what it is, and classes of whole layouts.
STATES = ("has-", "with-", "no-", "is-", "without-")
LAYOUTS = frozenset("layout page wrapper wrap container site content main root app".split())
#: Elements that an opening tag closes if they stand open: tag -> (closed elements, elements that bound the search).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOUNDS_P = frozenset("button td th li article div section body".split())
#: A class needs so many pages, and a text such a share of its host's pages, to be template.
LEAST_PAGES, TEXT_SHARE = 4, 0.5
#: So many texts of the template that outweigh a region's slots are the article's own: the page is one of many copies.
COPIED = 3
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TELLING = re.compile(r"(?i)class|id|role|hidden|style")
_NOT_SHOWN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_RAW_END = {t: re.compile(rf"(?i)</{t}(?![^\s/>])") for t in RAW}
#: The token that every page has once.
PAGE = 0
#: Bits of a path: furniture by class words, furniture by tag, article, main, can be a region, first heading.
WORD, TAG, ARTICLE, MAIN, REGION, TITLE = (1 << i for i in range(6))


def _key(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def markup(html: str):
    """(text, "", "") for text, ("", tag, attributes) for a start tag, ("", "/tag", "") for an end tag, in order."""
    at, loose = 0, False
    while m := _START.search(html, at):
        if m.start() > at:
            yield html[at : m.start()], "", ""
        comment, odd, slash, tag = m.groups()
        at = m.end()
        if comment:
            end = html.find("-->", m.start() + 2)
            at = end + 3 if end >= 0 else len(html)
            continue
        whole = None if odd or slash or loose else _REST.match(html, at)
        if whole:
            end = whole.end() - 1
        else:
            loose = loose or not (odd or slash)  # a quote is never closed: from here on quotes do not count
            end = html.find(">", at)
            end = end if end >= 0 else len(html)
        attributes, at = html[at:end], end + 1
        if odd:
            continue
        tag = tag.lower()
        yield "", "/" * bool(slash) + tag, attributes
        if not slash and tag in RAW:
            m = _RAW_END[tag].search(html, at)
            at = m.start() if m else len(html)
    if at < len(html):
        yield html[at:], "", ""


class Page:
    """The tokens of one page in order, its distinct paths of block elements, and its blocks of text.

    A path has a key, its parent's number, the place of its first token, how often it occurs and its bits.
    """

    def __init__(self, html: str):
        self.keys: list[int] = [PAGE]
        self.numbers: dict[int, int] = {PAGE: 0}
        self.paths: list[list[int]] = [[PAGE, -1, 0, 1, 0]]
        self.blocks: list[tuple[int, str, int]] = []
        self.pending: list[str] = []
        #: Open elements that are blocks or not shown: tag, number of the path, hidden, inside an article.
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.open: dict[str, list[int]] = {}
        for text, tag, attributes in markup(html):
            if text:
                if not self.stack[-1][2]:
                    self.pending.append(unescape(text) if "&" in text else text)
            elif tag[0] == "/":
                self.end(tag[1:])
            else:
                self.start(tag, attributes)
        self.block()

    def block(self) -> None:
        if self.pending:
            text = _SPACE.sub(" ", "".join(self.pending)).strip()
            self.pending = []
            if text:
                path = self.stack[-1][1]
                self.blocks.append((len(self.keys), text, path))
                self.keys.append(_key(self.paths[path][0], text))

    def top(self, tags) -> int:
        """Where the innermost open element of these tags stands; 0 for none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def pop(self, at: int) -> None:
        if any(x[0] in BLOCK for x in self.stack[at:]):
            self.block()
        for tag, *_ in self.stack[at:]:
            self.open[tag].pop()
        del self.stack[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if not self.stack[-1][2]:
                self.pending.append(" ")
            return
        block = tag in BLOCK
        if block:
            if at := self.top(FOREIGN):
                self.pop(at)
            if tag in ENDS_P and (at := self.top(("p",))) > self.top(BOUNDS_P):
                self.pop(at)
            closed, bound = CLOSES.get(tag, ((), ()))
            low = self.top(bound)
            if self.top(closed) > low:
                self.pop(min(p for t in closed for p in self.open.get(t, ()) if p > low))
        if self.open.get("head") and tag not in IN_HEAD and tag != "head":
            self.pop(self.open["head"][-1])
        label, marked, hidden = "", False, tag in HIDDEN
        article = self.stack[-1][3]
        if attributes and _TELLING.search(attributes):
            names = {k.lower(): a or b or c for k, a, b, c in reversed(_ATTRIBUTE.findall(attributes))}
            label = " ".join(sorted(names.get("class", "").split()))
            marks = [x for k in ("class", "id", "role") for x in names.get(k, "").lower().split() if not x.startswith(STATES)]
            words = {w for x in marks for w in _WORDS.findall(x)} - ({"header"} if article else set())
            marked = bool(MARKS & words) and not LAYOUTS & set(marks) and tag not in ("html", "body", "main", "article")
            hidden = hidden or "hidden" in names or names.get("aria-hidden") == "true" or bool(_NOT_SHOWN.search(names.get("style", "")))
        if block:
            self.block()
            bits = WORD * marked | TAG * (tag in FURNITURE and not (tag == "header" and article)) | ARTICLE * (tag == "article") | MAIN * (tag == "main") | REGION * (tag in REGIONS) | TITLE * (tag == "h1")
            parent = self.stack[-1][1]
            key = _key(self.paths[parent][0], tag, label, bits)
            number = self.numbers.setdefault(key, len(self.paths))
            if number == len(self.paths):
                self.paths.append([key, parent, len(self.keys), 0, bits])
            self.paths[number][3] += 1
            self.keys.append(key)
        else:
            number, hidden = self.stack[-1][1], hidden or marked  # what is marked within a block of text is not of the text
        if tag not in VOID and (block or hidden):
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, number, self.stack[-1][2] or hidden, article or tag in ("article", "main")))

    def end(self, tag: str) -> None:
        if places := self.open.get(tag):
            if tag in BLOCK or not any(x[0] in BLOCK for x in self.stack[places[-1] + 1 :]):
                self.pop(places[-1])
        elif tag in BLOCK:
            self.block()


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased; the whole text if it has no scheme, "" for null."""
    return F.lower(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)[\s\S]*$", "$1"))


_PARSED = "page_id long, url string, host string, keys array<long>, counts array<int>, places array<int>, at array<int>, texts array<string>, path array<int>, parent array<int>, first array<int>, times array<int>, bits array<int>"


def _parse(batches):
    for batch in batches:
        rows = []
        for html in batch.column(3):
            page = Page(html.as_py() or "")
            keys, places, counts = np.unique(np.array(page.keys, np.int64), return_index=True, return_counts=True)
            at, texts, path = zip(*page.blocks, strict=True) if page.blocks else ((), (), ())
            _, parent, first, times, bits = zip(*page.paths, strict=True)
            rows.append((keys, counts, places, at, texts, path, parent, first, times, bits))
        columns = list(zip(*rows, strict=True)) or [[]] * 10
        types = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 5)]
        new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *new], names=[x.split()[0] for x in _PARSED.split(", ")])


def templates(parsed: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's large and frequent equivalence classes, as (key, class, mean place).

    A token's occurrence vector is its counts by page; its sums tell vectors apart. Frequent is LEAST_PAGES pages and
    TEXT_SHARE of the host's, so a host's template is at most twice its mean page; large is two tokens or more.
    """
    token = F.explode(F.arrays_zip("keys", "counts", "places")).alias("t")
    rows = parsed.select("host", "page_id", token).select("host", "page_id", "t.keys", "t.counts", "t.places")
    mark = F.xxhash64("page_id", "counts").cast("decimal(38,0)")
    vectors = rows.groupBy("host", "keys").agg(F.count("*").alias("pages"), F.sum("counts").alias("n"), F.sum(mark).alias("mark"), F.avg("places").alias("place")).where(F.col("pages") >= LEAST_PAGES)
    hosts = vectors.where(F.col("keys") == PAGE).select("host", F.col("pages").alias("all"))
    frequent = vectors.join(hosts, "host").where(F.col("pages") >= F.col("all") * TEXT_SHARE)
    member = F.struct("keys", "place")
    classes = frequent.groupBy("host", "pages", "n", "mark").agg(F.collect_list(member).alias("tokens")).where(F.size("tokens") >= 2)
    classes = classes.select("host", F.xxhash64("pages", "n", "mark").alias("class"), F.explode("tokens").alias("m"))
    return classes.groupBy("host").agg(F.collect_list(F.struct("m.keys", "class", "m.place")).alias("template"))


def template_places(keys: list[int], places: list[int], template: list[dict]) -> set[int]:
    """Tokens of this page that belong to valid classes: in the host's order, and nested or apart from other classes."""
    where = dict(zip(keys, places, strict=True))
    classes: dict[int, list[tuple[float, int, int]]] = {}
    for t in template:
        if t["keys"] in where:
            classes.setdefault(t["class"], []).append((t["place"], where[t["keys"]], t["keys"]))
    valid: list[tuple[int, int, list[int]]] = []
    for tokens in sorted(classes.values(), key=lambda x: -len(x)):
        tokens.sort()
        seen = [p for _, p, _ in tokens]
        if seen != sorted(seen):
            continue
        lo, hi = seen[0], seen[-1]
        if all(hi < a or lo > b or (a <= lo and hi <= b) or (lo <= a and b <= hi) for a, b, _ in valid):
            valid.append((lo, hi, [k for _, _, k in tokens]))
    return {where[k] for _, _, own in valid for k in own}


def main_text(row: dict, fixed: set[int]) -> list[str]:
    """The blocks of a parsed page that are its main text, in order; fixed are the places of the template's tokens."""
    at, texts, path, parent, bits = row["at"], row["texts"], row["path"], row["parent"], row["bits"]
    n = len(parent)

    def down(own: list, join) -> list:
        """own, joined with what the parent has."""
        for p in range(1, n):
            own[p] = join(own[parent[p]], own[p])
        return own

    def sums(blocks: list[int]) -> list[int]:
        """Characters of these blocks at or below each path."""
        out = [0] * n
        for b in blocks:
            out[path[b]] += len(texts[b])
        for p in range(n - 1, 0, -1):
            out[parent[p]] += out[p]
        return out

    either = lambda a, b: a or b
    article = down([b & (ARTICLE | MAIN) > 0 for b in bits], either)
    own = sums([b for b in range(len(texts)) if article[path[b]]])
    # a marked element around most of the articles' text is a layout, not furniture
    furniture = down([b & TAG > 0 or (b & WORD > 0 and (article[p] or 2 * own[p] <= own[0])) for p, b in enumerate(bits)], either)
    blocks = [b for b in range(len(texts)) if not furniture[path[b]]]
    repeated = {(path[b], texts[b]) for b in range(len(texts)) if at[b] in fixed}
    slots = {b for b in blocks if (path[b], texts[b]) not in repeated}
    weight = sums([b for b in blocks if b in slots or article[path[b]]])
    within = [True] * n
    if fixed and slots:
        region = max((p for p in range(n) if 2 * weight[p] > weight[0] and (not p or (bits[p] & REGION and row["times"][p] == 1 and row["first"][p] in fixed))), default=0)
        if article[region]:
            up = region
            while up and not bits[up] & ARTICLE:
                up = parent[up]
            while not up and not bits[region] & MAIN:
                region = parent[region]
            region = up or region
        else:
            region = max((p for p in range(n) if bits[p] & (ARTICLE | MAIN) and not furniture[p] and 5 * weight[p] >= weight[0]), key=lambda p: (weight[p], -p), default=region)
        within = down([p == region for p in range(n)], either)
    elif any(article[path[b]] for b in blocks):
        within = article
    inside = [b for b in blocks if within[path[b]]]
    kept = [b for b in inside if b in slots]
    gone = [b for b in inside if b not in slots]
    if not kept or (len(gone) >= COPIED and sum(len(texts[b]) for b in gone) > sum(len(texts[b]) for b in kept)):
        kept = inside
    titles = [b for b in slots if bits[path[b]] & TITLE and not within[path[b]]]
    return [texts[b] for b in sorted({*kept, *titles})]


def _extract(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            out.append("\n".join(main_text(row, template_places(row["keys"], row["places"], row["template"] or []))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    The host's template decides: its texts go from every page, inside article and main elements too, and the slots in the
    deepest element of the template that holds most of their characters stay, with a first heading that stands apart. That
    element grows to the article or main around it; if it holds a fifth of its characters in an article, the largest such is
    taken. Pages of hosts with fewer than LEAST_PAGES pages, and pages without slots, keep what stands in article or main,
    or else everything. Furniture and hidden elements always go. Texts of the template that outweigh the slots of the
    region, COPIED at least, stay: such a page is a copy of others of its host.

    Any text is accepted as HTML, of any length and depth; null html is empty; null url is a host of its own; repeated rows
    are pages like any others; ties of template classes are settled by place; other columns are not read; an empty table
    gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    parsed = materialize(rows.mapInArrow(_parse, _PARSED), "parsed")
    named = materialize(templates(parsed), "templates")
    joined = parsed.join(named, "host", "left").select("page_id", "url", "keys", "places", "at", "texts", "path", "parent", "first", "times", "bits", "template")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
