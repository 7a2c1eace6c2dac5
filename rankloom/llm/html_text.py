"""Main text of web pages: differencing against the pages of nearest URL, then structure of the markup.

Pages are put in order by host and URL path.  The text blocks of a page are aligned with those of its
two nearest pages of the host by a longest common subsequence; blocks that are shared are the site's,
not the page's, and are deleted.  A neighbour that shares nearly all of a page's text (``COPY``) is a
copy and tells nothing of the template; it is passed over.  The alignment is asked about every block.  Blocks inside an element that the page
itself marks as its article are kept where one near page shares them (quotations, licence lines), and
deleted where the nearest pages and the next ones, three to four together, all hold them.  Of what no
page shares, elements marked as navigation, header, footer, sidebar, notice, advert, form or comment
are deleted by that mark; inside an article only elements, roles and whole names count as marks, not parts of
a name (share-buttons is one, share-price is not).  Each page tells how many blocks went either way.

A first job reads the keys alone: it divides their order into ranges and finds, for the borders of each,
the pages within reach on the other side.  The second parses pages, sends each page's blocks (of site
elements only their hashes) to its range, and those of the pages at borders to the range beside it too.
So a page has the same neighbours however many ranges there are, and a host of any size is split.  Both
sides of a comparison tell lines apart by 64-bit hashes.  Alignment, parsing and memory are bounded:
alignment is bit-parallel, with rows of the table kept at intervals.

Defined results: null or empty html has an empty text; a null URL counts as host and path ''; markup
that is cut off ends where the page ends (an unfinished tag or script is dropped, an unfinished
character reference stays as it is); repeated pages give each their text and are one neighbour.  Pages
of equal URL are in the order of page_id.  An empty table gives an empty result.  Columns not named are
not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Hashable, Iterator, Sequence
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import even_keys, partitions, short_batches, table
from rankloom.llm.url_filter import host_path

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video title textarea select button head".split())
#: Elements that bound a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul option".split()
)
#: Blocks that other elements stand in; the others end where the next block begins.
HOLDER = BLOCK - frozenset("p hr li dt dd tr h1 h2 h3 h4 h5 h6 option html body tbody thead tfoot".split()) | frozenset({"span", "td"})
BOILERPLATE = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class and id names by which pages call an element an advert, a menu and so on: whole, or as a beginning.
WHOLE = frozenset("ad ads alert comment comments consent login modal nav notice notices promo related reply replies respond share sharing skip social widget".split())
BEGINNINGS = ("adbanner", "adslot", "advert", "banner", "breadcrumb", "commentbox", "commentform", "commentlist", "cookie", "disqus", "footer", "menu", "navbar", "navigation", "newsletter", "pagination", "popup", "recommend", "sidebar", "signup", "sponsor", "subscri", "toolbar")
HEADERS = ("header", "masthead", "topbar")
#: What may follow such a part in a name within an article (share-buttons, but not share-price).
HOLDERS = frozenset("area bar bars block blocks box boxes button buttons container count footer form group header icon icons inner item items line link links list outer panel post posts row section slot text thread title unit wrap wrapper zone".split())
ARTICLES = frozenset("article-body article-content articlebody post-content post-body entry-content main-content story-body".split())

_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_ASKED = frozenset("class id role itemprop hidden style aria-hidden".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_PART = re.compile(r"[^a-z0-9]+")
_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}

SITE, PLAIN, ARTICLE = 0, 1, 2
#: Pages that are asked about article blocks, and how many of them must be no copies to tell.
REACH, LEAST_PAGES = 4, 3
#: The share of a page's text from which on a page that holds it is a copy.
COPY = 0.95


def _marked(names: str, inside: bool) -> bool:
    """Whether class and id names call an element none of the article's.

    Outside of articles any part of a name tells; ``inside`` one the whole name must be of such parts, followed at most by words for a holder.
    """
    calls = lambda x: x in WHOLE or x.startswith(BEGINNINGS)
    if not inside:
        return any(calls(x) for x in _PART.split(names) if x)
    for name in names.split():
        parts = [x for x in _PART.split(name) if x]
        if parts and calls(parts[0]) and all(calls(x) or x in HOLDERS or x.isdigit() for x in parts[1:]):
            return True
    return False


def _kind(tag: str, attributes: str, outer: int) -> int:
    """What the blocks inside an element are, given what those around it are."""
    if outer == SITE:
        return SITE
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in _ASKED} if attributes else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return SITE
    names = f"{found.get('class', '')} {found.get('id', '')}"
    parts = [x for x in _PART.split(names) if x]
    if tag in BOILERPLATE or found.get("role") in ROLES or _marked(names, outer == ARTICLE):
        return SITE
    if outer != ARTICLE and (tag == "header" or any(x.startswith(HEADERS) for x in parts)):
        return SITE
    if tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articlebody" or ARTICLES & set(names.split()):
        return ARTICLE
    return outer


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, white space as single spaces, each with its kind."""
    page = page or ""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    open_: dict[str, int] = {}  # how many elements of each name are open
    single = False  # the block itself is marked as none of the article's
    at, end = 0, len(page)
    last_quote = page.rfind('"')
    unclosed: set[str] = set()  # names of raw elements that end nowhere from here on

    def flush() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            out.append((block, SITE if single else stack[-1][1]))

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text.append(html.unescape(page[at:]))
            break
        if lt > at:
            text.append(html.unescape(page[at:lt]))
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = end if close < 0 else close + 3
            else:
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            continue
        closing = after == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if not after:  # cut off
                break
            text.append("<")
            at = lt + 1
            continue
        gt = first = page.find(">", name.end())
        odd = gt >= 0 and page.count('"', name.end(), gt) % 2
        while gt >= 0 and odd:  # a > within quotes
            quote = page.find('"', gt) if gt < last_quote else -1
            if quote < 0:
                gt = first
                break
            gt = page.find(">", quote)
            odd = gt >= 0 and not page.count('"', quote, gt) % 2
        if gt < 0:
            break
        tag, attributes, at = name[0].lower(), page[name.end() : gt], gt + 1
        if closing:
            if tag in BLOCK:
                flush()
                single = False
            if tag in HOLDER and open_.get(tag):
                kind = stack[-1][1]
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                if stack[depth - 1][1] != kind:
                    flush()
                for name_, _ in stack[depth:]:
                    open_[name_] -= 1
                del stack[depth:]
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = None if tag in unclosed else _END[tag].search(page, at)
                if not close:
                    unclosed.add(tag)
                    if tag not in ("head", "title"):
                        break
                else:
                    gt = page.find(">", close.end())
                    at = end if gt < 0 else gt + 1
            text.append(" ")
        elif tag in ("br", "td", "th", "img", "input"):
            text.append(" ")
        if tag in BLOCK:
            flush()
            single = tag not in HOLDER and bool(attributes) and _kind(tag, attributes, stack[-1][1]) == SITE
        if tag in HOLDER and not attributes.endswith("/"):
            kind = _kind(tag, attributes, stack[-1][1])
            if kind != stack[-1][1]:
                flush()
            stack.append((tag, kind))
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out


def shared(a: Sequence[Hashable], b: Sequence[Hashable]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: a row of the table of lengths is an integer whose zero bits are the steps along ``b``.  Every
    ``gap``-th row is kept, the rows between are computed again on the way back.
    """
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    found = {*range(lo), *range(hi_a, len(a))}
    places: dict[Hashable, list[int]] = {}
    for j in range(lo, hi_b):
        places.setdefault(b[j], []).append(j - lo)
    some = [i for i in range(lo, hi_a) if a[i] in places]  # other lines of a change no row
    if not some:
        return found
    size = hi_b - lo
    full = (1 << size) - 1
    masks: dict[Hashable, int] = {}
    for x in {a[i] for i in some}:
        bits = bytearray(size // 8 + 1)
        for j in places[x]:
            bits[j >> 3] |= 1 << (j & 7)
        masks[x] = int.from_bytes(bits, "little")

    def step(row: int, x: Hashable) -> int:
        met = row & masks[x]
        return ((row + met) | (row - met)) & full

    gap = isqrt(len(some)) + 1
    row, kept = full, []
    for n, i in enumerate(some):
        if n % gap == 0:
            kept.append(row)
        row = step(row, a[i])
    j = size
    for k in range(len(kept) - 1, -1, -1):
        part = some[k * gap : (k + 1) * gap]
        rows = [kept[k]]
        for i in part:
            rows.append(step(rows[-1], a[i]))
        for n in range(len(part), 0, -1):
            # the last step at or before j in this row; if the row before has it too, this line adds nothing
            zeros = ~rows[n] & ((1 << j) - 1)
            if not zeros:
                return found
            j = zeros.bit_length()
            if rows[n - 1] >> (j - 1) & 1:
                found.add(part[n - 1])
                j -= 1
    return found


def kept_places(lines: Sequence[Hashable], kinds: Sequence[int], sizes: Sequence[int], near: Sequence[Sequence[Hashable]], further: Sequence[Sequence[Hashable]] = (), copy: float = COPY) -> tuple[list[int], int, int]:
    """Places of the blocks that are the page's own, after differencing, and how many the alignment and the marks have deleted; ``further`` pages speak on article blocks.

    The alignment is asked first, about every block; the marks decide on what no near page shares.
    """
    size = sum(n for n, k in zip(sizes, kinds, strict=True) if k != SITE) or 1
    alike: list[set[int]] = []  # places shared with each page that is no copy

    def add(both: set[int]) -> None:
        if sum(sizes[i] for i in both if kinds[i] != SITE) < copy * size:
            alike.append(both)

    for other in near:
        add(shared(lines, other))
    gone: set[int] = set().union(*alike)
    if any(kinds[i] == ARTICLE for i in gone):
        for other in further:
            held = set(other)
            add({i for i, x in enumerate(lines) if x in held})
    everywhere: set[int] = gone.intersection(*alike) if len(alike) >= LEAST_PAGES else set()
    shared_ = {i for i, k in enumerate(kinds) if i in (everywhere if k == ARTICLE else gone)}
    kept = [i for i, k in enumerate(kinds) if i not in shared_ and k != SITE]
    return kept, len(shared_), len(kinds) - len(shared_) - len(kept)


def main_text(own: list[tuple[str, int]], near: list[list[tuple[str, int]]], copy: float = COPY, further: list[list[tuple[str, int]]] = ()) -> str:
    """The page's own blocks, one to a line, after differencing against its ``near`` pages; ``further`` ones speak on article blocks."""
    texts = lambda page: [x for x, _ in page]
    lines = texts(own)
    return "\n".join(lines[i] for i in kept_places(lines, [k for _, k in own], [len(x) for x in lines], [texts(x) for x in near], [texts(x) for x in further], copy)[0])


KEY = ("host", "path", "id", "tie")


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(K.string_column(batch, c).to_pylist() for c in KEY), strict=True))


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range its first and last different keys, ``REACH`` each."""
    first, last = [], []
    for batch in batches:
        for key in dict.fromkeys(_keys(batch)):
            if last and last[-1] == key:
                continue
            if len(first) < REACH:
                first.append(key)
            last = [*last[-REACH + 1 :], key]
    out = [(TaskContext.get().partitionId(), side, *key) for side, keys in enumerate((first, last)) for key in keys]
    columns = list(zip(*out, strict=True)) or [[]] * 6
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "side", *KEY])


class Ranges:
    """Ranges of the order of pages, and the pages that other ranges need beside their own."""

    def __init__(self, rows: list[tuple]):
        ends: dict[int, tuple[list, list]] = {}
        for part, side, *key in rows:
            ends.setdefault(part, ([], []))[side].append(tuple(key))
        firsts, lasts = (sorted([(p, sorted(e[side])) for p, e in ends.items()]) for side in (0, 1))
        firsts, lasts = [keys for _, keys in firsts], [keys for _, keys in lasts]
        self.starts = [keys[0] for keys in firsts]
        self.also: dict[tuple, list[int]] = {}
        for n in range(len(firsts)):
            after = self._within(firsts[n + 1 :])
            before = self._within([keys[::-1] for keys in lasts[:n][::-1]])
            host = {lasts[n][-1][0], firsts[n][0][0]}
            for key in (*after, *before):
                if key[0] in host:
                    self.also.setdefault(key, []).append(n)

    @staticmethod
    def _within(ranges: list[list[tuple]]) -> list[tuple]:
        out: list[tuple] = []
        for keys in ranges:
            out += keys
            if len(out) >= REACH:
                break
        return out[:REACH]

    def of(self, key: tuple) -> int:
        return max(0, bisect_right(self.starts, key) - 1)


def _parsed(shared_ranges):
    """Each page's blocks under the number of its range, and under those of ranges that need it as a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared_ranges.value
        for batch in batches:
            out: list[tuple] = []
            for key, page_id, url, page in zip(_keys(batch), K.string_column(batch, "page_id").to_pylist(), K.string_column(batch, "url").to_pylist(), K.string_column(batch, "html"), strict=True):
                own = blocks(page.as_py())
                lines = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, _ in own]
                kinds = bytes(k for _, k in own)
                out.append((ranges.of(key), True, *key, page_id, url, lines, kinds, [x if k != SITE else "" for x, k in own]))
                out += [(n, False, *key, None, None, lines, kinds, None) for n in ranges.also.get(key, ())]
            columns = list(zip(*out, strict=True)) or [[]] * 11
            types = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["range", "own", *KEY, "page_id", "url", "lines", "kinds", "texts"])

    return run


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and key; a page is written once the ``REACH`` next ones have been read."""
    pages: list[dict] = []  # the next to be written, and REACH before and after it
    at = 0
    out: list[tuple] = []

    def done() -> None:
        page = pages[at]
        if not page["rows"]:
            return
        around = sorted((abs(j - at), j) for j in range(max(0, at - REACH), min(len(pages), at + REACH + 1)) if j != at and pages[j]["key"][:2] == page["key"][:2])
        near = [pages[j]["lines"] for d, j in around if d == 1]
        further = [pages[j]["lines"] for d, j in around[:REACH] if d > 1]
        kept, aligned, marked = kept_places(page["lines"], page["kinds"], [len(x) for x in page["texts"]], near, further)
        text = "\n".join(page["texts"][i] for i in kept)
        out.extend((page_id, url, text, len(text), aligned, marked) for page_id, url in page["rows"])

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 6
        out.clear()
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "text", "n_chars", "aligned_away", "marked_away"])

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["range"], *(r[c] for c in KEY))
            if pages and pages[-1]["key"] == key:  # a repeated row
                page = pages[-1]
            else:
                page = {"key": key, "lines": r["lines"], "kinds": r["kinds"], "texts": None, "rows": []}
                pages.append(page)
                if len(pages) - 1 - at > REACH:
                    done()
                    at += 1
                    if at > REACH:
                        pages.pop(0)
                        at -= 1
            if r["own"]:
                page["texts"] = r["texts"]
                page["rows"].append((r["page_id"], r["url"]))
        if len(out) >= 500:
            yield batch_of()
    while at < len(pages):
        done()
        at += 1
    yield batch_of()


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A row per page: page_id, url, text and n_chars; aligned_away and marked_away are the blocks that near pages share and those that only marks tell."""
    spark = pages.sparkSession
    short_batches(spark)
    host, path = host_path(F.col(url))
    own = F.col(page_id).cast("long")
    rows = pages.select(own.alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host.alias("host"), path.alias("path"), F.coalesce(own, F.lit(-1)).alias("id"), F.xxhash64(own, url, page).alias("tie"))
    n = partitions(spark)
    keys = rows.select(*KEY).repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)
    ranges = Ranges(keys.mapInArrow(_borders, "part int, side int, host string, path string, id long, tie long").collect())
    parsed = rows.mapInArrow(
        _parsed(spark.sparkContext.broadcast(ranges)), "range int, own boolean, host string, path string, id long, tie long, page_id long, url string, lines array<long>, kinds binary, texts array<string>"
    )
    # a range for each task
    to = F.element_at(F.array(*map(F.lit, even_keys(spark, n))), F.pmod(F.col("range"), F.lit(n)) + 1)
    dealt = parsed.withColumn("to", to).repartition(n, "to").drop("to").sortWithinPartitions("range", *KEY)
    return dealt.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long, aligned_away long, marked_away long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
