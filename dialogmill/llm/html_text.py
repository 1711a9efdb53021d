"""HTML main text by nearest-URL page differencing.

Pages are read into lines (one per block of text, with the zone it stands in). Within each host they are ordered by URL path; each page is
aligned with the two nearest before and behind it by longest common subsequences of their lines, and lines that it shares with two of them
(with one, if it has no more) are deleted: menus, banners and notices repeat from page to page, articles don't. A neighbour that shares nearly
all of a page's text is a copy of it (a recrawl, a print version) and tells nothing, so the next one is asked, up to eight pages away.

Where a page marks its article, the markup decides instead: what stands outside <article> and <main> goes, what stands inside stays even if
neighbours share it, and what the markup names as navigation, advert, form, comment and so on goes from any page. Differencing alone can't
give the article of such pages if their menus and adverts differ from page to page (the README has figures).

Neighbours don't depend on how Spark deals the pages. The order is cut into groups of equally many pages at exact ranks, and the pages next
to a cut go to both groups. A host of any size spans many groups, and so do pages without a URL.

Defined cases: null html is an empty page with empty text; a null URL has no host and no path, a relative one has no host; pages of one path
are ordered by id, then by content; repeated rows count as one page and get the same text; paths count by their first 256 characters;
unclosed, misnested and cut-off tags end with their container; texts are read whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import durable, partitions

# Element and name lists of HTML practice.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript iframe textarea template svg math object noembed noframes xmp".split())
CHROME = frozenset("head nav footer aside form button select menu dialog search".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: A name that ends in these is told by what stands before; one that begins with NEGATED says what a layout has or lacks.
WRAPPERS = frozenset("area bar block body bottom box btn button cell col column container content group holder inner item items left link links list main outer panel right row section slot top unit wrap wrapper zone".split())
NEGATED = frozenset("has is js no not on off with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CLOSES_P = BLOCK - frozenset("body head html title option optgroup td th tr tbody thead tfoot caption legend".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPLIT = re.compile(r"[_-]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
CONTENT, OUTSIDE, JUNK = "c", "o", "j"


#: A table in an article is part of it whatever it is called (a restaurant's "menu").
TABLE = {"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}


def _named(value: str) -> bool:
    """Whether a class or id is a chrome name: ``site-footer`` and ``ad-slot`` are, ``has-sidebar`` and ``social-history`` aren't."""
    for token in value.split():
        words = [w for w in _SPLIT.split(token) if w]
        if not words or words[0] in NEGATED:
            continue
        while len(words) > 1 and (words[-1] in WRAPPERS or words[-1].isdigit()):
            words.pop()
        if words[-1] in NAMES:
            return True
    return False


def _is_chrome(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is chrome, and whether only its class or id says so."""
    if name in CHROME or (name == "header" and not in_article):
        return True, False
    if not attributes or name in ("html", "body", "main") or (in_article and name in TABLE):
        return False, False
    if _HIDDEN.search(_QUOTED.sub("''", attributes)):
        return True, False
    weak = False
    for key, *values in _ATTR.findall(attributes):
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key in ("class", "id"):
            if name == "article":
                weak |= bool(set(_SPLIT.split(value)) & {"comment", "comments", "reply", "replies"})
            else:
                weak |= _named(value)
        elif (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True, False
    return weak, weak


def lines_of(page: str) -> tuple[list[str], str]:
    """The page's lines and a zone letter for each."""
    lines: list[str] = []
    zones: list[str] = []
    stack: list[str] = []
    depths: defaultdict[str, list[int]] = defaultdict(list)  # where each name stands in the stack
    held: list[str] = []
    junk_at, weak = -1, False  # depth of the outermost chrome element that is open; whether only its name says so
    articles: list[int] = []
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                lines.append(text)
                zones.append(JUNK if junk_at >= 0 else CONTENT if articles else OUTSIDE)

    def close(depth: int) -> None:
        nonlocal junk_at
        while len(stack) > depth:
            depths[stack.pop()].pop()
        if junk_at >= depth:
            junk_at = -1
        while articles and articles[-1] >= depth:
            articles.pop()

    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            piece = page[at:tag]
            held.append(html.unescape(piece) if "&" in piece else piece)
        if tag == n:
            break
        m = _TAG.match(page, tag)
        if not m:
            held.append("<")
            at = tag + 1
            continue
        at = m.end()
        ends, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if ends:
            if name in BLOCK:
                flush()
            if depths[name]:
                close(depths[name][-1])
            continue
        if name in BLOCK:
            flush()
        if name == "br":
            held.append(" ")
        if name in VOID or attributes.endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in CLOSES_P and depths["p"] and depths["p"][-1] >= len(stack) - 4:
            depth = depths["p"][-1]
            if not any(x in BLOCK for x in stack[depth + 1 :]):
                close(depth)
        elif name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1] == name:
            close(len(stack) - 1)
        if junk_at >= 0 and weak and not articles and name in ("article", "main"):
            junk_at = -1  # a name doesn't cover an article
        if junk_at < 0:
            chrome, weak = _is_chrome(name, attributes, bool(articles))
            junk_at = len(stack) if chrome else -1
        if name in ("article", "main"):
            articles.append(len(stack))
        depths[name].append(len(stack))
        stack.append(name)
    flush()
    return lines, "".join(zones)


#: Pairs of equal lines of two pages up to which each is a node of the alignment; beyond, the pages are halved first.
MATCHES = 1 << 17


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` and the first j lines of ``b``, for each j: rows of the table as bits of a number."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _chain(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence: the longest chain of matches by the smallest last position for each length."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    if len(a) > 1 and sum(len(where.get(x, ())) for x in a) > MATCHES:  # where halves meet best, they are aligned apart
        half = len(a) // 2
        first, last = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int((first + last).argmax())
        return [*_chain(a[:half], b[:cut]), *((i + half, j + cut) for i, j in _chain(a[half:], b[cut:]))]
    ends: list[int] = []
    nodes: list[tuple[int, int, int]] = []  # (position in a, in b, previous node)
    tops: list[int] = []
    for k, x in enumerate(a):
        for j in where.get(x, ()):
            p = bisect.bisect_left(ends, j)
            nodes.append((k, j, tops[p - 1] if p else -1))
            if p == len(ends):
                ends.append(j)
                tops.append(len(nodes) - 1)
            else:
                ends[p], tops[p] = j, len(nodes) - 1
    out, at = [], tops[-1] if tops else -1
    while at >= 0:
        k, j, at = nodes[at]
        out.append((k, j))
    return out


def common(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions in ``a`` and ``b`` of a longest common subsequence: equal ends first."""
    i, n, m = 0, len(a), len(b)
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    pairs = _chain(a[i:n], b[i:m])
    left, right = set(range(i)) | set(range(n, len(a))), set(range(i)) | set(range(m, len(b)))
    return left | {i + k for k, _ in pairs}, right | {i + j for _, j in pairs}


def main_lines(lines: list[str], zones: str, shared: set[int]) -> list[str]:
    """The marked article, if there is one; else what is left after the shared lines and the named chrome have gone."""
    if CONTENT in zones:
        return [x for x, z in zip(lines, zones) if z == CONTENT]
    return [x for i, (x, z) in enumerate(zip(lines, zones)) if z == OUTSIDE and i not in shared]


#: Neighbours asked on each side, and pages among which they are looked for; share of the characters of both pages from which two are copies.
SIDE, REACH, COPY = 2, 8, 0.8
#: Pages of a group, and groups at most (their cuts are broadcast: at most some MB).
GROUP_PAGES, GROUPS = 2000, 16_384
#: Hosts and paths count by so many characters; longer URLs are refused by most servers.
PATH_CHARS = 2048
_LINED = "grp int, home int, host string, path string, page_id long, url string, zones string, packed binary"
_ROWS = "page_id long, url string, text string, n_chars long, n_shared long"


class _Page:
    """A page and the rows (belongs to this group, page_id, url) that hold it."""

    def __init__(self, host: str, zones: str, packed: bytes):
        raw = zlib.decompress(packed).decode()
        self.host, self.zones, self.packed = host, zones, packed
        self.lines = raw.split("\n") if raw else []
        self.size = sum(map(len, self.lines))
        self.rows: list[tuple[bool, int | None, str | None]] = []
        self.asked, self.votes = [0, 0], Counter()  # unlike pages met before and behind it

    def meet(self, earlier: _Page) -> None:
        """Align with a page before it, if one of the two still looks for a neighbour."""
        if (self.asked[0] >= SIDE and earlier.asked[1] >= SIDE) or not self.size or not earlier.size:
            return
        mine, its = common(self.lines, earlier.lines)
        if sum(len(self.lines[i]) for i in mine) >= COPY * max(self.size, earlier.size):
            return
        for page, side, shared in ((self, 0, mine), (earlier, 1, its)):
            if page.asked[side] < SIDE:
                page.asked[side] += 1
                page.votes.update(shared)

    def text(self) -> tuple[str, int]:
        shared = {i for i, n in self.votes.items() if n >= min(2, sum(self.asked))}
        return "\n".join(main_lines(self.lines, self.zones, shared)), len(shared)


def _order(host, path, page_id) -> tuple:
    return host.encode(), path.encode(), page_id is not None, page_id or 0


def _cuts(keys: DataFrame, group_pages: int) -> list[tuple[tuple, tuple, tuple]]:
    """(low, first, high) for each cut: the first key of the group that begins there, and those ``REACH`` keys before and behind it, found at
    exact ranks of the order of all keys. Their number is bounded by ``GROUPS``, whatever the number of pages."""
    keys = durable(keys.select("host", "path", "page_id", F.col("page_id").isNotNull().alias("named")).distinct(), "page-keys")
    total = keys.count()
    size = max(group_pages, 2 * REACH + 1, -(-total // GROUPS))
    if total <= size:
        return []
    many = max(partitions(keys.sparkSession), total // 100_000 + 1)
    dealt = keys.repartitionByRange(many, "host", "path", "named", "page_id").sortWithinPartitions("host", "path", "named", "page_id")
    dealt = durable(dealt.withColumn("at", F.monotonically_increasing_id()), "page-order")
    part = F.shiftright("at", 33)
    starts, before = [], 0
    for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").toLocalIterator():
        starts.append((r.part, before))
        before += r.n
    starts = keys.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(2**33 - 1)
    ranked = dealt.withColumn("part", part).join(F.broadcast(starts), "part").select("host", "path", "page_id", rank.alias("rank"))
    near = ranked.filter(F.pmod(F.col("rank") + REACH, F.lit(size)).isin(0, REACH, 2 * REACH)).collect()
    found = {r["rank"]: _order(r.host, r.path, r.page_id) for r in near}
    last = (b"\xff" * 8, b"", True, 0)
    return [(found[c - REACH], found[c], found.get(c + REACH, last)) for c in range(size, total, size)]


def extract_main_text(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that differencing found to be shared)."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.substring(F.lower(F.regexp_extract(url, pattern, 1)), 1, PATH_CHARS).alias("host"),
        F.substring(F.regexp_replace(F.regexp_replace(url, pattern, ""), "#.*$", ""), 1, PATH_CHARS).alias("path"),
    )
    cuts = _cuts(keyed.select("host", "path", "page_id"), group_pages)
    lows, firsts, highs = ([c[k] for c in cuts] for k in range(3))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                take, groups, homes, zones, packed = [], [], [], [], []
                for i, (page, host, path, page_id) in enumerate(zip(part.column("html"), *(part.column(c).to_pylist() for c in ("host", "path", "page_id")))):
                    lines, zone = lines_of(page.as_py())
                    raw = zlib.compress("\n".join(lines).encode(), 1)
                    key = _order(host, path, page_id)
                    home = bisect.bisect_right(firsts, key)
                    # also to each group at whose edge the page stands
                    for g in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key) + 1):
                        take.append(i)
                        groups.append(g)
                        homes.append(home)
                        zones.append(zone)
                        packed.append(raw)
                some = part.take(pa.array(take, pa.int64()))
                cols = [pa.array(groups, pa.int32()), pa.array(homes, pa.int32()), *(some.column(c) for c in ("host", "path", "page_id", "url")), pa.array(zones, pa.string()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _LINED.split(", ")])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _LINED.split(", ")]
        done: list[tuple] = []
        held: deque[_Page] = deque()  # the pages that the next one meets

        def batch_of() -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], [x.split()[0] for x in _ROWS.split(", ")])
            done.clear()
            return out

        def leave() -> None:
            page = held.popleft()
            if any(home for home, _, _ in page.rows):
                text, shared = page.text()
                done.extend((page_id, url, text, len(text), shared) for home, page_id, url in page.rows if home)

        last = None
        for batch in batches:
            for grp, home, host, path, page_id, url, zones, packed in zip(*(batch.column(x).to_pylist() for x in names)):
                key = (grp, host, path, page_id, packed)
                if key != last:
                    while held and (last[0] != grp or held[0].host != host or len(held) > REACH):
                        leave()
                    page = _Page(host, zones, packed)
                    for other in reversed(held):
                        page.meet(other)
                    held.append(page)
                    last = key
                page.rows.append((grp == home, page_id, url))
                if len(done) >= 500:
                    yield batch_of()
        while held:
            leave()
        if done:
            yield batch_of()

    many = max(partitions(pages.sparkSession), len(cuts) + 1)
    dealt = keyed.mapInArrow(read, _LINED).repartition(many, "grp")
    named = F.col("page_id").isNotNull()
    return dealt.sortWithinPartitions("grp", "host", "path", named, "page_id", "packed", "url").mapInArrow(difference, _ROWS)
