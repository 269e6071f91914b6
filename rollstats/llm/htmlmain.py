"""Main text of web pages by differencing with the nearest URL.

Pages are sorted by host and path; each is paired with the page before it on its
host (the first of a host with the one after it).  Both are lists of text lines,
one a block element; their longest common subsequence is what the host's
template gives to both, and shared lines are deleted.  Equal pages of a host are one
page here, and pages that share nearly all lines are copies, of which nothing is
deleted.  From all pairs of a host it is learned which places (chains of elements and
classes) hold shared lines most of the time; their lines are deleted in every page.

Differencing alone can't tell a menu whose entries change from page to page from a
text, nor an advert that no other page shows.  So the markup counts as well: what
is in a menu, footer, advert, form, comment and the like goes even if not shared, and a
line right in an ``article`` or ``main`` element stays even if shared.

Lines are parsed once and stored; only line and place hashes are sorted, 16 bytes a line,
and html is never shuffled unless so many pages lose lines that the list of them can't
be broadcast.  Pages are told apart by host and content, never by row numbers.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, saved, table

BOILER, PLAIN, MAIN = 0, 1, 2

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math".split())
_BOILER_TAGS = frozenset("nav footer aside form head button select option menu dialog label input".split()) | _RAW
_BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted"
    " related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
#: An opening block element ends an open paragraph.
_ENDS_P = _BLOCKS - {"body", "html", "head", "li", "td", "th", "tr", "dd", "dt", "caption", "legend", "title", "tbody", "thead", "tfoot"}

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?([\w-]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


#: Classes that make an ``article`` a reader's comment.
_COMMENTS = frozenset(("comment", "comments"))


def _names_in(attrs: str) -> list[str]:
    """Classes and ids, as written."""
    return [name for m in _NAMES.finditer(attrs) for name in (m[1] or m[2] or m[3] or "").split()]


def _is_boiler(tag: str, attrs: str, names: list[str], in_main: bool) -> bool:
    if tag in _BOILER_TAGS or tag == "header" and not in_main:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    if tag in ("article", "main"):
        told = any(name.lower() in _COMMENTS for name in names)
    elif in_main:  # a part of a name says little about a part of an article: share-price
        told = any(name.lower() in _BOILER_NAMES for name in names)
    else:
        told = tag not in ("body", "html") and any(p.lower() in _BOILER_NAMES for name in names for p in _PART.findall(name))
    role = _ROLE.search(attrs)
    return told or bool(role and role[1].lower() in _BOILER_ROLES or _HIDDEN.search(re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", lambda m: m[0] if "none" in m[0] else "=", attrs)))


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of every block of a page, in page order; blocks without text are left out.

    Character references are decoded, white space becomes one space, ends are trimmed.
    """
    return [(role, text) for role, _, text in placed_lines(page)]


def placed_lines(page: str | None) -> list[tuple[int, int, str]]:
    """(role, place, text) of every block.

    The place is a hash of the chain of open elements and their classes; 0 outside any
    element with a class or id, that of the ``article`` or ``main`` aside: a chain without names tells nothing apart.
    Time grows with the page's length, however deep its elements lie and whatever is left unclosed.
    """
    if not page:
        return []
    out: list[tuple[int, int, str]] = []
    buffer: list[str] = []
    # Open elements, with the role of their text, their place, whether it has a name of its own, whether it lies
    # in the main element, and where the paragraph is that a block would end (-1: nowhere).
    stack: list[tuple[str, int, int, bool, bool, int]] = []
    is_open: Counter[str] = Counter()
    role = place = 0
    role = PLAIN
    at, end = 0, len(page)

    def flush() -> None:
        if buffer:
            if text := " ".join("".join(buffer).split()):
                out.append((role, place if stack and stack[-1][3] else 0, text))
            buffer.clear()

    def close_from(depth: int) -> tuple[int, int]:
        """Ends the open elements from ``depth`` on; role and place of the one that is left."""
        is_open.subtract(x[0] for x in stack[depth:])
        del stack[depth:]
        return stack[-1][1:3] if stack else (PLAIN, 0)

    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text and role != BOILER:
            buffer.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            buffer.append(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if closing:
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag) if is_open[tag] else None
            if tag in _BLOCKS:
                flush()
            if depth is not None:
                if any(x[0] in _BLOCKS for x in stack[depth:]) or (stack[depth - 1][1] if depth else PLAIN) != role:
                    flush()
                role, place = close_from(depth)
            continue
        if tag in _BLOCKS:
            flush()
        if tag in _ENDS_P and stack and stack[-1][5] >= 0:
            role, place = close_from(stack[-1][5])
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        in_main = bool(stack) and stack[-1][4]
        names = _names_in(attrs) if "=" in attrs else []
        if role == BOILER or _is_boiler(tag, attrs, names, in_main):
            new = BOILER
        elif tag in ("article", "main"):
            new = MAIN
        else:
            new = role
        if new != role:
            flush()
        own = bool(names) and tag not in ("article", "main") or bool(stack and stack[-1][3])
        place = place if tag not in _BLOCKS and not names else _chained(place, f"{tag} {' '.join(sorted(names))}")
        paragraph = len(stack) if tag == "p" else -1 if tag in _BLOCKS or not stack else stack[-1][5]
        stack.append((tag, new, place, own, in_main or new == MAIN, paragraph))
        is_open[tag] += 1
        role = new
    flush()
    return out


def _chained(place: int, label: str) -> int:
    return _signed(xxhash.xxh64_intdigest(label.encode(), place & (1 << 64) - 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode(), 0))


#: Bits of stored rows up to which a common subsequence is read off them; longer lists are halved.
_ROW_BITS = 1 << 28


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit rows of the length table: bit j of row i is 0 where b[j] adds one to what a[:i] and b[:j] have in common."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, [full]
    for x in a:
        if found := row & places.get(x, 0):
            row = (row + found | row - found) & full
        if keep:
            out.append(row)
    return out if keep else [row]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    raw = _rows(a, b, False)[0].to_bytes(len(b) // 8 + 1, "little")
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both (bit-parallel; equal ends first).

    Time is the product of the lengths over the word size, however many lines are equal.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end_a, end_b = len(a), len(b)
    while end_a > low and end_b > low and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    middle: list[int] = []
    todo = [(low, end_a, low, end_b)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > _ROW_BITS and a1 - a0 > 1:
            half = (a0 + a1) // 2
            best = int((_lengths(a[a0:half], b[b0:b1]) + _lengths(a[half:a1][::-1], b[b0:b1][::-1])[::-1]).argmax())
            todo += [(a0, half, b0, b0 + best), (half, a1, b0 + best, b1)]
            continue
        rows = _rows(a[a0:a1], b[b0:b1], True)
        i, j = a1 - a0, b1 - b0
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                middle.append(a0 + i)
    return [*range(low), *sorted(middle), *range(end_a, len(a))]


#: Pages that share this part of the longer one's lines are copies: what they share is no template.
COPY = 0.9
#: A place is the template's if its lines are shared this often, on so many pages at least.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.7, 4
#: Text beside the marked main element counts if there is this many times as much of it.
BESIDE = 2.0

_LINES = "page_id {}, url string, host string, path string, key string, roles array<int>, places array<long>, texts array<string>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Every page's lines; saved. ``pages(page_id, url, html)``; ``key`` is a hash of the html, null if it has none."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    located = pages.select("page_id", "url", "html", rest.alias("rest")).select(
        "page_id", "url", F.lower(F.regexp_extract("rest", r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"), F.md5("html").alias("key"), "html",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [placed_lines(h.as_py()) for h in b.column("html")]
            kinds = pa.int32(), pa.int64(), pa.string()
            columns = [pa.array([[x[k] for x in page] for page in lines], pa.list_(kind)) for k, kind in enumerate(kinds)]
            kept = ("page_id", "url", "host", "path", "key")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], names=[*kept, "roles", "places", "texts"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return saved(located.mapInArrow(run, _LINES.format(kind)))


_PAGE = pa.struct([("host", pa.string()), ("path", pa.string()), ("key", pa.string()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])
_PAIRED = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("host", pa.string()), ("key", pa.string()), ("shared", pa.list_(pa.int32())),
    ("counts", pa.list_(pa.struct([("place", pa.int64()), ("n", pa.int64()), ("shared", pa.int64())]))), ("page", _PAGE), ("inner", _PAGE), ("is_last", pa.bool_()),
])
_PAGE_DDL = "struct<host:string,path:string,key:string,hashes:array<long>,places:array<long>>"
_PAIRED_DDL = (
    "kind string, part int, host string, key string, shared array<int>, counts array<struct<place:long,n:long,shared:long>>,"
    f" page {_PAGE_DDL}, inner {_PAGE_DDL}, is_last boolean"
)


def compared(page: dict, other: dict | None) -> dict:
    """A page's result against its neighbour: places of shared lines, and how many lines of each place are shared.

    Without a neighbour, or with a copy for one, nothing is shared and nothing learned.
    """
    out = {"kind": "result", "host": page["host"], "key": page["key"], "shared": [], "counts": []}
    if other is None:
        return out
    shared = shared_lines(page["hashes"], other["hashes"])
    if not shared or len(shared) >= COPY * max(len(page["hashes"]), len(other["hashes"])):
        return out
    where, n = np.unique(np.array(page["places"], dtype=np.int64), return_inverse=True)
    both = np.bincount(n, minlength=len(where)), np.bincount(n[shared], minlength=len(where))
    out["counts"] = [{"place": int(w), "n": int(k), "shared": int(s)} for w, k, s in zip(where, *both) if w]
    out["shared"] = shared
    return out


def _pair_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a sorted partition's pages.

    Pages whose neighbour may lie in another partition are ``open``; ``first`` and
    ``last`` rows are the pages that other partitions' open pages may need.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    before = page = None
    seen = 0
    waiting = None  # the first page of its host here: it is compared with the one after it

    def settled(first: dict, after: dict | None, is_last: bool) -> dict:
        """A host's first page here; open if it is the partition's first page, or its last."""
        same = after if after and after["host"] == first["host"] else None
        if first["place"] and not is_last:
            return compared(first, same)
        kind = "open" if first["place"] else "open first"
        return {"kind": kind, "part": part, "page": first, "inner": same, "is_last": is_last}

    for b in batches:
        out = []
        for row in b.to_pylist():
            before, page = page, row
            page["place"] = seen
            seen += 1
            if before is None:
                out.append({"kind": "first", "part": part, "page": page})
            if waiting is not None:
                out.append(settled(waiting, page, False))
                waiting = None
            if before is not None and before["host"] == page["host"]:
                out.append(compared(page, before))
            else:
                waiting = page
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PAIRED)
    if page is not None:
        out = [{"kind": "last", "part": part, "page": page}]
        if waiting is not None:
            out.append(settled(waiting, None, True))
        yield pa.RecordBatch.from_pylist(out, schema=_PAIRED)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of open pages: against the page before, else the one after."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            page = row["page"]
            near = [x for x in (row["before"], row["inner"], row["after"]) if x and x["host"] == page["host"]]
            out.append(compared(page, near[0] if near else None))
        yield pa.RecordBatch.from_pylist(out, schema=_PAIRED)


def shared_with_neighbour(parsed: DataFrame) -> DataFrame:
    """``(host, key, shared, counts)`` of every distinct page of a host: what its neighbour shares; see :func:`compared`.

    The neighbour is the page before it on its host by path, then key; for a host's first
    page the one after it.  Partitions of the sort are joined by their first and last pages.
    """
    spark = parsed.sparkSession
    hashes = F.transform("texts", lambda t: F.xxhash64(t))
    pages = parsed.where("key is not null").groupBy("host", "key").agg(
        F.min("path").alias("path"), F.first(F.struct(hashes.alias("hashes"), F.col("places").alias("places"))).alias("x")
    ).select("host", "path", "key", "x.hashes", "x.places")
    # Written once: the range sort samples its input.
    ordered = saved(pages).repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    paired = saved(ordered.mapInArrow(_pair_neighbours, _PAIRED_DDL))
    parts = sorted(r.part for r in paired.where("kind = 'first'").select("part").collect())  # a number a partition
    beside = spark.createDataFrame(list(zip(parts, [None, *parts], [*parts[1:], None])), "part int, part_before int, part_after int")
    beside = F.broadcast(beside)
    lasts = paired.where("kind = 'last'").select(F.col("part").alias("part_before"), F.col("page").alias("before"))
    firsts = paired.where("kind = 'first'").select(F.col("part").alias("part_after"), F.col("page").alias("after"))
    rows = paired.where("kind like 'open%'").join(beside, "part")
    rows = rows.withColumn("part_before", F.when(F.col("kind") == "open first", F.col("part_before"))).withColumn("part_after", F.when(F.col("is_last"), F.col("part_after")))
    across = rows.join(lasts, "part_before", "left").join(firsts, "part_after", "left").select("page", "inner", "before", "after").mapInArrow(_across, _PAIRED_DDL)
    columns = "host", "key", "shared", "counts"
    return paired.where("kind = 'result'").select(*columns).union(across.select(*columns))


def template_places(found: DataFrame, share: float = TEMPLATE_SHARE, pages: int = TEMPLATE_PAGES) -> DataFrame:
    """``(host, template)``: the places of each host whose lines its pages share with their neighbours."""
    each = found.select("host", F.explode("counts").alias("c")).groupBy("host", F.col("c.place").alias("place"))
    sums = each.agg(F.count(F.lit(1)).alias("pages"), F.sum("c.n").alias("n"), F.sum("c.shared").alias("shared"))
    return sums.where((F.col("pages") >= pages) & (F.col("shared") >= share * F.col("n"))).groupBy("host").agg(F.collect_set("place").alias("template"))


def _fates(places: pd.Series, shared: pd.Series, template: pd.Series) -> pd.Series:
    """What speaks against each line: 2 a place of the template, 1 the neighbour's sharing it, 0 nothing; null for a null page."""

    def one(own, lines, template):
        if own is None:
            return None
        fates = np.zeros(len(own), dtype=np.int32)
        fates[np.asarray(lines, dtype=np.int64)] = 1
        fates[np.isin(own, template)] = 2
        return fates

    return pd.Series([one(*x) for x in zip(places, shared, template)], dtype=object)


def main_text(roles: Column, fates: Column, texts: Column) -> Column:
    """The lines that stay: of the marked main element, else, or if there is far more of it, those that are not shared."""
    lines = F.arrays_zip(roles.alias("role"), fates.alias("fate"), texts.alias("text"))
    own = F.filter(lines, lambda x: (F.coalesce(x["fate"], F.lit(0)) < 2) & ((x["role"] == MAIN) | (F.coalesce(x["fate"], F.lit(0)) == 0)))
    length = lambda own, role: F.aggregate(F.filter(own, lambda x: x["role"] == role), F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))

    def joined(x: Column) -> Column:
        beside = ~F.array_contains(roles, MAIN) | (length(x["own"], PLAIN) > BESIDE * length(x["own"], MAIN))
        return F.transform(F.array(F.struct(x["own"].alias("own"), beside.alias("beside"))), lambda y: F.array_join(
            F.transform(F.filter(y["own"], lambda l: (l["role"] == MAIN) | y["beside"]), lambda l: l["text"]), "\n"
        ))[0]

    # One element arrays hold what is computed once for all lines.
    return F.transform(F.array(F.struct(own.alias("own"))), joined)[0]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", differencing: bool = True) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    Null and empty html give an empty text; a null url, or one without ``://``,
    counts as an empty host.  Repeated rows and equal pages of a host have equal results; a
    page alone on its host has no neighbour and loses no shared line.  An empty
    table gives no rows; other columns are not read.  ``differencing=False`` leaves the markup alone to decide.
    """
    parsed = parsed_pages(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    joined = parsed.withColumns({"shared": F.array().cast("array<int>"), "template": F.array().cast("array<bigint>")})
    if differencing:
        found = saved(shared_with_neighbour(parsed))
        templates = bounded(saved(template_places(found)))
        deleted = bounded(saved(found.where(F.size("shared") > 0).select("host", "key", "shared")))
        joined = parsed.join(deleted, ["host", "key"], "left").join(templates, "host", "left").withColumns({
            "shared": F.coalesce("shared", F.array().cast("array<int>")), "template": F.coalesce("template", F.array().cast("array<bigint>"))
        })
    # Pages that lose no line are not looked through.
    some = F.when((F.size("shared") > 0) | (F.size("template") > 0), F.col("places"))
    fates = F.coalesce(F.pandas_udf(_fates, "array<int>")(some, F.col("shared"), F.col("template")), F.array().cast("array<int>"))
    text = main_text(F.col("roles"), fates, F.col("texts"))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
