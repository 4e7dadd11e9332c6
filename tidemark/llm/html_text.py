"""The main text of web pages: markup to blocks, and nearest-URL page differencing.

Markup first: scripts, styles, menus, page headers, footers, sidebars, notices, adverts, forms and comments go by their
element or role, or by class or id where every word of one of their names is known to mean such a thing (``no-sidebar``
and ``related-work`` don't). A name of which only some word does makes its element suspect: its lines go from an article
if they also stand in an element of that name in a neighbour, as defined below, and stay otherwise. Headings are never judged by class. An article inside an element that goes by class, or
inside a menu or header that may lack its end, counts if the page has no other. If what is left has an article or main
element, its blocks are the text.

Every page is differenced; where no element marks the text, this alone decides. Pages of a host with equal lines are
one, at their least path; they lose the same lines. Those are put in order of path, and a run in which each shares more than NEAR of its characters with the
next is one of near copies. A page is paired with the end of the run before its own or the start of the run after it,
whichever path has the longer common beginning (the earlier one if equal), both pages' lines are aligned by longest
common subsequence, and the shared lines are deleted. Copies, near copies and pages that hold every line say nothing
about a page: the other neighbour is tried, then all lines stay, also in a host of one run. Inside a marked article
markup checks what differencing says: of the shared lines only those of suspect elements go, as another line that a
neighbour's article shares is a quotation, and text of the article; what stands beside the article goes either way.

Null html gives an empty text. Null urls and urls without a host are paired among themselves. Pages of any length are
read whole; lines are aligned in linear memory. Rows stay as they are, repeated ones too. Extra columns are not read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import range_dealt, stash
from tidemark.llm.url_filter import url_host, url_path

#: HTML's element names by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template title textarea iframe svg math object video audio canvas head".split())
BOILERPLATE = set("nav header footer aside form dialog menu button select fieldset label option".split())
MAIN = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 html body".split())
#: Elements that end an open paragraph.
BLOCKS = BOILERPLATE - {"button", "select", "label", "option"} | MAIN | HEADINGS | set("p div section ul ol dl li table blockquote pre hr figure address details".split())
#: Roles, and words of class and id, that mark what isn't the article; and words that may stand beside these.
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login widget toolbar pagination pager skip hidden".split())
BESIDE = set("site page main global top bottom left right first last inner outer box bar block container wrapper wrap holder panel area list group links link buttons button icons posts articles stories items".split())
#: Guests in an article, and words that may stand beside theirs, but not beside the words of an article's own parts (its header).
GUESTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal overlay comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login widget".split())
BESIDE_GUESTS = set("article post entry story reader readers user users thread section slot unit google card message text this count latest".split())
SUSPECT = "suspect:"
#: Of what excludes an element, what doesn't exclude an article inside it if the page has no other.
MAY_HOLD_ARTICLE = {"class", "nav", "header", "menu"}
#: Two pages are near copies if they share more than this of the longer one's characters.
NEAR = 0.8
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


def _named(name: str) -> str | None:
    """Whether a class or id means something beside the article: ``class`` if all its words are known to, one for certain; ``suspect`` if one does."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not any(p in MARKS for p in parts):
        return None
    beside = BESIDE | BESIDE_GUESTS if any(p in GUESTS for p in parts) else BESIDE
    return "class" if all(p in MARKS or p in beside for p in parts) else "suspect"


def _excluded(element: str, attributes: str, in_main: bool) -> str | None:
    """What says that an element is no part of the article, if anything does; ``suspect:NAME`` if only a word of a name does."""
    if element in BOILERPLATE and not (element == "header" and in_main):
        return element
    if not attributes or element in ("html", "body"):
        return None
    by_name = suspect = None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return "hidden"
        if name == "role" and value.lower() in ROLES:
            return "role"
        if name in ("class", "id") and element not in HEADINGS and element not in INLINE - {"span", "a"}:
            for x in value.split():
                if (means := _named(x)) == "class":
                    by_name = "class"
                elif means and not suspect:
                    suspect = f"{SUSPECT}{element}.{x.lower()}"
    return by_name or suspect


def blocks_of(html: str) -> list[tuple[bool, str]]:
    """(inside a main element, text) of each block of text that markup doesn't exclude, in page order."""
    return [(inside, text) for inside, _, text in suspected_blocks(html)]


def suspected_blocks(html: str) -> list[tuple[bool, str | None, str]]:
    """The same with the name of the outermost element around a block that one word of its name speaks against."""
    out: list[tuple[int, str | None, str]] = []  # 0 beside main elements, 1 inside one that an excluded element holds, 2 inside another
    parts: list[str] = []
    names: list[str] = []  # of the open elements, and what held before each: what excludes the text, main elements, whether one is held
    before: list[tuple[str | None, int, bool, str | None]] = []
    by, mains, held, suspect = None, 0, False, None

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((0 if not mains else 1 if held else 2, suspect, text))
            parts.clear()

    def end(name: str) -> tuple[str | None, int, bool, str | None]:
        """Take elements off up to the last open one of that name."""
        while names.pop() != name:
            before.pop()
        return before.pop()

    at, lower = 0, None
    while True:
        m = _TOKEN.search(html, at)
        if by is None:
            text = html[at : m.start() if m else len(html)]
            if text:
                parts.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if not m[1]:
            if name in RAW and not m[3].endswith("/"):
                if name == "head":
                    continue
                lower = lower or html.lower() if html.isascii() else lower
                stop = lower.find(f"</{name}", at) if lower else (x.start() if (x := re.compile(f"</{name}", re.I).search(html, at)) else -1)
                if name in ("script", "style", "title", "textarea") or stop >= 0:
                    at = len(html) if stop < 0 else stop
                continue
            if name in VOID:
                if by is None:
                    if name == "br":
                        parts.append(" ")
                    elif name == "hr":
                        close()
                continue
            if by is None and name not in INLINE:
                close()
            if name in BLOCKS:
                last = next((x for x in reversed(names) if x not in INLINE), None)
                if last == "p" or last == name == "li":
                    by, mains, held, suspect = end(last)
            names.append(name)
            before.append((by, mains, held, suspect))
            why = _excluded(name, m[3], mains > 0)
            if why and why.startswith(SUSPECT):
                suspect, why = suspect or why, None
            if why is None and name in MAIN and (by is None or by in MAY_HOLD_ARTICLE):
                by, mains, held, suspect = None, mains + 1, held or by is not None, None
            elif why and by is None:
                by = why
        else:
            if by is None and name not in INLINE:
                close()
            if name in names:
                by, mains, held, suspect = end(name)
    close()
    best = max((level for level, _, _ in out), default=0)
    return [(level > 0, name, text) for level, name, text in out if level in (0, best)]


def _lengths(a: list[int], b: list[int]) -> tuple[int, int]:
    """Bit-parallel row of longest common subsequence lengths of ``a`` with the beginnings of ``b`` (a zero bit is a step)."""
    places: dict[int, int] = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return row, len(b)


def _prefix_lengths(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in linear memory (divide and conquer over ``a``)."""
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        mid = (a0 + a1) // 2
        front = _prefix_lengths(*_lengths(a[a0:mid], b[b0:b1]))
        back = _prefix_lengths(*_lengths(a[mid:a1][::-1], b[b0:b1][::-1]))[::-1]
        cut = b0 + int(np.argmax(front + back))
        work += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def _common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def near_copies(lines: list[int], sizes: list[int], others: list[int], other_sizes: list[int]) -> bool:
    """Whether the lines that two pages hold both make up more than NEAR of the longer one's characters."""
    left = Counter(others)
    shared = 0
    for x, n in zip(lines, sizes, strict=True):
        if left[x] > 0:
            left[x] -= 1
            shared += n
    return shared > NEAR * max(sum(sizes), sum(other_sizes))


def difference(path: str, lines: list[int], sizes: list[int], neighbours: list[tuple[str, list[int], list[int]]]) -> list[int]:
    """Places of the lines shared with the nearest neighbour that says anything; (path, lines, sizes) of each neighbour."""
    for _, other, other_sizes in sorted(neighbours, key=lambda x: -_common_start(path, x[0])):
        if not near_copies(lines, sizes, other, other_sizes):
            shared = common_lines(lines, other)
            if len(shared) < len(lines):
                return shared
    return []


def suspects(lines: list[int], names: list[int], neighbours: list[tuple[list[int], list[int]]]) -> list[int]:
    """Places of lines in suspect elements that stand in an element of the same name in a neighbour, too; (lines, names) of each."""
    theirs = {(x, n) for other, other_names in neighbours for x, n in zip(other, other_names, strict=True) if n}
    return [k for k, at in enumerate(zip(lines, names, strict=True)) if at in theirs]


def checked(shared: list[int], main: list[int], suspect: list[int]) -> list[int]:
    """What differencing takes from a marked article: of its shared lines, those of suspect elements; others are quotations and stay."""
    inside = set(main)
    return sorted({k for k in shared if k not in inside} | set(suspect))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every row: blocks joined by an empty line."""
    read = pages.select(
        pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"),
        url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"),
    )
    kind = read.schema["id"].dataType.simpleString()

    def parse(batches):
        number = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True)
        for batch in batches:
            held, main_at, lines, names, sizes = [], [], [], [], []
            for html in batch.column("html"):
                blocks = suspected_blocks(html.as_py() or "")
                held.append([t for _, _, t in blocks])
                main_at.append([k for k, (inside, _, _) in enumerate(blocks) if inside] or None)
                lines.append([number(t) for _, _, t in blocks])
                names.append([number(name) if name else 0 for _, name, _ in blocks])
                sizes.append([len(t) for _, _, t in blocks])
            columns = [batch.column(c) for c in ("id", "url", "host", "path")]
            made = [(held, pa.list_(pa.string())), (main_at, pa.list_(pa.int32())), (lines, pa.list_(pa.int64())), (names, pa.list_(pa.int64())), (sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for x, t in made)], ["id", "url", "host", "path", "blocks", "main", "lines", "names", "sizes"])

    # Pages are parsed twice, for their lines' hashes and at the end for their texts: no text is written or shuffled for its neighbours.
    types = f"id {kind}, url string, host string, path string, blocks array<string>, main array<int>, lines array<bigint>, names array<bigint>, sizes array<int>"
    parsed = read.mapInArrow(parse, types).withColumn("key", F.xxhash64("host", "lines", "names", "main"))

    # The different line lists of a host in path order. Only hashes of lines travel; a long host is split over range partitions.
    lists = parsed.groupBy("key").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("host", "lines", "names", "sizes", "main")])
    dealt = range_dealt(lists, "host", "path", "key")
    order = ["host", "path", "key"]
    one = F.struct("host", "path", "lines", "names", "sizes")
    same = lambda c: F.when(c["host"].eqNullSafe(F.col("host")), c)
    parts, line = Window.orderBy("pid"), Window.partitionBy("pid").orderBy(*order)
    borders = dealt.groupBy("pid").agg(F.max_by(one, F.struct(*order)).alias("last")).select("pid", F.lag("last").over(parts).alias("border"))  # a row a partition
    followed = dealt.join(F.broadcast(borders), "pid").withColumn("before", F.coalesce(F.lag(one).over(line), "border")).drop("border").withColumn("before", same(F.col("before")))

    def begin(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lines", "sizes", "before")]
            starts = [x is None or not near_copies(a, n, x["lines"], x["sizes"]) for a, n, x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.bool_())], [*batch.schema.names, "starts"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in followed.schema.fields)
    runs = stash(followed.mapInArrow(begin, f"{types}, starts boolean"), "runs")

    # A run's neighbours stand at its start and at the next start; a partition takes what it lacks from the others, a row each.
    enters, opens = F.when(F.col("starts"), F.struct("before")), F.when(F.col("starts"), one)
    at = F.struct(*order)
    ends = runs.groupBy("pid").agg(F.max_by(enters, F.when(F.col("starts"), at)).alias("entered"), F.min_by(opens, F.when(F.col("starts"), at)).alias("opened"))
    outer = ends.select(
        "pid",
        F.last("entered", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("entered"),
        F.last("opened", True).over(Window.orderBy(F.desc("pid")).rowsBetween(Window.unboundedPreceding, -1)).alias("opened"),
    )
    back = Window.partitionBy("pid").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    near = (
        runs.join(F.broadcast(outer), "pid")
        .withColumn("before", F.coalesce(F.last(enters, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "entered")["before"])
        .withColumn("after", F.coalesce(F.last(opens, True).over(back), "opened"))
        .select("key", "path", "lines", "names", "sizes", "main", "before", same(F.col("after")).alias("after"))
    )

    def compare(batches):
        for batch in batches:
            gone = []
            for path, lines, names, sizes, main, *near in zip(*(batch.column(c).to_pylist() for c in ("path", "lines", "names", "sizes", "main", "before", "after")), strict=True):
                near = [x for x in near if x]
                shared = difference(path or "", lines, sizes, [(x["path"] or "", x["lines"], x["sizes"]) for x in near])
                gone.append(shared if main is None else checked(shared, main, suspects(lines, names, [(x["lines"], x["names"]) for x in near])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    decided = stash(near.mapInArrow(compare, "key bigint, gone array<int>").filter(F.size("gone") > 0), "gone")
    stays = lambda k: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), k) & (F.col("main").isNull() | F.array_contains("main", k))
    rest = F.array_join(F.filter("blocks", lambda x, k: stays(k)), "\n\n")
    return parsed.select("id", "url", "key", "blocks", "main").join(decided, "key", "left").select(F.col("id").alias(id_col), F.col("url").alias(url_col), rest.alias("text"))
