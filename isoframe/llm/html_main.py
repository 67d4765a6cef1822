"""Main text of HTML pages by differencing of pages with near URLs.

Pages of a host stand in the order of their paths. A page is paired with the pages whose
paths share the longest beginnings with its own; text lines of the two are aligned by
longest common subsequence, and lines that recur on the near pages are deleted. The
structure of a page only chooses the lines that are candidates: those of its article or
main element, or of the whole page, without menus, forms and the like.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import slices, written
from isoframe.llm.url_rules import url_host, url_path

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Fixed values of HTML: elements by what they do to text, and start tags that end open elements (up to a boundary).
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "tfoot": ({"thead", "tbody", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
_OPTIONAL = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "optgroup"}
#: Elements outside the main text, names that mark such an element, and words that may stand beside a mark in one name.
_OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "head", "header", "object", "canvas"}
_MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo",
    "related", "respond", "share", "sharing", "sidebar", "social", "sponsored", "subscribe", "toolbar", "widget", "contentinfo", "complementary", "search",
}
_BESIDE = {
    "area", "bar", "block", "bottom", "box", "buttons", "container", "form", "global", "inner", "items", "left", "links", "list", "main", "outer", "page",
    "primary", "right", "secondary", "section", "site", "slot", "thread", "top", "user", "wrap", "wrapper",
}
_KEPT = {"html", "body", "article", "main"}


def _is_mark(name: str, inside: bool) -> bool:
    """A marked word, alone or joined only with other marked words, numbers and words of place."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not (inside and x == "header")]
    return any(x in _MARKED for x in parts) and all(x in _MARKED or x in _BESIDE or x.isdigit() for x in parts)


def _marked(attrs: str, inside: bool = False) -> bool:
    """Whether a class, id or role marks the element; a header ``inside`` an article is none."""
    return any(_is_mark(name, inside) for m in _MARKS.findall(attrs) for name in "".join(m).lower().split())


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order; kind is text, open or close. Raw elements have no events."""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if (m.start() if m else size) > at:
            yield "text", page[at : m.start() if m else size], ""
        if not m:
            return
        at = m.end()
        name = (m["name"] or "").lower()
        if name in _RAW and not m["close"]:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
        elif name:
            yield "close" if m["close"] else "open", name, m["attrs"]


def _nodes(page: str) -> list[tuple[str, str, str, int]]:
    """Events of block elements, each element with exactly one open and one close.

    End tags that HTML lets a page leave out are put in; others that are missing come
    with the end of the element around them, and the open event says so (1 in its last
    field). Text, inline elements and line breaks have 0 there.
    """
    out: list[tuple[str, str, str, int]] = []
    open_at: list[tuple[str, int]] = []

    def end(depth: int, closed: str = "") -> None:
        while len(open_at) > depth:
            name, k = open_at.pop()
            if len(open_at) == depth and name == closed or name in _OPTIONAL:
                out[k] = (*out[k][:3], 0)
            out.append(("close", name, "", 0))

    def last(names: set[str], upto: set[str]) -> int:
        for k in range(len(open_at) - 1, -1, -1):
            if open_at[k][0] in names:
                return k
            if open_at[k][0] in upto:
                break
        return -1

    for kind, name, attrs in _events(page):
        if kind == "text" or name in _INLINE or name == "br":
            if kind == "text" or name == "br" and kind == "open":
                out.append((kind if kind == "text" else "space", name, attrs, 0))
        elif kind == "close":
            k = last({name}, set())
            if k >= 0:
                end(k, name)
        else:
            if open_at and open_at[-1][0] == "p":
                end(len(open_at) - 1)
            if name in _ENDS:
                k = last(*_ENDS[name])
                if k >= 0:
                    end(k)
            out.append(("open", name, attrs, 1))
            if name in _VOID or attrs.endswith("/"):
                out.append(("close", name, "", 0))
            else:
                open_at.append((name, len(out) - 1))
    end(0)
    return out


def text_lines(page: str) -> tuple[list[str], list[bool]]:
    """Text blocks outside boilerplate elements, and whether each is inside an article or main element.

    White space inside a block is one space. A boilerplate element that lacks its end
    tag ends where an article starts, or with the element around it. A header inside an
    article belongs to it.
    """
    lines: list[str] = []
    inside: list[bool] = []
    held: list[str] = []
    stack: list[tuple[bool, bool]] = []  # for each open element: does it start a skipped region, is it a container
    depth, skipped, loose = 0, 0, -1

    def end_block() -> None:
        words = html.unescape("".join(held)).split()
        held.clear()
        if words:
            lines.append(" ".join(words))
            inside.append(depth > 0)

    for kind, name, attrs, unclosed in _nodes(page):
        if kind in ("text", "space"):
            if not skipped:
                held.append(name if kind == "text" else " ")
            continue
        end_block()
        if kind == "close":
            skips, container = stack.pop()
            skipped -= skips
            depth -= container
            loose = -1 if loose >= len(stack) else loose
            continue
        container = name in ("article", "main") and not _marked(attrs)
        if container and skipped == 1 and loose >= 0:
            stack[loose] = (False, stack[loose][1])
            skipped, loose = 0, -1
        headed = name == "header" and depth > 0
        skips = not headed and (name in _OUTSIDE or (name not in ("html", "body") and not container and _marked(attrs, depth > 0)))
        if skips and not skipped and unclosed:
            loose = len(stack)
        stack.append((skips, container and not skipped))
        skipped += skips
        depth += stack[-1][1]
    end_block()
    return lines, inside


def shared_lines(a: list[int], b: list[int], every: int = 256) -> set[int]:
    """Indexes of ``a`` in a longest common subsequence with ``b``.

    Rows of the table are bit vectors over ``b`` (one bit where the length grows), so a
    row costs len(b) / 64 steps however often lines repeat. Each ``every``-th row is
    kept and those between are made again on the way back, which bounds the memory.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(len(a) - tail, len(a)))
    inner, other = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, bytearray | int] = {x: bytearray(len(other) // 8 + 1) for x in set(inner).intersection(other)}
    for j, x in enumerate(other):
        if x in places:
            places[x][j >> 3] |= 1 << (j & 7)
    places = {x: int.from_bytes(v, "little") for x, v in places.items()}
    full = (1 << len(other)) - 1
    rows = [i for i, x in enumerate(inner) if x in places]

    def below(v: int, i: int) -> int:
        u = v & places[inner[i]]
        return ((v + u) | (v - u)) & full

    kept, v = [], full
    for k, i in enumerate(rows):
        if k % every == 0:
            kept.append(v)
        v = below(v, i)
    j = len(other)
    for c in range(len(kept) - 1, -1, -1):
        part = rows[c * every : (c + 1) * every]
        vectors = [kept[c]]
        for i in part:
            vectors.append(below(vectors[-1], i))
        raw = [x.to_bytes(len(other) // 8 + 1, "little") for x in vectors]
        grows = lambda k, j: not raw[k][j >> 3] >> (j & 7) & 1
        k = len(part)
        while k and j:
            if not grows(k, j - 1):
                j -= 1
            else:
                k -= 1
                if not grows(k, j - 1):
                    found.add(head + part[k])
                    j -= 1
    return found


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _key(lines: list[str], protected: bool) -> int:
    return xxhash.xxh64_intdigest("\n".join(lines), seed=protected) - (1 << 63)


def _candidates(page: str) -> tuple[list[str], bool]:
    """Lines of the page's article and main elements and True, or without one all its lines and False."""
    lines, inside = text_lines(page)
    if any(inside):
        return [x for x, y in zip(lines, inside, strict=True) if y], True
    return lines, False


def _recurring(keys: list[int], near: list[list[int]], least: int) -> list[int]:
    """Indexes of ``keys`` that a longest common subsequence with at least ``least`` of ``near`` holds."""
    own, times = set(keys), [0] * len(keys)
    for other in near:
        if not own.isdisjoint(other):
            for k in shared_lines(keys, other):
                times[k] += 1
    return [k for k, n in enumerate(times) if n >= least]


def shared_with_near(pages: DataFrame, near: int = 8, least: int = 2, block_rows: int = 1000) -> DataFrame:
    """(host, lines_key, gone): indexes of the lines that each distinct page of a host shares with its nearest.

    ``pages`` has host, path, page_id, lines_key, protected and keys (one per line), a
    stored table. Pages of a host with equal lines are one page, at the first of their
    paths, and protected pages and others stand apart. A page's nearest are the ``near``
    of the 2 * ``near`` around it in order of path whose paths share most with its own. Lines of a protected page are shared if all
    ``near`` hold them, of another page if ``least`` do, or its only neighbour.

    Pages are sorted by ranges and numbered, and dealt by number to blocks of
    ``block_rows`` with ``near`` more at either end: the nearest pages of a page do not
    depend on blocks, and a host of any size is dealt evenly.
    """
    spark = pages.sparkSession
    first = F.min(F.struct("path", "page_id")).alias("_at")
    one = pages.where(F.size("keys") > 0).groupBy("host", "lines_key").agg(first, F.first("keys").alias("keys"), F.first("protected").alias("protected"))
    one = one.select("host", "lines_key", "_at.path", "_at.page_id", "keys", "protected")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "protected", "path", "page_id", "lines_key"]
    ranged = one.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.select("*", F.shiftright("_at", 33).alias("_part")), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one row for each partition
    starts, total = {}, 0
    for r in sorted(sizes):
        starts[r._part] = total
        total += r.n
    if not starts:
        return spark.createDataFrame([], "host string, lines_key long, gone array<int>")
    table = spark.createDataFrame(list(starts.items()), "_part long, _start long")
    rank = (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    ranked = ranged.join(F.broadcast(table), "_part").select("host", "lines_key", "path", "keys", "protected", rank)
    touched = F.array_distinct(F.transform(F.array(*[F.lit(x) for x in (0, -near, near)]), lambda d: F.floor((F.col("rank") + d) / block_rows)))
    dealt = ranked.withColumn("block", F.explode(touched)).where("block >= 0")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: deque[dict] = deque()
        done: list[tuple] = []

        def judge(k: int) -> None:
            row = window[k]
            if row["rank"] // block_rows != row["block"]:
                return
            others = [(abs(i - k), i < k, x) for i, x in enumerate(window) if i != k and abs(i - k) <= near and (x["host"], x["protected"]) == (row["host"], row["protected"])]
            others.sort(key=lambda o: (-_common(row["path"], o[2]["path"]), o[0], o[1]))
            found = [x["keys"] for _, _, x in others[:near]]
            wanted = near if row["protected"] else min(least, len(found))
            if found and len(found) >= wanted:
                gone = _recurring(row["keys"], found, wanted)
                if gone:
                    done.append((row["host"], row["lines_key"], gone))

        def given() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32())]
            columns = [pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["host", "lines_key", "gone"])

        ahead = 0  # rows at the end of the window that are still to be judged
        for batch in batches:
            for row in batch.to_pylist():
                if window and window[-1]["block"] != row["block"]:
                    for k in range(len(window) - ahead, len(window)):
                        judge(k)
                    window.clear()
                    ahead = 0
                window.append(row)
                ahead += 1
                if ahead > near:
                    judge(len(window) - ahead)
                    ahead -= 1
                if len(window) > 2 * near + 1:
                    window.popleft()
            if done:
                yield given()
        for k in range(len(window) - ahead, len(window)):
            judge(k)
        yield given()

    blocks = -(-total // block_rows)
    sorted_blocks = dealt.repartition(max(1, min(blocks, parts)), "block").sortWithinPartitions("block", "rank")
    return sorted_blocks.mapInArrow(pair, "host string, lines_key long, gone array<int>")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", near: int = 8, least: int = 2, block_rows: int = 1000,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """Columns page_id, url, text of every row; text is empty where nothing is left.

    A page's candidate lines are those of its unmarked article and main elements, or all
    lines outside boilerplate elements where it has none; see ``shared_with_near`` for
    those of them that go. An article's line thus stays unless all ``near`` nearest pages
    repeat it, as copied paragraphs belong to an article.

    Null and empty html give an empty text. Pages without a host are paired among
    themselves; a page alone on its host keeps its lines; copies on one host, repeated
    rows and rows with null ids have one text. Pages of any length are aligned whole, in
    memory that grows with the lines of 2 * ``near`` + 1 pages. Other columns are not
    read. The lines to delete are broadcast while there are at most ``broadcast_rows``
    pages with any (counted), else joined by a shuffle.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("html_key", F.xxhash64("html"))
    kind = dict(pages.dtypes)[id_col]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            lines_keys, protected, keys = [], [], []
            for page in batch.column("html").to_pylist():
                lines, whole = _candidates(page or "")
                lines_keys.append(_key(lines, whole))
                protected.append(whole)
                keys.append([xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines])
            kept = [batch.column(c) for c in ("page_id", "host", "path", "html_key")]
            new = [pa.array(lines_keys, pa.int64()), pa.array(protected, pa.bool_()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], ["page_id", "host", "path", "html_key", "lines_key", "protected", "keys"])

    schema = f"page_id {kind}, host string, path string, html_key long, lines_key long, protected boolean, keys array<bigint>"
    parsed = written(rows.withColumn("path", url_path(F.col("url"))).drop("url").mapInArrow(parse, schema), "page-lines")
    gone = written(shared_with_near(parsed, near, least, block_rows), "shared")
    by_html = parsed.select("host", "html_key", "lines_key").join(gone.hint("merge"), ["host", "lines_key"]).groupBy("host", "html_key").agg(F.first("gone").alias("gone"))
    by_html = written(by_html, "shared-by-html")
    hint = "broadcast" if by_html.count() <= broadcast_rows else "merge"

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for page, out in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines, drop = _candidates(page or "")[0], set(out or ())
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(by_html.hint(hint), ["host", "html_key"], "left").select("page_id", "url", "html", "gone")
    return joined.mapInArrow(assemble, f"page_id {kind}, url string, text string")
