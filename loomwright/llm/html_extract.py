"""HTML extraction: nearest-URL page differencing over all lines of a page, with the page's own structure as a second witness."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import shared_dir, written
from loomwright.llm.url_filter import canonical

# Element names of HTML, and the words by which class, id and role name page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table"
    " tbody td tfoot th thead title tr ul xmp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg object canvas".split())
FURNITURE = frozenset("aside button dialog footer form head header menu nav search select".split())
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
LISTS = frozenset("ul ol menu dl table select".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox banner breadcrumb breadcrumbs comment comments commentlist"
    " consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices"
    " pager pagination paywall popup promo promotion related respond share sharing sidebar site-footer site-header skip social sponsor"
    " sponsored subscribe subscription toolbar topbar widget widgets complementary dialog alert search replies".split()
)
PARTS = frozenset("ad ads advert advertisement adbox breadcrumb breadcrumbs comment comments cookie cookies consent gdpr newsletter sidebar sponsored paywall".split())
#: What may stand beside such a word in a compound name inside an article; other words there tell of its subject.
BESIDE = frozenset("area bar block body bottom box card cell container content form frame holder inline inner item label left link list main outer panel right section signup slot space thread top unit wrap wrapper".split())
#: Inside an article only what holds other elements can be furniture by its name, and a header there is the article's own.
HOLDERS = frozenset("div section aside ul ol dl table nav header footer form article iframe".split())
OWN_NAMES = frozenset("header masthead".split())

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_GAP, _NAME, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_SPLIT = re.compile(r"[-_]+")
NEUTRAL, MAIN, ARTICLE, ASIDE = 0, 1, 2, 3


class _Scan:
    """Markup of a page, in time proportional to its length: what has no end further on is looked for once."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.open_ended: set[str] = set()

    def tag(self, at: int) -> tuple[int, str, str, dict[str, str]] | None:
        """What the "<" at a place begins: its end, "/" for an end tag, the name ("" for a comment), attributes. None: text.

        A tag whose ">" is missing, or lies in quotes only, is text, and so is all behind it.
        """
        page, last = self.page, self.last
        if at < last[">"] and (m := _SIMPLE.match(page, at)):
            return m.end(), m[1], m[2].lower(), {}
        if page.startswith("<!--", at):
            end = None if "--" in self.open_ended else _COMMENT_END.search(page, at + 4)
            if end is None:
                self.open_ended.add("--")
            return (end.end() if end else len(page)), "", "", {}
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at) if at < last[">"] else -1
            return (end + 1 if end >= 0 else len(page)), "", "", {}
        if last[">"] < at or not (m := _OPEN.match(page, at)):
            return None
        i, end, found = m.end(), len(page), {}
        while i < end:
            i = _GAP.match(page, i).end()
            if i >= end:
                break
            if page[i] == ">":
                return i + 1, m[1], m[2].lower(), found
            name = _NAME.match(page, i)
            i, value = max(name.end(), i + 1), ""
            if eq := _EQUALS.match(page, i):
                i = eq.end()
                quote = page[i : i + 1]
                if quote in ("'", '"') and quote and i < last[quote]:
                    close = page.index(quote, i + 1)
                    value, i = page[i + 1 : close], close + 1
                else:
                    bare = _BARE.match(page, i)
                    value, i = bare[0], bare.end()
            found.setdefault(name[0].lower(), value)
        self.last[">"] = at - 1  # nothing further on ends
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup; -1 if there is none."""
        if tag in self.open_ended:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I | re.A).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        if end < 0:
            self.open_ended.add(tag)
        return end + 1 if end >= 0 else -1


def _furniture(tag: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether the attributes say that the element is page furniture, and that it holds the article."""
    body = attrs.get("itemprop", "").lower() == "articlebody" or attrs.get("role", "").lower() in ("main", "article")
    out = comment = False
    for name in ("class", "id", "role"):
        for word in attrs.get(name, "").lower().split():
            if inside and word in OWN_NAMES:
                continue
            parts = [x for x in _SPLIT.split(word) if x and not x.isdigit()]
            out |= word in NAMES or not PARTS.isdisjoint(parts) and (not inside or all(x in PARTS or x in NAMES or x in BESIDE for x in parts))
            comment |= "comment" in word
    if tag in ("html", "body", "main") or tag == "article" and not comment or inside and tag not in HOLDERS:
        out = False
    return out, body


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """The text blocks of a page in order, each with its place by the page's structure: ARTICLE, MAIN, NEUTRAL or, for
    furniture, ASIDE.

    Character references are decoded, white space becomes one space. Elements that are not closed end with their parent.
    """
    out: list[tuple[int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, bool, int]] = [("", False, NEUTRAL)]
    parts: list[str] = []
    level, scan = NEUTRAL, _Scan(page)

    def flush() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((level, text))
            parts.clear()

    at, end = 0, len(page)
    while at < end:
        begin = page.find("<", at)
        got = scan.tag(begin) if begin >= 0 else None
        _, off, core = stack[-1]
        stop = end if begin < 0 else begin if got else begin + 1
        if stop > at:
            where = ASIDE if off else core
            if parts and where != level:
                flush()
            if not parts:
                level = where
            parts.append(page[at:stop])
        if not got:
            at = stop
            continue
        at, closing, tag, attrs = got
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br" and parts:
            parts.append(" ")
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW and page[at - 2] != "/":
            close = scan.raw_end(tag, at)
            at = close if close >= 0 else end if tag in ("script", "style", "textarea", "template") else at
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSES.get(stack[k][0], ()):
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS and not (stack[k][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[k][0] not in LISTS):
                    break
        _, off, core = stack[-1]
        named, body = _furniture(tag, attrs, core == ARTICLE) if attrs else (False, False)
        off |= named or tag in FURNITURE and not (tag == "header" and core == ARTICLE)
        if len(stack) < 512:  # deeper elements count as their parent
            stack.append((tag, off, max(core, ARTICLE if tag == "article" or body else MAIN if tag == "main" else NEUTRAL)))
    flush()
    return out


def _table(cols: list[int], rows: list[int]) -> tuple[dict[int, int], int]:
    where: dict[int, int] = {}
    for j, x in enumerate(cols):
        where[x] = where.get(x, 0) | 1 << j
    return where, (1 << len(cols)) - 1


def _lengths(cols: list[int], rows: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of rows with each beginning of cols."""
    where, full = _table(cols, rows)
    v = full
    for x in rows:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((v ^ full).to_bytes(len(cols) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(cols)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


#: Bits of the dynamic programme that are kept for the way back; longer lists are halved until they are below.
KEPT_BITS = 1 << 26


def _aligned(cols: list[int], rows: list[int], base: int, out: list[int]) -> None:
    """Adds the places in cols, from base on, of a longest common subsequence with rows."""
    if not cols or not rows:
        return
    if len(rows) > 1 and len(cols) * len(rows) > KEPT_BITS:
        half = len(rows) // 2
        total = _lengths(cols, rows[:half]) + _lengths(cols[::-1], rows[half:][::-1])[::-1]
        cut = int(total.argmax())
        _aligned(cols[:cut], rows[:half], base, out)
        _aligned(cols[cut:], rows[half:], base + cut, out)
        return
    where, full = _table(cols, rows)
    v, kept = full, []
    for x in rows:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        kept.append(v)
    r, c = len(rows), len(cols)
    while r and c:
        if kept[r - 1] >> (c - 1) & 1:
            c -= 1
        else:
            r -= 1
            if not (r and not kept[r - 1] >> (c - 1) & 1):
                c -= 1
                out.append(base + c)


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """The positions in a of a longest common subsequence of a and b.

    Common ends are taken off, then lines that only one side has; the rest is a bit-parallel dynamic programme on big
    integers whose row for each line of b is kept for the way back. Lists too long for that are halved where the
    lengths of both halves add up to the most, so that memory grows with the lines and not with their product.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    shared = {*range(lo), *range(n, len(a))}
    both = {*a[lo:n]} & {*b[lo:m]}
    cols = [i for i in range(lo, n) if a[i] in both]
    found: list[int] = []
    _aligned([a[i] for i in cols], [x for x in b[lo:m] if x in both], 0, found)
    return shared.union(cols[k] for k in found)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


#: Different pages looked at before and after a page; line sets at least so similar belong to copies.
AROUND, COPY = 2, 0.8


def _alike(a: list[int], b: list[int]) -> bool:
    x, y = {*a}, {*b}
    return len(x & y) >= COPY * len(x | y)


def structural(levels: list[int] | bytes) -> list[bool]:
    """Lines that the structure of the page alone would keep: no furniture, and in the article (or main) if there is one."""
    top = max((k for k in levels if k != ASIDE), default=NEUTRAL)
    return [k == top for k in levels]


def dropped(path: str, marks: list[int], levels: list[int] | bytes, around: list[tuple[int, str, list[int]]]) -> list[int]:
    """Lines of a page that go although its structure would keep them: the nearest page around shares them.

    around: (distance in the order of URLs, path, line hashes) of pages with other lines. The nearest has the longest
    common beginning of the path, then the least distance, before ones first. Where there is a second page, one has to
    share the line as well. Lines of a marked article stay: pages quote one another, and passages that many pages
    have in their articles are main text. A page never loses all that it has.
    """
    keep = structural(levels)
    others = [x for x in around if not _alike(x[2], marks)] or around
    others = sorted(others, key=lambda x: (-_prefix(x[1], path), abs(x[0]), x[0]))
    if not others:
        return []
    shared = common_lines(marks, others[0][2])
    if len(others) > 1:
        shared &= set().union(*(common_lines(marks, x[2]) for x in others[1:]))
    gone = sorted(i for i in shared if keep[i] and levels[i] == NEUTRAL)
    return gone if len(gone) < sum(keep) else []


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2 of a row, with host, path, a hash of all lines (sig), a hash of each line and its place in the structure."""
    for b in batches:
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            rows: dict[str, list] = {k: [] for k in ("host", "path", "sig", "marks", "levels")}
            for url, page in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                host, path = canonical(url)
                found = page_lines(page)
                marks = np.array([xxhash.xxh64_intdigest(t.encode(errors="surrogatepass")) for _, t in found], "<u8")
                levels = bytes(k for k, _ in found)
                rows["host"].append(host)
                rows["path"].append(path)
                rows["sig"].append(xxhash.xxh128_digest(marks.tobytes() + levels))
                rows["marks"].append(marks.tobytes())
                rows["levels"].append(levels)
            kinds = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, t) for v, t in zip(rows.values(), kinds))], ["k1", "k2", *rows])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page that loses lines which its structure would keep."""
    ints = lambda raw: np.frombuffer(raw, "<u8").tolist()
    for b in batches:
        host, sig, gone = [], [], []
        for row in (r for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist()):
            around = [(x["d"], x["path"], ints(x["marks"])) for x in row["around"] or () if x["host"] == row["host"] and x["marks"] != row["marks"]]
            if lost := dropped(row["path"], ints(row["marks"]), row["levels"], around):
                host.append(row["host"])
                sig.append(row["sig"])
                gone.append(lost)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(sig, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], ["host", "sig", "gone"])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 128):
            part, texts = b.slice(at, 128), []
            for page, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                found = page_lines(page)
                keep, lost = structural([k for k, _ in found]), {*(gone or ())}
                texts.append("\n\n".join(t for i, (_, t) in enumerate(found) if keep[i] and i not in lost))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])


def _neighbours(nodes: DataFrame, folder: str) -> DataFrame:
    """host, path, around: the AROUND paths before and after each path of all hosts, in the order of (host, path).

    Paths are numbered by sorted ranges, each of which begins where those before it end; a path is joined with numbers
    near its own, so that where a range ends makes no difference, and a host of any size spreads over ranges.
    """
    one = nodes.groupBy("host", "path").agg(F.min_by(F.struct("sig", "marks"), "sig").alias("m")).select("host", "path", F.col("m.marks").alias("marks"))
    dealt = one.repartitionByRange("host", "path").sortWithinPartitions("host", "path")
    ranged = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), folder, "ranged")
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a range
    begins, total = [], 0
    for part, n in sizes:
        begins.append((part, total))
        total += n
    begin = nodes.sparkSession.createDataFrame(begins, "part int, begin bigint")
    ranked = ranged.join(F.broadcast(begin), "part").select((F.col("begin") + F.col("at")).alias("rank"), "host", "path", "marks")
    steps = [d for d in range(-AROUND, AROUND + 1) if d]
    sent = ranked.select(F.explode(F.array(*map(F.lit, steps))).alias("d"), "rank", "host", "path", "marks")
    near = sent.groupBy((F.col("rank") - F.col("d")).alias("rank")).agg(F.collect_list(F.struct("d", "host", "path", "marks")).alias("around"))
    return ranked.join(near, "rank").select("host", "path", "around")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars: the main text of each page, blocks joined by an empty line.

    Every page is differenced: with all its lines, menus and footers among them, against the page of its host, of the two
    paths before it and the two after it in the order of URLs, that has the longest path in common and other lines.
    Lines are aligned by longest common subsequence; the shared ones are what goes. The structure of the page is the
    second witness: where the page says that a line is furniture (by elements, classes, ids and roles), or marks an
    article (or main) and the line is outside it, it goes although no page shares it; a line inside a marked article stays
    although pages share it, since quotes and passages that many articles have are main text. In pages that mark nothing
    a shared line goes if another page around, where there is one, shares it too.

    Copies (one path, or the same lines) are never paired, near copies (COPY) only if nothing else is around, and no page
    loses all its lines. Null or empty html: empty text. Null urls: host and path are empty, such pages are one path and
    have no neighbours in their host. Null ids and repeated rows are rows of their own; rows that are equal get equal
    texts. Very long pages take time in proportion to their length, but for the alignment, which grows with the product
    of the two pages' differing lines over 64 and keeps their lines in memory. Empty tables give none. Other columns are
    not read.

    Pages are parsed for a hash of each line; pages of a host with the same lines are one, and only hashes are dealt out.
    What comes back is lists of lines, for pages that lose some which their structure keeps, and is joined with the pages
    by a hash of the row: Spark sends it to the pages where it is small, and deals the pages out where it isn't.
    """
    folder = shared_dir(pages.sparkSession)
    src = pages.select(pages[id_col].alias("_id"), pages[url_col].cast("string").alias("_url"), pages[html_col].cast("string").alias("_html"))
    kind = src.schema["_id"].dataType.simpleString()
    keyed = src.withColumns({"k1": F.xxhash64("_url", "_html"), "k2": F.xxhash64(F.lit(1), "_url", "_html")})
    lines = written(keyed.select("k1", "k2", "_url", "_html").mapInArrow(_mark, "k1 bigint, k2 bigint, host string, path string, sig binary, marks binary, levels binary"), folder, "lines")
    nodes = written(lines.groupBy("host", "sig").agg(F.min("path").alias("path"), F.min("marks").alias("marks"), F.min("levels").alias("levels")), folder, "nodes")
    paired = nodes.join(_neighbours(nodes, folder), ["host", "path"], "left").select("host", "path", "sig", "marks", "levels", "around")
    found = written(paired.mapInArrow(_decide, "host string, sig binary, gone array<int>"), folder, "found")
    gone = lines.select("k1", "k2", "host", "sig").join(found, ["host", "sig"]).groupBy("k1", "k2").agg(F.first("gone").alias("gone"))
    both = keyed.join(written(gone, folder, "gone"), ["k1", "k2"], "left").select("_id", "_url", "_html", "gone")
    out = both.mapInArrow(_write, f"`_id` {kind}, `_url` string, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
