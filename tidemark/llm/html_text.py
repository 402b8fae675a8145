"""Main text of web pages: a suffix array over each host's pages, and page structure.

Every page is parsed into blocks with a zone: *main* (inside article or main), *boiler* (menus, headers, footers, sidebars,
notices, adverts, forms, comments: by element, role or class) or *silent* (the structure doesn't say). The token streams
of a host's pages, all zones, are concatenated and their suffixes ranked by prefix doubling to a depth of ``run`` tokens.
Equal neighbours in this order have a common prefix of ``run`` tokens or more, so the suffixes of ``min_pages`` distinct
pages that stand together mark a recurring substring, and the tokens so marked are those of all recurring substrings
of any length from ``run`` on. They are cut out of silent blocks, and covered link lists out of the main text; unique
runs stay. All other main text stays too: several pages of a host may well share a passage of their articles.

A host of at most ``group_pages`` pages and ``group_bytes`` of html is compared in one piece. A larger one is cut into groups by
hash, and its runs are compared over all groups. First each group sends short marks of its runs, one mark for neighbours (the least
hash of the half-runs inside), and learns which other groups have too; equal runs have equal marks. The few runs left are sent
whole, each with up to ``min_pages`` hashes of page texts that hold it, and those of enough page texts go back to the groups that
have them. The result is that of the one piece, and no group grows with its host.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import mix, span_hashes, word_spans

# Elements by their role on a page.
HIDDEN = frozenset("head script style noscript template iframe svg math canvas object select option datalist button textarea title".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names and ids that mark adverts, and other furniture (fixed values).
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions".split())
FURNITURE = ADVERTS | frozenset(
    "banner cookie cookies consent gdpr notice notices alert alerts sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments"
    " commentlist reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login search popup modal"
    " overlay widget widgets toolbar pagination pager disclaimer copyright skip".split()
)
#: Words that may stand beside them: a name of other words too ("side-effects") says nothing (fixed values).
BESIDE = frozenset(
    "left right top bottom center middle main site page global web box boxes bar list lists item items link links button buttons icon icons post posts article articles story stories"
    " user users reader readers area section block slot unit zone space container content wrapper wrap inner outer text label title form field input message messages info panel tray"
    " column col row group thread policy media network networks network to js c l m sm md lg xl mobile desktop primary secondary sticky fixed small large a an the of and".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>?)", re.S)
#: The same with quotes that mean nothing, once one of a page's quotes was never closed.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(>?)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
MAIN, SILENT, DROP = 2, 1, 0


def named(value: str, words: frozenset) -> bool:
    """Whether a name in a class or id attribute is made of ``words``, and of words that may stand beside them."""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name if not name.isupper() else name.lower())]
        if any(p in words for p in parts) and all(p in words or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


def _marked(name: str, raw: str, in_main: bool) -> bool:
    """Whether an element's start says that its content isn't the article."""
    if name in BOILER or name in HIDDEN or (name == "header" and not in_main):
        return True
    if not raw.strip() or name in ("html", "body", "article", "main") and "comment" not in raw.lower():
        return False
    if _HIDDEN.search(raw):
        return True
    words = ADVERTS if name in INLINE else FURNITURE
    for key, a, b, c in _ATTR.findall(raw):
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and named(value, words) or key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and _UNSEEN.search(value):
            return True
    return False


def blocks(html: str) -> list[tuple[int, bool, str]]:
    """``(zone, mostly links, text)`` of each non-empty block in page order; character references decoded.

    A tag that isn't closed ends the page; one with a quote that isn't closed ends at its first ``>``.
    """
    out: list[tuple[int, bool, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, its content dropped, inside main
    held: dict[str, int] = {}  # how often an element is on the stack
    parts: list[str] = []
    linked = total = links = 0
    tags, at, n = _TAG, 0, len(html)
    inline, depth, under = "", 0, 0  # an inline element whose content goes, how often it is open, the stack under it

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = "".join(parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                dropped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append((DROP if dropped else MAIN if main else SILENT, linked * 2 > total, text))
            parts.clear()
        linked = total = 0

    def pop() -> str:
        name = stack.pop()[0]
        held[name] -= 1
        return name

    while at < n:
        m = tags.search(html, at)
        if m and m[2] is not None and not m[4] and tags is _TAG and m.end() < n:
            tags = _LOOSE
            m = tags.search(html, m.start())
        stop = m.start() if m else n
        if stop > at and not inline:
            parts.append(html[at:stop])
            total += stop - at
            linked += (stop - at) * (links > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            break
        name = m[2].lower()
        if name in INLINE:
            if m[1]:
                links -= name == "a" and links > 0
                if name == inline:
                    depth -= 1
                    inline = inline if depth else ""
            else:
                links += name == "a"
                if name == inline:
                    depth += not m[3].endswith("/")
                elif not inline and name not in VOID and m[3] and not m[3].endswith("/") and _marked(name, m[3], False):
                    inline, depth, under = name, 1, len(stack)
            continue
        flush()
        if m[1]:
            if held.get(name):
                while pop() != name:
                    pass
                if inline and len(stack) < under:
                    inline = ""
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        while name in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] in ("p", name):
            pop()
            if inline and len(stack) < under:
                inline = ""
        dropped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        stack.append((name, dropped or _marked(name, m[3], main), main or name in ("article", "main") or 'role="main"' in m[3]))
        held[name] = held.get(name, 0) + 1
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
            pop()
            at = end.end() if end else n
    flush()
    return out


def run_hashes(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, run: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of every run of tokens within a row: its first token, hash (told apart by group), mark and row; each row's first token, and the runs' length.

    The rows' token streams are one stream; its suffixes, cut at ``run`` tokens, are ranked by prefix doubling.
    """
    starts, ends, first = word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rank = mix(span_hashes(data, starts, ends) + mix(group[row].astype(np.uint64)))
    depth = half = 1
    least = rank
    while depth < run:
        least, half = rank, depth
        rank = mix(rank[:-depth] * np.uint64(3) + mix(rank[depth:]))
        depth *= 2
    valid = np.flatnonzero(row[: len(rank)] == row[depth - 1 :][: len(rank)])
    marks = mix(np.minimum.reduce([least[j : j + len(rank)] for j in range(depth - half + 1)]))
    return valid, rank[valid], marks[valid], row[valid], first, depth


def _cover(hit: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Mask of the tokens of the runs that start at ``hit``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + depth, -1)
    return np.cumsum(edge[:-1]) > 0


def recurring(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, run: int = 8, page: np.ndarray | None = None, min_pages: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the tokens covered by substrings of ``run`` tokens found in ``min_pages`` distinct pages of one group, and first tokens.

    ``page`` numbers the rows' pages; without it every row is one. Neighbours of equal rank in suffix order share a substring.
    """
    valid, rank, _, row, first, depth = run_hashes(data, offsets, group, run)
    if not len(valid):
        return np.zeros(first[-1], bool), first
    owner = (row if page is None else page[row]).astype(np.uint64)
    return _cover(valid[_frequent(rank, owner, min_pages)], depth, first[-1]), first


def _frequent(rank: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """Mask of the runs that ``least`` distinct pages hold, wherever they stand."""
    order = np.lexsort((page, rank)) if len(rank) else np.zeros(0, np.int64)
    r, p = rank[order], page[order]
    head = _heads(r) if len(r) else order
    fresh = np.ones(len(r), np.int64)
    fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    enough = np.add.reduceat(fresh, head) >= least if len(r) else np.zeros(0, bool)
    out = np.zeros(len(rank), bool)
    out[order] = np.repeat(enough, np.diff(np.append(head, len(r))))
    return out


def _heads(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _stream(texts: list[list[str]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Each page's blocks as bytes, all of them, and where each begins."""
    joined = [" ".join(t).encode() for t in texts]
    return joined, np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(j) for j in joined])]).astype(np.int64)


def _finish(rows: list[dict], run: int, min_pages: int) -> list[tuple[str, int, int]]:
    """Text, its code points, and covered tokens of each page of whole hosts."""
    joined, data, offsets = _stream([r["texts"] for r in rows])
    same: dict[tuple, int] = {}
    page = np.array([same.setdefault((r["part"], j), len(same)) for r, j in zip(rows, joined, strict=True)])
    return _judged(rows, *recurring(data, offsets, np.array([r["part"] for r in rows]), run, page, min_pages), run)


def _long_stretches(hit: np.ndarray, run: int) -> np.ndarray:
    """A block's covered tokens, where all are or ``run`` in a row: what a run of two blocks covers of one by its end is no run here."""
    if hit.all():
        return hit
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
    out = np.zeros(len(hit), bool)
    for a, b in edges[edges[:, 1] - edges[:, 0] >= run].tolist():
        out[a:b] = True
    return out


def _judged(rows: list[dict], covered: np.ndarray, first: np.ndarray, run: int) -> list[tuple[str, int, int]]:
    """Text, its code points, and covered tokens of each page, given the mask of covered tokens."""
    out = []
    for k, r in enumerate(rows):
        at, kept, zones = int(first[k]), [], r["zones"]
        has_main = MAIN in zones
        mask = covered[first[k] : first[k + 1]]
        if has_main and not any(z == MAIN and x for z, x in zip(zones, r["links"], strict=True)):
            kept = [t for z, t in zip(zones, r["texts"], strict=True) if z == MAIN]
        else:
            for zone, links, text in zip(zones, r["links"], r["texts"], strict=True):
                tokens = text.split(" ") if zone == SILENT and not has_main else ()
                n = len(tokens) or text.count(" ") + 1
                hit = covered[at : at + n]
                at += n
                if tokens and hit.any():
                    text = " ".join([t for t, gone in zip(tokens, _long_stretches(hit, run).tolist(), strict=True) if not gone])
                if text and (tokens or zone == MAIN and not (links and hit.mean() > 0.5)):
                    kept.append(text)
        text = " ".join(kept)
        out.append((text, len(text), int(mask.sum())))
    return out


def _packed(found: list[tuple[int, bool, str]]) -> bytes:
    """Zones, link marks and texts of a page's blocks, compressed: all that is shuffled of it."""
    zones = "".join(chr(48 + z + 4 * x) for z, x, _ in found)
    return zstandard.ZstdCompressor(level=6).compress("\n".join([zones, *(t for _, _, t in found)]).encode(errors="replace"))


def _unpacked(raw: bytes) -> dict:
    zones, *texts = zstandard.ZstdDecompressor().decompress(raw).decode().split("\n")
    return {"zones": [ord(z) - 48 & 3 for z in zones], "links": [ord(z) - 48 >= 4 for z in zones], "texts": texts}


def _parted(part: int, bucket: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A group's values, in order of their bucket, as one row a bucket."""
    cut = _heads(bucket) if len(bucket) else np.zeros(0, np.int64)
    pieces = [pa.array([x.tobytes() for x in np.split(c, cut[1:])] if len(cut) else [], pa.binary()) for c in columns.values()]
    return pa.table([pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), part, np.int64)), *pieces], ["bucket", "part", *columns])


def _back(rows: pa.Table, hit: np.ndarray, values: np.ndarray) -> pa.Table:
    """The values at ``hit`` (sorted), to the groups they came from."""
    cut = np.searchsorted(hit, np.concatenate([[0], np.cumsum([len(x) // values.itemsize for x in rows["keys"].to_pylist()])]))
    back = [values[hit[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table([rows["bucket"], rows["part"], pa.array(back, pa.binary())], ["bucket", "part", "keys"])


class _Host:
    """The steps over a large host's groups; the runs' marks are kept to 32 bits besides their bucket."""

    def __init__(self, run: int, min_pages: int, buckets: int, names: list[str]):
        self.run, self.min_pages, self.buckets, self.names = run, min_pages, buckets, names

    def runs(self, pages: pa.Table):
        rows = [_unpacked(x) for x in pages["body"].to_pylist()]
        joined, data, offsets = _stream([r["texts"] for r in rows])
        salt = pages["_h"].to_numpy() if rows else np.zeros(0, np.int64)
        page = np.array([xxhash.xxh64_intdigest(j) for j in joined], np.uint64)
        return rows, page, *run_hashes(data, offsets, salt, self.run)

    def short(self, marks: np.ndarray) -> np.ndarray:
        """A mark's bucket and 32 bits."""
        return (marks % np.uint64(self.buckets)) << np.uint64(32) | marks >> np.uint64(32)

    def marks(self, pages: pa.Table) -> pa.Table:
        short = np.unique(self.short(self.runs(pages)[4]))
        return _parted(pages["_part"][0].as_py(), short >> np.uint64(32), keys=short.astype(np.uint32))

    def known(self, rows: pa.Table) -> pa.Table:
        """The marks that several groups have."""
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint32)
        # a group has a mark once
        return _back(rows, np.flatnonzero(_frequent(keys, np.arange(len(keys)), 2)), keys)

    def suspects(self, pages: pa.Table, known: pa.Table) -> pa.Table:
        """Runs whose mark other pages have, each with the hashes of its page texts, ``min_pages`` of them at most."""
        _, page, _, rank, marks, row, _, _ = self.runs(pages)
        short, page = self.short(marks), page[row]
        near = _frequent(short, page, 2)
        away = [np.uint64(k) << np.uint64(32) | np.frombuffer(x, np.uint32).astype(np.uint64) for k, x in zip(known["bucket"].to_pylist(), known["keys"].to_pylist(), strict=True)]
        some = near | np.isin(short, np.concatenate([short[:0], *away]))
        rank, page = rank[some], page[some]
        order = np.lexsort((page, rank, rank % np.uint64(self.buckets)))
        rank, page = rank[order], page[order]
        fresh = np.ones(len(rank), bool)
        fresh[1:] = (rank[1:] != rank[:-1]) | (page[1:] != page[:-1])
        rank, page = rank[fresh], page[fresh]
        head = _heads(rank) if len(rank) else np.zeros(0, np.int64)
        few = np.arange(len(rank)) - np.repeat(head, np.diff(np.append(head, len(rank)))) < self.min_pages
        rank, page = rank[few], page[few]
        return _parted(pages["_part"][0].as_py() if len(page) else 0, rank % np.uint64(self.buckets), keys=rank, page=page)

    def shared(self, rows: pa.Table) -> pa.Table:
        """The runs of enough page texts, for each group that has them."""
        keys, page = (np.frombuffer(b"".join(rows[c].to_pylist()), np.uint64) for c in ("keys", "page"))
        return _back(rows, np.flatnonzero(_frequent(keys, page, self.min_pages)), keys)

    def texts(self, pages: pa.Table, shared: pa.Table) -> pa.Table:
        """A group's pages, judged by the runs that recur on the host."""
        rows, _, valid, rank, _, _, first, depth = self.runs(pages)
        found = np.frombuffer(b"".join(shared["keys"].to_pylist()), np.uint64)
        done = _judged(rows, _cover(valid[np.isin(rank, found)], depth, first[-1]), first, self.run)
        text, *counts = (pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64())))
        return pa.table([pages["_id"], pages["_url"], text, *counts], self.names)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = 8, min_pages: int = 3, group_pages: int = 256, group_bytes: int = 1 << 25,
    max_hosts: int = 200_000,
) -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars, n_recurring`` (tokens in runs of ``min_pages`` pages of the host).

    Null or empty html has an empty text. Null and odd urls share a nameless host. Repeated rows stay, and pages of equal
    text count as one when runs are looked for; two near copies of a page without markup lose nothing. An empty table gives no
    rows. Other columns are not read.
    Hosts of over ``group_pages`` pages or ``group_bytes`` are broadcast while they are at most ``max_hosts`` and joined by shuffle beyond.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    sizes = pages.select(host.alias("_host"), F.octet_length(F.col(html_col)).alias("_size")).groupBy("_host").agg(F.count("*").alias("_n"), F.coalesce(F.sum("_size"), F.lit(0)).alias("_size"))
    groups = F.ceil(F.greatest(F.col("_n") / group_pages, F.col("_size") / group_bytes)).cast("bigint")
    large = sizes.select("_host", groups.alias("_groups")).where("_groups > 1")
    n_large = large.limit(max_hosts + 1).count()
    few = n_large <= max_hosts
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("_host"))

    def parsed(batches):
        for batch in batches:
            body = [_packed(blocks(h or "")) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(body, pa.binary())], ["_id", "_url", "_host", "body"])

    id_type = rows.schema["_id"].dataType.simpleString()

    def ready(how: str) -> DataFrame:
        """Parsed pages of large hosts (``inner``) or of the others (``left_anti``); a long list of hosts meets texts, not html."""
        named = rows.join(F.broadcast(large.select("_host")), "_host", how).select("_id", "_url", "_html", "_host") if few and n_large else rows
        out = named.mapInArrow(parsed, f"_id {id_type}, _url string, _host string, body binary")
        return out if few and how == "left_anti" else out.join(F.broadcast(large) if few else large, "_host", how)

    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [id_col, url_col, "text", "n_chars", "n_recurring"]

    def finished(batches):
        """Whole hosts, many small ones at a time."""
        pending, key, part, size = [], None, 0, 0

        def out():
            done = _finish(pending, run, min_pages)
            return pa.RecordBatch.from_arrays(
                [pa.array([r["_id"] for r in pending], id_arrow), pa.array([r["_url"] for r in pending], pa.string()), pa.array([d[0] for d in done], pa.string()),
                 pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names,
            )

        for batch in batches:
            id_arrow = batch.schema.field("_id").type
            for r in batch.to_pylist():
                if r["_host"] != key:
                    if size > 1 << 20:
                        yield out()
                        pending, size = [], 0
                    key, part = r["_host"], part + 1
                pending.append({"_id": r["_id"], "_url": r["_url"], "part": part, **_unpacked(r["body"])})
                size += sum(map(len, pending[-1]["texts"]))
        if pending:
            yield out()

    schema = f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars bigint, n_recurring bigint"
    whole = ready("left_anti").repartition(parts, "_host").sortWithinPartitions("_host").mapInArrow(finished, schema)
    if not n_large:
        return whole
    part = F.xxhash64("_host", F.pmod(F.xxhash64("_id", "_url", "body"), F.col("_groups")))
    # every step takes the same columns, so that the texts are shuffled once
    held = ready("inner").select("_id", "_url", "body", F.xxhash64("_host").alias("_h"), part.alias("_part")).repartition(parts, "_part")
    host_steps, keys = _Host(run, min_pages, parts, names), "bucket int, part long, keys binary"
    groups = held.groupBy("_part")
    known = groups.applyInArrow(lambda rows: host_steps.marks(rows), keys).groupBy("bucket").applyInArrow(lambda rows: host_steps.known(rows), keys)
    runs = groups.cogroup(known.groupBy("part")).applyInArrow(lambda pages, found: host_steps.suspects(pages, found), f"{keys}, page binary")
    shared = runs.groupBy("bucket").applyInArrow(lambda rows: host_steps.shared(rows), keys)
    return whole.unionByName(groups.cogroup(shared.groupBy("part")).applyInArrow(lambda pages, found: host_steps.texts(pages, found), schema))
