"""Main text of web pages: page structure and a suffix array over each host's pages.

A page is read into blocks; scripts, styles, forms and marked-up menus, headers, footers, sidebars,
notices, adverts and comments are left out.  If the page marks its article (``article`` or ``main``)
only the blocks in it are read.  The blocks of all pages of a host form its token stream.  Its suffixes
are sampled where a block begins and at content-defined tokens in it, and each is cut where the next
begins; these runs are range-partitioned by host and leading token, sorted within buckets and compared
with their neighbours, across bucket boundaries too.  Blocks covered by runs that occur on a large share
of the host's distinct pages are boilerplate, whatever their length, and the rest is the text; inside a
marked article the share is larger.  Two pages with the same text can be copies of an article, so a run
has to occur on three at least, and a page that would lose all its blocks is a copy and keeps them.
"""
from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, partitions
from .factors import flat_lists
from .rolling import Roller
from .suffix_dedup import BUCKET_ROWS, _multikey_order

# HTML element names by their role, and words that name page furniture.
_RAW = "script|style|noscript|template|svg|iframe|object|canvas|select|textarea|title"
_SKIP = set("nav header footer aside form button menu dialog fieldset audio video head".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike "
              "strong sub sup time tt u var wbr del".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = {"article", "main"}
_FURNITURE = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header login menu modal nav navbar navigation newsletter notice notices popup promo related search share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Boilerplate is on so many distinct pages of a host at least, and on this share of them.
LEAST_PAGES, SHARE, MARKED_SHARE = 3, 0.3, 0.5

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[/!?a-zA-Z][^<>]*(?:>|\Z)""", re.S | re.I)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _furniture(attributes: str) -> bool:
    for name, *values in _MARKS.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and not _FURNITURE.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


def blocks(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and its blocks of text (those of the article if so)."""
    inside, rest, buffer, last = [], [], [], 0
    main = 0           # open article or main elements
    skip: list = []    # name and depth of the element being left out
    seen = False

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                (inside if main else rest).append(text)
            buffer.clear()

    page = page or ""
    for m in _TOKEN.finditer(page):
        if not skip and m.start() > last:
            buffer.append(page[last:m.start()])
        last = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if not m[0].startswith("<!--"):
                buffer.append(" ")
            continue
        closing = bool(m[2])
        if tag in _MAIN and not closing and skip and skip[0] not in _MAIN and not main:
            skip = []  # an element that was never closed ends where the article begins
        if skip:
            if tag == skip[0] and tag not in _VOID:
                skip[1] += -1 if closing else 1
                if not skip[1]:
                    skip = []
            continue
        if tag in _INLINE:
            if not closing and tag not in _VOID and _furniture(m[4] or ""):
                skip = [tag, 1]
            continue
        flush()
        if tag in _MAIN and not (not closing and _furniture(m[4] or "") and tag != "main"):
            if closing:
                main = max(0, main - 1)
            else:
                main, seen = main + 1, True
        elif not closing and tag not in _VOID and (tag in _SKIP or tag not in ("html", "body") and _furniture(m[4] or "")):
            skip = [tag, 1]
    if not skip:
        buffer.append(page[last:])
        flush()
    return seen, inside if seen else rest


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _parsed(batches):
    for b in batches:
        urls, pages = b.column("url").to_pylist(), b.column("html")
        at, out = 0, []
        size = 0
        for n, (u, p) in enumerate(zip(urls, pages), 1):
            page = p.as_py()
            marked, found = blocks(page)
            out.append((marked, found, host(u), _key((u or "") + "\n" + (page or ""))))
            size += sum(map(len, found))
            if size > 1 << 22 or n == len(urls):
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id")[at:n], b.column("url")[at:n], *(pa.array(x, t) for x, t in zip(
                        zip(*out), (pa.bool_(), pa.list_(pa.string()), pa.string(), pa.int64())))],
                    names=["page_id", "url", "marked", "blocks", "host", "page_key"])
                at, out, size = n, [], 0


def _runs(found: list[str], roller: Roller, every: int):
    """Leading token and name of each run of a page, and the block of each.

    A run begins with its block and at tokens whose name is a multiple of ``every``, so equal blocks have equal
    runs wherever they stand.
    """
    words = [(i, w) for i, x in enumerate(found) for w in x.split(" ")]
    names = np.array([xxhash.xxh64_intdigest(w) for _, w in words], np.uint64)
    block = np.array([i for i, _ in words], np.int64)
    start = np.flatnonzero((names % np.uint64(every) == 0) | (np.diff(block, prepend=-1) != 0))
    prefix = roller.prefix(names)
    return names[start], roller.slices(prefix, start, np.append(start[1:], len(names))), block[start]


def _suffixes(every: int):
    """(host and leading token, name of the run, page, number of the run) of every run of a page, and one row
    per page with its host, whether it marks its article, and number -1."""
    def run(batches):
        roller = Roller(51)
        for b in batches:
            for h, found, key, marked in zip(*(b.column(c).to_pylist() for c in ("host", "blocks", "page_key", "marked"))):
                at = np.uint64(_key(h) + (1 << 63))
                lead, name, _ = _runs(found, roller, every)
                n = len(name) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(lead ^ at, at).view(np.int64)), pa.array(np.append(name, np.uint64(marked)).view(np.int64)),
                     pa.array(np.full(n, key, np.int64)), pa.array(np.append(np.arange(n - 1), -1).astype(np.int32))],
                    names=["k1", "k2", "page_key", "pos"])
    return run


def _neighbours(batches):
    """Sorted bucket -> suffixes whose run is on enough pages (kind 0), its first and last run (kind 1)
    and the suffixes of these (kind 2); ``n`` counts the distinct pages of a run in the bucket."""
    got = [[np.zeros(0, np.int64)] for _ in range(4)]
    for b in batches:
        for part, c in zip(got, b.columns):
            part.append(c.to_numpy())
    k1, k2, page, pos = (np.concatenate(x) for x in got)
    if not len(k1):
        return
    order = _multikey_order([k1, k2, page])
    k1, k2, page, pos = (x[order] for x in (k1, k2, page, pos))
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    first = np.flatnonzero(new)
    pages = np.add.reduceat((new | np.concatenate([[True], page[1:] != page[:-1]])).astype(np.int64), first)
    run = np.cumsum(new) - 1
    last = np.append(first[1:], len(k1)) - 1
    edge = np.unique([0, len(first) - 1])
    at_edge = np.isin(run, edge)
    shared = np.flatnonzero(~at_edge & (pages[run] >= LEAST_PAGES))
    lone = np.flatnonzero(at_edge)

    def rows(at, kind, lo, hi):
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (k1[at], k2[at], page[at], pos[at].astype(np.int32),
                                   np.full(len(at), kind, np.int32), lo, hi, pages[run[at]])],
            names=["k1", "k2", "page_key", "pos", "kind", "low", "high", "n"])

    yield rows(shared, 0, page[shared], page[shared])
    yield rows(first[edge], 1, page[first[edge]], page[last[edge]])
    yield rows(lone, 2, page[lone], page[lone])


def _repeated_runs(suffixes: DataFrame) -> DataFrame:
    """``page_key``, ``pos``, ``n`` of runs that occur on ``LEAST_PAGES`` or more distinct pages of a host, n of them."""
    from pyspark.sql import Window
    suffixes = suffixes.where("pos >= 0")
    n = max(partitions(suffixes.sparkSession), -(-suffixes.count() // BUCKET_ROWS))
    found = keep(suffixes.repartitionByRange(n, "k1", "k2", "page_key", "pos").mapInArrow(
        _neighbours, "k1 long, k2 long, page_key long, pos int, kind int, low long, high long, n long"), "host-runs")
    # a page whose suffixes of one run lie on both sides of a bucket boundary was counted on both
    again = F.coalesce((F.lag("high").over(Window.partitionBy("k1", "k2").orderBy("low", "high")) == F.col("low")).cast("long"),
                       F.lit(0))
    across = found.where("kind = 1").select("k1", "k2", (F.col("n") - again).alias("n")).groupBy("k1", "k2") \
                  .agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES)
    lone = found.where("kind = 2").drop("n").join(across, ["k1", "k2"])
    own = ["page_key", "pos", "n"]
    return found.where("kind = 0").select(*own).unionByName(lone.select(*own))


def _unique_text(every: int):
    def run(batches):
        roller = Roller(51)
        for b in batches:
            values, of = flat_lists(b.column("runs"))
            pos = values.to_numpy()
            texts = []
            for i, found in enumerate(b.column("blocks").to_pylist()):
                p, q = np.searchsorted(of, [i, i + 1])
                if q > p:
                    *_, block = _runs(found, roller, every)
                    free = np.bincount(np.delete(block, pos[p:q]), minlength=len(found))
                    found = [x for x, n in zip(found, free) if n] or found
                texts.append(" ".join(found))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, every: int = 8) -> DataFrame:
    """One row per row of ``pages``: page_id, url and the main text (empty if there is none).

    A null html is empty; a page with a null or odd url belongs to the host ``""``.  Pages with equal
    url and html are one page, so repeated rows do not make their text boilerplate and get equal
    results.  A run on exactly the needed number of pages counts as boilerplate.  Broken markup never fails:
    tags end at the next ``>``, open elements with the page.  Pages of any length are read whole, twice: once
    for their runs and once for their text, so that no copy of them is stored.  An empty table gives no rows.
    Other columns are ignored.  A run has about ``every`` tokens.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = own.mapInArrow(_parsed, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, "
                            "marked boolean, blocks array<string>, host string, page_key long")
    suffixes = keep(parsed.select("host", "blocks", "page_key", "marked").mapInArrow(
        _suffixes(every), "k1 long, k2 long, page_key long, pos int"), "page-suffixes")
    pages_of = suffixes.where("pos = -1").select("k1", "k2", "page_key").distinct()
    hosts = pages_of.groupBy("k1").agg(F.count(F.lit(1)).alias("pages"))
    share = F.when(F.col("k2") == 1, MARKED_SHARE).otherwise(SHARE)
    least = pages_of.join(hosts, "k1").where(F.col("pages") >= LEAST_PAGES) \
                    .select("page_key", (F.col("pages") * share).alias("least"))
    runs = keep(_repeated_runs(suffixes).join(least, "page_key").where("n >= least").select("page_key", "pos")
                .distinct().groupBy("page_key").agg(F.collect_list("pos").alias("runs")), "page-runs")
    drop(suffixes)
    return parsed.join(runs.hint("shuffle_hash"), "page_key", "left").select("page_id", "url", "blocks", "runs") \
                 .mapInArrow(_unique_text(every), f"page_id {own.schema['page_id'].dataType.simpleString()}, "
                             "url string, text string")
