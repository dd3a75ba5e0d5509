"""SimHash near-duplicate detection with a Gray-order hierarchical index.

A fingerprint bit is set if it is set in over half of the XXH64 values of a document's word
shingles.  Distinct fingerprints that differ in at most ``max_bits`` bits are linked, and the
components of these links are the groups.

The index has masked bit patterns as its upper nodes.  With ``max_bits`` differing bits and
``max_bits + 2`` bit blocks at least two blocks are equal, so every pair within the bound shares
the pattern of one two-block mask: those are the nodes that Spark shuffles by.  A node with more
than ``node_rows`` fingerprints is split by the same rule over its free bits, until few free bits
bound its size; no node is cut off.  Within a node the fingerprints are sorted by Gray rank, which
keeps equal leading bits together; runs of equal leading bytes are the inner nodes, and pairs of
inner nodes are dropped whole as soon as their accumulated differences exceed the bound.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, drop, keep, partitions, text_key
from .components import connected_components

_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SIGN = 1 << 63


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text; 0 for a text without words or null."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at [\x20\x09-\x0D]
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[k - 1:]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(stops)
    for i in range(0, n, 1 << 16):
        part = [digest(line[a:b], 42) for a, b in zip(starts[i:i + (1 << 16)], stops[i:i + (1 << 16)])]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def simhash(docs: DataFrame, shingle: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the text replaced by its fingerprint, a signed long in column ``out``."""
    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType([*[f for f in docs.schema.fields if f.name != text], StructField(out, LongType())])
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            col = b.column(at)
            fps = [fingerprint(x.as_py(), shingle) for x in col]
            arr = pa.array(np.array(fps, np.uint64).view(np.int64) if fps else [], pa.int64())
            rest = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, arr], names=schema.names)

    return docs.mapInArrow(run, schema)


def _gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _child_pairs(a, b, acc, first, count):
    """All pairs of children of the node pairs (a, b); a node is paired with itself once, ordered."""
    ka, kb = count[a], count[b]
    size = ka * kb
    rep = np.repeat(np.arange(len(a)), size)
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    ca, cb = first[a][rep] + pos // kb[rep], first[b][rep] + pos % kb[rep]
    ok = ca <= cb
    return ca[ok], cb[ok], acc[rep][ok]


def gray_links(group: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with equal group and at most ``max_bits`` differing bits, each pair once."""
    rank = _gray_rank(fps)
    order = np.lexsort((rank, group))
    g, f = group[order], fps[order]
    # inner nodes of level l: runs of equal group and equal leading l bytes (contiguous in Gray order)
    new = np.concatenate([[True], g[1:] != g[:-1]])
    level = np.flatnonzero(new)
    a = b = np.arange(len(level))
    acc = np.zeros(len(level), np.int64)
    for k in range(8):
        byte = (f >> np.uint64(56 - 8 * k)).astype(np.uint8)
        new = new | np.concatenate([[True], byte[1:] != byte[:-1]])
        child = np.flatnonzero(new)
        first = np.searchsorted(child, level)
        count = np.diff(np.append(first, len(child)))
        outs = []
        for i in range(0, len(a), 4096):  # bounds the pairs held before pruning
            ca, cb, c = _child_pairs(a[i:i + 4096], b[i:i + 4096], acc[i:i + 4096], first, count)
            c = c + _POP8[byte[child[ca]] ^ byte[child[cb]]]
            ok = c <= max_bits
            outs.append((ca[ok], cb[ok], c[ok]))
        a, b, acc = (np.concatenate(x) for x in zip(*outs))
        level = child
    ok = a != b  # equal fingerprints were made distinct before
    return order[level[a[ok]]], order[level[b[ok]]]


def _forest(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Indexes of links that join two parts not joined before."""
    parent: dict[int, int] = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        p, q = find(i), find(j)
        if p != q:
            parent[p] = q
            kept.append(k)
    return kept


def _masks(free: int, max_bits: int) -> list[int]:
    """Masks of the free bits; two values within ``max_bits`` agree on all bits of at least one mask."""
    bits = [i for i in range(64) if free >> i & 1]
    m = max_bits + 2
    block = [sum(1 << i for i in bits[k * len(bits) // m:(k + 1) * len(bits) // m]) for k in range(m)]
    return sorted({x | y for x, y in combinations(block, 2)} - {0})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def hamming_links(fps: DataFrame, max_bits: int = 2, node_rows: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` within ``max_bits``; connects all that are near.

    A node returns a spanning forest of its links rather than all of them.
    """
    spark = fps.sparkSession
    level = {0: (1 << 64) - 1}  # fixed bits -> free bits
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    found = []
    while True:
        kids = {p: [p | m for m in _masks(free, max_bits)] for p, free in level.items()}
        pick = None
        for p, ms in kids.items():
            arr = F.array(*[F.lit(_signed(m)).cast("long") for m in ms])
            pick = arr if pick is None and len(kids) == 1 else (
                F.when(F.col("mask") == F.lit(_signed(p)), arr) if pick is None
                else pick.when(F.col("mask") == F.lit(_signed(p)), arr))
        nodes = keep(rows.select("fp", F.explode(pick).alias("mask"))
                     .withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))).distinct(), "simhash-nodes")
        sizes = keep(nodes.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                     "simhash-sizes")
        small = nodes.join(sizes.where(F.col("n") <= node_rows), ["mask", "pattern"])
        ordered = small.repartition(partitions(spark), "mask", "pattern").sortWithinPartitions("mask", "pattern")
        found.append(keep(ordered.select("mask", "pattern", "fp").mapInArrow(
            _node_links(max_bits), "a long, b long").distinct(), "simhash-links"))
        large = sizes.where(F.col("n") > node_rows)
        level = {m: ((1 << 64) - 1) & ~m for ms in kids.values() for m in ms}
        if large.isEmpty():
            drop(nodes, sizes)
            break
        rows = nodes.join(large, ["mask", "pattern"], "left_semi").select("fp", "mask")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def _node_links(max_bits: int, rows_at_once: int = 1 << 16):
    """Links within whole nodes; nodes arrive one after the other, each at most ``node_rows`` long."""
    def links(mask, pattern, fp):
        group = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]))
        x, y = gray_links(group, fp.view(np.uint64), max_bits)
        picked = _forest(x, y)
        return pa.RecordBatch.from_arrays([pa.array(fp[x[picked]]), pa.array(fp[y[picked]])], names=["a", "b"])

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for b in batches:
            rest = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns)]
            if len(rest[0]) < rows_at_once:
                continue
            last = (rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield links(*[r[:cut] for r in rest])
                rest = [r[cut:] for r in rest]
        if len(rest[0]):
            yield links(*rest)

    return run


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest non-null doc_id that is reachable over links of at most
    ``max_bits`` differing bits (null if the component has none).  A null or empty text, or one
    without words, has fingerprint zero and is linked like any other.  Repeated rows are kept and
    share their component.  Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = keep(simhash(d, shingle).select("doc_id", "fp"), "simhash")
    return _components(prints, max_bits)


def _roots(first: DataFrame, max_bits: int) -> DataFrame:
    """``fp``, ``root`` of the distinct fingerprints that have a link."""
    links = hamming_links(first.select("fp"), max_bits)
    return keep(connected_components(links).select(F.col("node").alias("fp"), "root"), "simhash-roots")


def _components(prints: DataFrame, max_bits: int) -> DataFrame:
    first = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = _roots(first, max_bits)
    linked = first.join(roots, "fp")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    group = keep(roots.join(lows, "root").select("fp", "component_id"), "simhash-groups")
    named = first.join(group, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    drop(roots)
    return prints.join(keep(named, "simhash-named"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` for each group: the row with the smallest doc_id, then by a hash of its text.

    A null doc_id counts as larger than every other, so such a row stays if its whole group has no
    doc_id and it is the first by text.  Rows that share a doc_id or have none are judged one by one;
    of rows equal in doc_id and text one stays.  Texts without a word (null and empty ones too) form one
    group, so one of them stays.  Texts of any length are judged whole.
    """
    d = docs.select(doc_key().alias("did"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    prints = keep(simhash(d, shingle), "simhash")
    first = keep(prints.groupBy("fp").agg(F.min(F.struct("did", "th")).alias("low")), "simhash-distinct")
    roots = _roots(first, max_bits)
    stay = first.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")) \
                .agg(F.min("low").alias("low")).select("low.did", "low.th")
    rows = prints.groupBy("did", "th").agg(F.count(F.lit(1)).alias("n")) \
                 .join(stay.withColumn("stays", F.lit(True)), ["did", "th"], "left")
    judged = keep(rows.where(F.col("stays").isNull() | (F.col("n") > 1)).select("did", "th", "stays"), "simhash-judged")
    drop(prints, first, roots)
    key = ["did", "th"]  # beside the row as one struct, so that no name of ``docs`` clashes
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("did"),
                        text_key().alias("th"))
    left = named.join(judged.where("stays is null"), key, "left_anti")
    many = judged.where("stays")
    if not many.isEmpty():
        one = left.join(many, key, "left_semi").dropDuplicates(key)
        left = left.join(many, key, "left_anti").unionByName(one)
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])
