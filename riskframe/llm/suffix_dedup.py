"""Byte-level deduplication with a sparse suffix array.

Suffixes are sampled where a content-defined factor begins, so every ``length``-byte string lies in
exactly one factor named by its leading token (the factor's anchor gram).  The sampled suffixes are
range-partitioned by (leading token, fingerprint of the rest) with splitters that Spark samples;
each bucket is sorted by a multikey sort that refines only tied rows, and neighbours are compared.
Row position is the last sort key, so the suffixes of a very common string spread over many buckets;
the first and last suffix of each bucket go to a small table in which buckets are compared across
their boundaries.  A factor that occurs twice is a repeat as a whole.  Where factors share their
leading token but not their rest, one representative of each is cut again with a longer leading
token, and where even those agree only in part, all its ``length``-byte suffixes are sorted the same
way.  The result is exact up to 128-bit names.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_key, drop, keep, partitions, text_buffers
from .factors import Factors, expand, factorise, flat_lists
from .rolling import Roller, covered, sliding_min

_ROW = "k1 long, k2 long, did long, th long, start int, run int"
#: Suffixes in one bucket of the sort.
BUCKET_ROWS = 300_000


class _Cutter:
    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, max(1, gram)
        self.bytes = Roller(21)

    def __call__(self, data, offsets):
        row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        prefix = self.bytes.prefix(data)
        return row, prefix, factorise(self.bytes, prefix, row, self.length, self.gram)

    def repeats_anchor(self, prefix, f) -> np.ndarray:
        """Whether a factor holds its anchor gram twice (a window may then repeat inside it)."""
        if not len(f.start):
            return np.zeros(0, bool)
        g = self.length - self.gram + 1
        view = np.lib.stride_tricks.sliding_window_view(self.bytes.windows(prefix, self.gram), g)
        out = np.empty(len(f.start), bool)
        for i in range(0, len(out), 4096):
            s, e = f.start[i:i + 4096], (f.start + f.run - 1)[i:i + 4096]
            out[i:i + 4096] = s + view[s].argmin(1) != e + g - 1 - view[e][:, ::-1].argmin(1)
        return out


def _sampled(length: int):
    """(leading token, rest, row key, start, run) of each factor; the run is negative if its anchor repeats."""
    def run(batches):
        cut = _Cutter(length, length // 2)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            did, th = b.column("did").to_numpy(), b.column("th").to_numpy()
            for i, j in chunks(offsets):
                lo = offsets[i]
                off = offsets[i:j + 1] - lo
                row, prefix, (f, _) = cut(data[lo:offsets[j]], off)
                of = row[f.start]
                size = np.where(cut.repeats_anchor(prefix, f), -f.run, f.run)
                yield _record(f.anchor, f.name, did[i:j][of], th[i:j][of], f.start - off[of], size)
    return run


def _record(k1, k2, did, th, start, run):
    return pa.RecordBatch.from_arrays(
        [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(did), pa.array(th),
         pa.array(start.astype(np.int32)), pa.array(run.astype(np.int32))],
        names=["k1", "k2", "did", "th", "start", "run"])


def _cut_again(length: int, gram: int):
    """Factors with a longer leading token inside the factors in ``parts``."""
    def run(batches):
        cut = _Cutter(length, gram)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            did, th = b.column("did").to_numpy(), b.column("th").to_numpy()
            parts, of = flat_lists(b.column("parts"))
            start, size = (parts.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            for i, j in chunks(offsets):
                lo = offsets[i]
                p, q = np.searchsorted(of, [i, j])
                part = np.repeat(np.arange(p, q), size[p:q])
                at = expand(start[p:q], size[p:q]) + (offsets[of[part]] - lo)
                prefix = cut.bytes.prefix(data[lo:offsets[j]])
                low = sliding_min(cut.bytes.windows(prefix, gram), length - gram + 1)[at]
                new = np.ones(len(at), bool)
                new[1:] = (low[1:] != low[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(new)
                f = Factors(at[first], np.diff(np.append(first, len(at))), low[first], np.zeros(0, np.uint64))
                f.name = cut.bytes.slices(prefix, f.start, f.start + f.run + length - 1)
                row = of[part[first]]
                run_size = np.where(cut.repeats_anchor(prefix, f), -f.run, f.run)
                yield _record(f.anchor, f.name, did[row], th[row], f.start - (offsets[row] - lo), run_size)
    return run


def _suffixes(length: int):
    """All ``length``-byte suffixes of the factors in ``parts``; the leading token is their first 8 bytes."""
    weight = np.uint64(256) ** np.arange(7, -1, -1, dtype=np.uint64)

    def run(batches):
        roller = Roller(22)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            did, th = b.column("did").to_numpy(), b.column("th").to_numpy()
            parts, of = flat_lists(b.column("parts"))
            start, size = (parts.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            for i, j in chunks(offsets):
                lo = offsets[i]
                p, q = np.searchsorted(of, [i, j])
                row = np.repeat(of[p:q], size[p:q])
                at = expand(start[p:q], size[p:q])
                part = data[lo:offsets[j]]
                where = at + (offsets[row] - lo)
                name = roller.windows(roller.prefix(part), length)
                wide = min(8, length)
                lead = np.zeros(len(where), np.uint64)
                for k in range(wide):
                    lead += part[where + k].astype(np.uint64) * weight[k]
                lead ^= np.uint64(1 << 63)  # order of unsigned bytes in a signed column
                yield _record(lead, name[where], did[row], th[row], at, np.ones(len(at)))
    return run


def _multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key; only runs of equal keys are sorted on by the next one."""
    order = np.argsort(keys[0], kind="stable")
    group = np.cumsum(np.concatenate([[0], np.diff(keys[0][order]) != 0]))
    for key in keys[1:]:
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((key[rows], group[tied]))]
        k = key[order]
        group = np.cumsum(np.concatenate([[0], ~same | (k[1:] != k[:-1])]))
    return order


def _compare_neighbours(batches):
    """One sorted bucket -> repeated suffixes (kind 0), factors to check (1), the bucket's edges (2).

    An edge row has the number of its equals in the bucket; representatives to check are one per
    distinct name and bucket.
    """
    got = [[np.zeros(0, np.int64)] for _ in range(6)]
    for b in batches:
        for part, c in zip(got, b.columns):
            part.append(c.to_numpy())
    k1, k2, did, th, start, run = (np.concatenate(x) for x in got)
    n = len(k1)
    if not n:
        return
    order = _multikey_order([k1, k2])
    k1, k2, did, th, start, run = (x[order] for x in (k1, k2, did, th, start, run))
    new1 = np.concatenate([[True], k1[1:] != k1[:-1]])
    new2 = new1 | np.concatenate([[True], k2[1:] != k2[:-1]])
    first = np.flatnonzero(new2)
    count = np.diff(np.append(first, n))
    repeat = np.repeat(count > 1, count)
    names = np.add.reduceat(new2.astype(np.int64), np.flatnonzero(new1))  # distinct rests per leading token
    per_row = np.repeat(names, np.diff(np.append(np.flatnonzero(new1), n)))
    check = first[(per_row[first] > 1) | (run[first] < 0)]
    edge = np.unique([0, len(first) - 1])

    def rows(at, kind, times=None):
        times = np.ones(len(at), np.int64) if times is None else times
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (k1[at], k2[at], did[at], th[at], start[at].astype(np.int32),
                                   np.abs(run[at]).astype(np.int32), np.full(len(at), kind, np.int32), times)],
            names=["k1", "k2", "did", "th", "start", "run", "kind", "times"])

    yield rows(np.flatnonzero(repeat), 0)
    yield rows(np.setdiff1d(check, first[edge]), 1)
    yield rows(first[edge], 2, count[edge])


def _sorted_repeats(suffixes: DataFrame) -> DataFrame:
    spark = suffixes.sparkSession
    n = max(partitions(spark), -(-suffixes.count() // BUCKET_ROWS))
    return keep(suffixes.repartitionByRange(n, "k1", "k2", "did", "th", "start")
                .mapInArrow(_compare_neighbours, _ROW + ", kind int, times long"), "repeats")


def _repeated(found: DataFrame) -> DataFrame:
    """Spans of repeated suffixes, edges that equal an edge of another bucket included."""
    edges = found.where("kind = 2")
    across = edges.groupBy("k1", "k2").agg(F.sum("times").alias("n")).where("n > 1").select("k1", "k2")
    single = edges.where("times = 1").join(across, ["k1", "k2"], "left_semi")
    return found.where("kind = 0").unionByName(single).select("did", "th", "start", "run")


def _remove(length: int):
    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            spans, of = flat_lists(b.column("spans"))
            start, width = (spans.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            n, size = len(offsets) - 1, np.diff(offsets)
            removed, n_spans, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
            for i, j in chunks(offsets):
                p, q = np.searchsorted(of, [i, j])
                lo = offsets[i]
                off = offsets[i:j + 1] - lo
                gone = covered(start[p:q] + off[of[p:q] - i], width[p:q] + length - 1, int(off[-1]))
                begins = gone & ~np.concatenate([[False], gone[:-1]])
                heads = off[:-1][np.diff(off) > 0]
                begins[heads] = gone[heads]
                removed[i:j] = np.diff(np.concatenate([[0], np.cumsum(gone)])[off])
                n_spans[i:j] = np.diff(np.concatenate([[0], np.cumsum(begins)])[off])
                kept.append(data[lo:offsets[j]][~gone].tobytes())
            bounds = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.tobytes()),
                                                          pa.py_buffer(b"".join(kept))])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size), pa.array(removed), pa.array(n_spans), kept],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def remove_repeated_strings(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the kept bytes (binary).

    A byte goes if it is covered by a ``length``-byte string that also starts at another place, in
    the same row or another, overlaps included.  Strings never cross rows.  A null text is empty;
    a text shorter than ``length`` bytes loses nothing.  Repeated rows are repeats of each other,
    also with equal or null doc_id.  Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
            .withColumn("did", doc_key()).withColumn("th", F.xxhash64("text"))
    sampled = keep(d.select("did", "th", "text").mapInArrow(_sampled(length), _ROW), "suffixes")
    levels = [_sorted_repeats(sampled)]
    drop(sampled)
    for cut in (_cut_again(length, max(1, 9 * length // 10)), _suffixes(length)):
        parts = levels[-1].where("kind > 0").groupBy("did", "th").agg(
            F.collect_set(F.struct("start", "run")).alias("parts"))
        inner = keep(d.join(parts.hint("shuffle_hash"), ["did", "th"]).select("did", "th", "text", "parts")
                     .mapInArrow(cut, _ROW), "suffixes-inner")
        levels.append(_sorted_repeats(inner))
        drop(inner)
    found = _repeated(levels[0]).unionByName(_repeated(levels[1])).unionByName(_repeated(levels[2]))
    spans = keep(found.groupBy("did", "th").agg(F.collect_list(F.struct("start", "run")).alias("spans")), "spans")
    drop(*levels)
    return d.join(spans.hint("shuffle_hash"), ["did", "th"], "left").select("doc_id", "text", "spans") \
            .mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
