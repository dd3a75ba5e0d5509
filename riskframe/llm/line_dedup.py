"""Line deduplication over edit distance by a deletion-neighbourhood join.

Two lines are near if one edit (a code point inserted, deleted or replaced) turns one into the other.
Every line would emit its variants with one code point deleted as hashed keys; equal variants join:

* lines of equal length whose variants agree after deleting the same place differ in that place only;
* a line that equals a variant of a longer line is that line with one code point deleted.

The place of the deletion thus decides the exact edit distance of two lines with equal variants, and
a bucket needs no pairs: its earliest line is the earliest neighbour of all.  Before that, lines are
cut into ``SEGMENTS`` segments and keyed by all but one of them.  Lines within one edit agree on such
a key, so only lines that share one emit variants, and only for the segment left out.  Nothing is
lost by that: it is the same neighbourhood with a whole segment deleted at first.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_key, drop, keep, text_buffers, text_key
from .factors import flat_lists
from .rolling import Roller, mix, words

SEGMENTS = 3
_KEYS = [f"k{j}" for j in range(2 * SEGMENTS)]


class _Lines:
    """Lines of concatenated rows, without the white space around them, addressed by code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, roller: Roller):
        self.roller = roller
        breaks = np.flatnonzero(data == 10)
        self.raw_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        self.raw_end = np.sort(np.concatenate([breaks, offsets[1:]]))
        lines = np.diff(np.searchsorted(breaks, offsets)) + 1  # an empty row has one line
        self.row = np.repeat(np.arange(len(offsets) - 1), lines)
        heads = np.cumsum(lines) - lines
        self.nth = np.arange(len(self.row)) - np.repeat(heads, lines)
        ws, we, _ = words(data, offsets)
        first, last = np.searchsorted(ws, self.raw_start), np.searchsorted(we, self.raw_end, side="right") - 1
        some = first <= last
        pad = lambda a: a if len(a) else np.zeros(1, np.int64)
        self.start = np.where(some, pad(ws)[np.minimum(first, max(len(ws) - 1, 0))], self.raw_start)
        self.end = np.where(some, pad(we)[np.maximum(last, 0)], self.raw_start)
        # byte offset of each code point, and how many begin before each byte
        self.point = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.first_point = before[self.start]
        self.size = before[self.end] - self.first_point
        self.prefix = roller.prefix(data)

    def name(self, pick) -> np.ndarray:
        return self.roller.slices(self.prefix, self.start[pick], self.end[pick])

    def without(self, pick, lo, hi) -> np.ndarray:
        """Name of each picked line without its code points lo to hi (exclusive)."""
        a, b = self.point[self.first_point[pick] + lo], self.point[self.first_point[pick] + hi]
        s, p = self.start[pick], self.prefix
        rest = (p[self.end[pick]] - p[b]) * self.roller.ipow[b - a]
        return mix((p[a] - p[s] + rest) * self.roller.ipow[s])


def _segment(size: np.ndarray, q) -> np.ndarray:
    return size * q // SEGMENTS


def _tag(name: np.ndarray, *numbers) -> np.ndarray:
    """Name of ``name`` together with whole numbers (arrays or single ones)."""
    for k, x in enumerate(numbers, 1):
        x = np.broadcast_to(np.asarray(x), name.shape).astype(np.uint64)
        name = mix(name ^ (x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)))
    return name


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _line_rows(min_chars: int):
    """Name, place and segment keys of every judged line."""
    def run(batches):
        roller = Roller(41)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            ids, th = b.column("did").to_numpy(), b.column("th").to_numpy()
            for i, j in chunks(offsets):
                lo = offsets[i]
                x = _Lines(data[lo:offsets[j]], offsets[i:j + 1] - lo, roller)
                at = np.flatnonzero(x.size >= min_chars)
                n = x.size[at]
                keys = [_tag(x.without(at, _segment(n, q), _segment(n, q + 1)), n, q) for q in range(SEGMENTS)]
                # as the longer line of a pair: the other has one code point less
                m = n - 1
                keys += [_tag(x.without(at, _segment(m, q), _segment(m, q + 1) + 1), m, q) for q in range(SEGMENTS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][x.row[at]]), pa.array(th[i:j][x.row[at]]), pa.array(x.nth[at].astype(np.int32)),
                     _signed(x.name(at)), *map(_signed, keys)], names=["did", "th", "nth", "name", *_KEYS])
    return run


def _variant_rows(min_chars: int):
    """Deletion variants of the lines in ``wanted`` (line number, name, key shared): two hashed keys each.

    part 0: deleted at the same place (lines of equal length); part 1: variant of the longer line;
    part 2: the shorter line itself.
    """
    def run(batches):
        roller, second = Roller(41), Roller(42)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            ids, th = b.column("did").to_numpy(), b.column("th").to_numpy()
            want, of = flat_lists(b.column("wanted"))
            nth, name, key = (want.field(k).to_numpy() for k in range(3))
            for i, j in chunks(offsets):
                lo = offsets[i]
                part, off = data[lo:offsets[j]], offsets[i:j + 1] - lo
                x, y = _Lines(part, off, roller), _Lines(part, off, second)
                p, q = np.searchsorted(of, [i, j])
                heads = np.searchsorted(x.row, np.arange(j - i))
                count = np.bincount(x.row, minlength=j - i)
                in_row = nth[p:q] < count[of[p:q] - i]
                line = heads[of[p:q] - i] + np.where(in_row, nth[p:q], 0)
                ok = in_row & (x.size[line] >= min_chars)
                ok[ok] = x.name(line[ok]).view(np.int64) == name[p:q][ok]
                line, k = line[ok], key[p:q][ok].astype(np.int64)
                same = k < SEGMENTS
                base, seg = x.size[line] - ~same, k % SEGMENTS
                lo_pt, hi_pt = _segment(base, seg), _segment(base, seg + 1) + ~same
                size = hi_pt - lo_pt
                rep = np.repeat(np.arange(len(line)), size)
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo_pt, size)
                at = line[rep]
                v1, v2 = x.without(at, place, place + 1), y.without(at, place, place + 1)
                sub = same[rep]
                v1[sub] = _tag(v1[sub], x.size[at[sub]], place[sub])
                alone = np.unique(line[same])
                v1 = np.concatenate([v1, x.name(alone)])
                v2 = np.concatenate([v2, y.name(alone)])
                at = np.concatenate([at, alone])
                role = np.concatenate([np.where(sub, 0, 1), np.full(len(alone), 2)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_signed(v1), _signed(v2), pa.array(role), pa.array(ids[i:j][x.row[at]]),
                     pa.array(th[i:j][x.row[at]]), pa.array(x.nth[at].astype(np.int32))],
                    names=["v1", "v2", "part", "did", "th", "nth"])
    return run


def _rebuild(min_chars: int, at: int, kept_at: int, names: list[str]):
    """Replace the text of each row by its kept lines; adds n_lines and n_removed."""
    def run(batches):
        roller = Roller(41)
        for b in batches:
            data, offsets = text_buffers(b.column(at))
            held, of = flat_lists(b.column(kept_at))
            nth, name = (held.field(k).to_numpy() for k in (0, 1))
            texts, sizes, n_lines, n_removed = [], [], [], []
            for i, j in chunks(offsets):
                lo = offsets[i]
                part, off = data[lo:offsets[j]].copy(), offsets[i:j + 1] - lo
                x = _Lines(part, off, roller)
                p, q = np.searchsorted(of, [i, j])
                mark = lambda nm, n, r: _tag(nm, n, r)
                judged = np.flatnonzero(x.size >= min_chars)
                own = mark(x.name(judged), x.nth[judged], x.row[judged])
                stay = np.ones(len(x.row), bool)
                stay[judged] = np.isin(own, mark(name[p:q].view(np.uint64), nth[p:q], of[p:q] - i))
                mask = np.zeros(len(part) + 1, np.int8)
                ks, ke, kr = x.raw_start[stay], x.raw_end[stay], x.row[stay]
                np.add.at(mask, ks, 1)
                np.add.at(mask, ke, -1)
                mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
                mask[ks[1:][kr[1:] == kr[:-1]] - 1] = True  # the line break before a kept line
                gap = ks[1:][kr[1:] == kr[:-1]] - 1
                part[gap] = 10
                texts.append(part[mask].tobytes())
                sizes.append(np.diff(np.concatenate([[0], np.cumsum(mask)])[off]))
                n_lines.append(np.bincount(x.row, minlength=j - i))
                n_removed.append(np.bincount(x.row[~stay], minlength=j - i))
            cat = lambda v: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
            bounds = np.concatenate([[0], np.cumsum(cat(sizes))]).astype(np.int32)
            text = pa.StringArray.from_buffers(b.num_rows, pa.py_buffer(bounds.tobytes()), pa.py_buffer(b"".join(texts)))
            cols = [text if k == at else c for k, c in enumerate(b.columns) if k != kept_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cat(n_lines)), pa.array(cat(n_removed))], names=names)
    return run


def dedup_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    A line (text between ``\\n``, judged without the white space around it) goes if an earlier line of
    the input, by doc_id and then by line number, is equal to it or one edit away.  By default that
    holds for every line with a word, however short; lines of fewer than ``min_chars`` code points
    (by default those without a word) are neither judged nor matched and stay.  Kept lines are unchanged.
    A null text becomes empty (one empty line, none removed); a null doc_id counts as larger than
    every other.  Rows that share a doc_id, or have none, but differ in text are documents of their own,
    one after the other by a hash of their text; rows equal in both are one document and lose the same
    lines.  All other columns stay; existing columns named like the two counts are replaced.
    """
    from pyspark.sql.types import LongType, StructField, StructType
    docs = docs.drop("n_lines", "n_removed")
    own = docs.columns
    row_key = [doc_key().alias("did"), text_key().alias("th")]
    d = docs.select(*row_key, F.col("text").cast("string").alias("text"))
    schema = "did long, th long, nth int, name long, " + ", ".join(f"{k} long" for k in _KEYS)
    lines = keep(d.mapInArrow(_line_rows(min_chars), schema).groupBy("name", *_KEYS)
                 .agg(F.min(F.struct("did", "th", "nth")).alias("first"))
                 .select("name", *_KEYS, "first.did", "first.th", "first.nth"), "lines")
    keyed = lines.select("did", "th", "nth", "name", F.posexplode(F.array(*_KEYS)).alias("key_no", "key"))
    shared = keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "line-keys")
    wanted = keyed.join(shared, "key", "left_semi").groupBy("did", "th").agg(
        F.collect_list(F.struct("nth", "name", "key_no")).alias("wanted"))
    variants = keep(d.join(wanted.hint("shuffle_hash"), ["did", "th"]).select("did", "th", "text", "wanted")
                    .mapInArrow(_variant_rows(min_chars), "v1 long, v2 long, part int, did long, th long, nth int"),
                    "variants")
    kind = F.when(F.col("part") == 0, 0).otherwise(1).alias("kind")
    place = F.struct("did", "th", "nth")
    buckets = keep(variants.groupBy("v1", "v2", kind).agg(
        F.min(place).alias("low"), F.min(F.when(F.col("part") == 2, place)).alias("short"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & ((F.col("kind") == 0) | F.col("short").isNotNull())), "buckets")
    earlier = F.when(F.col("part") == 1, F.col("short") < place).otherwise(F.col("low") < place)
    gone = variants.select("v1", "v2", kind, "part", "did", "th", "nth").join(buckets, ["v1", "v2", "kind"]) \
                   .where(earlier).select("did", "th", "nth").distinct()
    held = keep(lines.select("did", "th", "nth", "name").join(gone, ["did", "th", "nth"], "left_anti").groupBy("did", "th")
                .agg(F.collect_list(F.struct("nth", "name")).alias("held")), "lines-held")
    drop(lines, shared, variants, buckets)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != "text"]).alias("row"), *row_key,
                      F.col("text").cast("string").alias("text"))
    out = StructType([StructField("row", row.schema["row"].dataType), row.schema["text"],
                      StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    built = row.join(held.hint("shuffle_hash"), ["did", "th"], "left").select("row", "text", "held") \
               .mapInArrow(_rebuild(min_chars, 1, 2, out.names), out)
    return built.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in own], "n_lines", "n_removed")
