"""Substring deduplication of word sequences by a relative Lempel-Ziv parse.

Every document is parsed into factors against a reference made of all documents with smaller ids.
The reference is indexed by factor: one row per distinct factor with the earliest document that
holds it, hashed into blocks (Spark partitions) and built by a partial aggregate, so a passage that
a third of the documents share costs one row per task.  A factor found in an earlier document is a
duplicate span as a whole.  Factors that agree with another factor only in part (they share an
anchor but not all words) lie at the boundary of a copied passage: their single windows are looked
up in a second index of the same form, so that windows across factor boundaries are checked too and
the result is exact up to 128-bit fingerprints.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, chunks, doc_key, drop, keep, text_buffers, text_key
from .factors import expand, factorise, flat_lists
from .rolling import Roller, covered, mix, words


class _Parser:
    def __init__(self, window: int):
        self.window, self.gram = window, max(1, (2 * window) // 5)
        self.bytes, self.words = Roller(11), Roller(12)

    def __call__(self, data, offsets):
        start, end, row = words(data, offsets)
        prefix = self.words.prefix(self.bytes.slices(self.bytes.prefix(data), start, end))
        found, low = factorise(self.words, prefix, row, self.window, self.gram)
        return start, end, row, prefix, found, low


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _factor_rows(window: int):
    def run(batches):
        parse = _Parser(window)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            ids = b.column("did").to_numpy()
            for i, j in chunks(offsets):
                lo = offsets[i]
                _, _, row, _, f, _ = parse(data[lo:offsets[j]], offsets[i:j + 1] - lo)
                yield pa.RecordBatch.from_arrays(
                    [_signed(f.anchor), _signed(f.name), pa.array(ids[i:j][row[f.start]])], names=["anchor", "name", "did"])
    return run


def _rows_in(values, of, i, j):
    """Entries of a flattened list column that belong to rows i..j, as keys of (row, value)."""
    a, b = np.searchsorted(of, [i, j])
    return _row_key(values[a:b], of[a:b] - i)


def _row_key(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    return values ^ mix(row.astype(np.uint64) + np.uint64(1))


def _boundary_windows(window: int):
    def run(batches):
        parse = _Parser(window)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            ids = b.column("did").to_numpy()
            values, of = flat_lists(b.column("names"))
            values = values.to_numpy().view(np.uint64)
            for i, j in chunks(offsets):
                lo = offsets[i]
                _, _, row, prefix, f, low = parse(data[lo:offsets[j]], offsets[i:j + 1] - lo)
                pick = np.isin(_row_key(f.name, row[f.start]), _rows_in(values, of, i, j))
                at = expand(f.start[pick], f.run[pick])
                name = parse.words.windows(prefix, window)[at]
                yield pa.RecordBatch.from_arrays(
                    [_signed(low[at]), _signed(name), pa.array(ids[i:j][row[at]])], names=["anchor", "name", "did"])
    return run


def _remove(window: int):
    def run(batches):
        parse = _Parser(window)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            lists = []
            for c in ("held", "checked", "windows"):
                values, of = flat_lists(b.column(c))
                lists.append((values.to_numpy().view(np.uint64), of))
            n_words, n_removed, kept, sizes = [], [], [], []
            for i, j in chunks(offsets):
                lo = offsets[i]
                part, off = data[lo:offsets[j]], offsets[i:j + 1] - lo
                start, end, row, prefix, f, _ = parse(part, off)
                held, checked, single = (_rows_in(v, of, i, j) for v, of in lists)
                key = _row_key(f.name, row[f.start])
                copied = ~np.isin(key, held)
                inner = ~copied & np.isin(key, checked)
                at = expand(f.start[inner], f.run[inner])
                name = parse.words.windows(prefix, window)[at]
                at = at[~np.isin(_row_key(name, row[at]), single)]
                gone = covered(np.concatenate([f.start[copied], at]),
                               np.concatenate([f.run[copied] + window - 1, np.full(len(at), window)]), len(start))
                n_words.append(np.bincount(row, minlength=j - i))
                n_removed.append(np.bincount(row[gone], minlength=j - i))
                # kept words, each but the first of its row with the white space before it as one space
                ks, ke, kr = start[~gone], end[~gone], row[~gone]
                mask = np.zeros(len(part) + 1, np.int8)
                np.add.at(mask, ks, 1)
                np.add.at(mask, ke, -1)
                mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
                gap = ks[1:][kr[1:] == kr[:-1]] - 1
                part = part.copy()
                part[gap] = 32
                mask[gap] = True
                kept.append(part[mask])
                sizes.append(np.diff(np.concatenate([[0], np.cumsum(mask)])[off]))
            n = len(offsets) - 1
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            bounds = np.concatenate([[0], np.cumsum(cat(sizes))]).astype(np.int32)
            text = pa.StringArray.from_buffers(n, pa.py_buffer(bounds.tobytes()),
                                               pa.py_buffer(cat(kept).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cat(n_words).astype(np.int64)), pa.array(cat(n_removed).astype(np.int64)), text],
                names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if it is covered by ``window`` consecutive words that also occur in a document with a
    smaller doc_id.  A null text has no words; a text of fewer words than ``window`` loses none.  A
    null doc_id counts as larger than every other.  Rows with equal doc_id are never earlier than
    each other, so repeated rows give equal results; the lists of rows without a doc_id are kept by text,
    so many of them share no key.  Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
            .withColumn("did", doc_key()).withColumn("th", F.when(F.col("did") == NO_ID, text_key()).otherwise(0))
    # rows without an id are one document to the index, but each of their texts has lists of its own
    no_id = d.where(F.col("doc_id").isNull() | (F.col("doc_id") == NO_ID))
    index_schema = "anchor long, name long, did long"

    def lists_of(index: DataFrame, own: DataFrame) -> DataFrame:
        """Entries of the index by (did, th); what only rows without an id hold goes to each text that has it."""
        alone = own.select("name", F.col("did").alias("th")).join(index.where(F.col("did") == NO_ID).select("name"), "name", "left_semi")
        return index.where(F.col("did") != NO_ID).select("did", F.lit(0).cast("long").alias("th"), "name") \
                    .union(alone.select(F.lit(NO_ID).alias("did"), "th", "name"))

    # reference index: each distinct factor with the earliest document that holds it
    factors = keep(d.select("did", "text").mapInArrow(_factor_rows(window), index_schema)
                   .groupBy("anchor", "name").agg(F.min("did").alias("did")), "factors")
    own_factors = keep(no_id.select(F.col("th").alias("did"), "text").mapInArrow(_factor_rows(window), index_schema).distinct(),
                       "factors-no-id")
    several = factors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    checked = keep(factors.join(several, "anchor", "left_semi").select("did", "name"), "factors-checked")
    names = lists_of(checked, own_factors).groupBy("did", "th").agg(F.collect_list("name").alias("names"))
    windows = d.join(names.hint("shuffle_hash"), ["did", "th"])
    singles = keep(windows.select("did", "text", "names").mapInArrow(_boundary_windows(window), index_schema)
                   .groupBy("anchor", "name").agg(F.min("did").alias("did")).select("did", "name"), "windows-held")
    own_windows = no_id.select("did", "th", "text").join(names.where(F.col("did") == NO_ID).hint("shuffle_hash"), ["did", "th"]) \
                       .select(F.col("th").alias("did"), "text", "names") \
                       .mapInArrow(_boundary_windows(window), index_schema).distinct()
    entry = lambda df, k: df.select("did", "th", "name", F.lit(k).alias("kind"))
    of_kind = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("name")))
    entries = entry(lists_of(factors, own_factors), 0).union(entry(lists_of(checked, own_factors), 1)) \
        .union(entry(lists_of(singles, own_windows), 2))
    per_doc = keep(entries.groupBy("did", "th").agg(of_kind(0).alias("held"), of_kind(1).alias("checked"),
                                                    of_kind(2).alias("windows")), "held")
    drop(factors, own_factors, checked, singles)
    return d.join(per_doc.hint("shuffle_hash"), ["did", "th"], "left") \
            .select("doc_id", "text", "held", "checked", "windows") \
            .mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_text string")
