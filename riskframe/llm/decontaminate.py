"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Words are lower-cased runs of ASCII letters and digits or non-ASCII bytes; characters of scripts written
without spaces are words of their own.  An item of n words leaks into a document if some stretch of the
document is within ``max_ratio`` * n word edits of it, so items of few words match exactly.  By the
pigeonhole principle such a stretch shares a run of r words with the item (r follows from n and the
ratio), so item-sized windows are laid only where a run of r words matches; items are indexed by their r.  The CGK random walk maps
each window and item to a string whose Hamming distance follows the edit distance; a window is a
candidate if it agrees with the item on all sampled positions of at least one of ``repeats`` walks,
and candidates are verified by the exact edit distance.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers
from .rolling import Roller, mix, words

#: Bytes of benchmark text that one broadcast block may hold.
BLOCK_BYTES = 16 << 20
#: Document bytes matched at once: walks cost a fixed number of array steps however many windows there are.
MATCH_BYTES = 1 << 20
#: Matching runs that are expanded at once.
SEEDS = 1 << 18
# Fixed value: code points of scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han).
_UNSPACED = regex.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                          "\U00020000-\U0003ffff]")
_SPLIT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PAD = np.uint64(0)


@dataclass
class Rules:
    max_ratio: float = 0.2
    repeats: int = 24
    bits: int = 2
    min_words: int = 1
    seed: int = 5


def _prepared(text: str | None) -> str:
    """``text`` in lower case, with spaces round characters that are words of their own."""
    text = (text or "").lower()
    return text if text.isascii() or not _UNSPACED.search(text) else _UNSPACED.sub(r" \g<0> ", text)


def _lowered(col) -> pa.Array:
    return pa.array([_prepared(x) for x in col.to_pylist()], pa.large_string())


class _Words:
    """Word fingerprints of concatenated rows."""

    def __init__(self):
        self.bytes, self.seq = Roller(31), Roller(32)

    def __call__(self, data, offsets):
        start, end, row = words(data, offsets, _SPLIT)
        return self.bytes.slices(self.bytes.prefix(data), start, end) | np.uint64(1), row


def cgk(tokens: np.ndarray, size: np.ndarray, picks: np.ndarray, seed: int) -> np.ndarray:
    """Embedded symbols at the sampled steps ``picks`` (rows x bits) of one random walk.

    ``tokens`` is padded; at each step the walk outputs the symbol under its pointer and a shared
    random bit of (step, symbol) says whether the pointer moves on.
    """
    rows = np.arange(len(tokens))
    at = np.zeros(len(tokens), np.int64)
    out = np.zeros(picks.shape, np.uint64)
    wide = tokens.shape[1]
    for step in range(int(picks.max(initial=-1)) + 1):
        sym = np.where(at < size, tokens[rows, np.minimum(at, wide - 1)], _PAD)
        hit = picks == step
        if hit.any():
            out = np.where(hit, sym[:, None], out)
        at += (mix(sym + np.uint64((seed * 1_000_003 + step) * 2654435761 & (1 << 62) - 1)) & np.uint64(1)).astype(np.int64)
    return out


def edit_distance(item: np.ndarray, region: np.ndarray) -> int:
    """Smallest number of word edits between ``item`` and any stretch of ``region``."""
    cols = np.arange(len(region) + 1)
    prev = np.zeros(len(region) + 1, np.int64)
    for i, w in enumerate(item, 1):
        row = np.empty_like(prev)
        row[0] = i
        row[1:] = np.minimum(prev[:-1] + (region != w), prev[1:] + 1)
        prev = np.minimum.accumulate(row - cols) + cols
    return int(prev.min())


class Matcher:
    """Finds the items of one block in documents."""

    def __init__(self, items: list[tuple[int, str]], rules: Rules):
        self.rules, self.words = rules, _Words()
        self.ids, self.items = [], []
        for item_id, text in items:
            raw = np.frombuffer(_prepared(text).encode(), np.uint8)
            w, _ = self.words(raw, np.array([0, len(raw)]))
            if len(w) >= rules.min_words:
                self.ids.append(item_id)
                self.items.append(w)
        if not self.items:
            return
        self.size = np.array([len(w) for w in self.items])
        self.edits = np.floor(self.size * rules.max_ratio + 1e-9).astype(np.int64)
        run = -(-(self.size - self.edits) // (self.edits + 1))
        self.index = {int(r): self._grams(np.flatnonzero(run == r), int(r)) for r in np.unique(run)}
        self.padded = np.zeros((len(self.items), int(self.size.max())), np.uint64)
        for i, w in enumerate(self.items):
            self.padded[i, :len(w)] = w
        rng = np.random.Generator(np.random.PCG64(rules.seed))
        draws = rng.random((rules.repeats, len(self.items), rules.bits))
        self.picks = [np.floor(d * (3 * self.size[:, None])).astype(np.int64) for d in draws]
        self.embedded = [cgk(self.padded, self.size, p, k) for k, p in enumerate(self.picks)]

    def _grams(self, items: np.ndarray, run: int):
        """Sorted names of all runs of ``run`` words of ``items``, the item and place of each, and a bitmap of names."""
        grams = [self.words.seq.windows(self.words.seq.prefix(self.items[i]), run) for i in items]
        of = np.repeat(items, [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams])
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        bitmap = np.zeros(1 << 22, bool)
        bitmap[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return grams[order], of[order], pos[order], bitmap

    def seeds(self, prefix: np.ndarray):
        """Run length and (position, item, place) of the document runs that an item has, some ``SEEDS`` at once."""
        for run, (known, of, pos, bitmap) in self.index.items():
            grams = self.words.seq.windows(prefix, run)
            at = np.flatnonzero(bitmap[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
            lo, hi = (np.searchsorted(known, grams[at], side=s) for s in ("left", "right"))
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            total, i = np.concatenate([[0], np.cumsum(n)]), 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(total, total[i] + SEEDS, side="right")) - 1)
                m = n[i:j]
                entry = np.arange(m.sum()) - np.repeat(total[i:j] - total[i], m) + np.repeat(lo[i:j], m)
                yield run, np.repeat(at[i:j], m), of[entry], pos[entry]
                i = j

    def find(self, data, offsets):
        """Verified (row, item index, first word, edits) of one chunk; the best stretch of each pair."""
        if not self.items:
            return []
        tokens, row = self.words(data, offsets)
        first = np.searchsorted(row, np.arange(len(offsets) - 1))
        last = np.searchsorted(row, np.arange(len(offsets) - 1), side="right")
        best: dict = {}
        for run, at, item, pos in self.seeds(self.words.seq.prefix(tokens)):
            inside = row[at] == row[at + run - 1]
            at, item, pos = at[inside], item[inside], pos[inside]
            start = np.maximum(at - pos, first[row[at]])
            self._verify(tokens, first, last, np.unique(np.stack([row[at], item, start]), axis=1), best)
        return [(r, it, s, d) for (r, it), (d, s) in best.items()]

    def _verify(self, tokens, first, last, key, best):
        """Walk and verify windows ``key`` (row, item, start); ``best`` keeps (edits, first word) per pair."""
        for i in range(0, key.shape[1], 8192):
            r, it, s = key[:, i:i + 8192]
            size = np.minimum(self.size[it], last[r] - s)
            wide = int(self.size.max())
            cols = np.arange(wide)
            window = np.where(cols < size[:, None], tokens[np.minimum(s[:, None] + cols, len(tokens) - 1)], _PAD)
            alike = np.zeros(len(r), bool)
            for k, picks in enumerate(self.picks):
                left = np.flatnonzero(~alike)
                if not len(left):
                    break
                got = cgk(window[left], size[left], picks[it[left]], k)
                alike[left] = (got == self.embedded[k][it[left]]).all(axis=1)
            for j in np.flatnonzero(alike):
                pair = int(r[j]), int(it[j])
                if best.get(pair, (1 << 30,))[0] == 0:
                    continue
                e, n = int(self.edits[it[j]]), int(self.size[it[j]])
                w = self.items[it[j]]
                if size[j] == n and (tokens[s[j]:s[j] + n] == w).all():
                    d = 0
                else:
                    d = edit_distance(w, tokens[max(s[j] - e, first[r[j]]):min(s[j] + n + e, last[r[j]])])
                if d <= e:
                    best[pair] = min(best.get(pair, (1 << 30, 0)), (d, int(s[j] - first[r[j]])))


def _blocks(benchmark: DataFrame):
    """Items in blocks of bounded size, by a hash of their text; each block is small enough to broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
                     .where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _found(matcher: Matcher, batch, text):
    texts = batch.column(text)
    for i, j in chunks(text_buffers(texts)[1], MATCH_BYTES):
        for r, it, s, d in matcher.find(*text_buffers(_lowered(texts.slice(i, j - i)))):
            yield i + r, it, s, d


def leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs`` and item that leaks into it: doc_id, item_id, first_word, edits.

    first_word counts the document's words before the best window, the first of equally good ones.  Null or
    empty texts never match; items that are null or have fewer than ``min_words`` words are no evidence and are
    left out (by default only items without a word).  Texts of any length are matched whole.
    Repeated rows give equal rows; a null doc_id is returned as null; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word long, edits int"
    out = spark.createDataFrame([], schema)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rules)
            for b in batches:
                got = list(_found(matcher, b, 1))
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r] for r, *_ in got], pa.int64()), pa.array([matcher.ids[i] for _, i, _, _ in got], pa.int64()),
                     pa.array([s for *_, s, _ in got], pa.int64()), pa.array([d for *_, d in got], pa.int32())],
                    names=["doc_id", "item_id", "first_word", "edits"])

        out = out.unionByName(own.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` into which no item leaks; columns unchanged."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rules)
            for b in batches:
                mask = np.ones(b.num_rows, bool)
                mask[[r for r, *_ in _found(matcher, b, at)]] = False
                yield b.filter(pa.array(mask))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
