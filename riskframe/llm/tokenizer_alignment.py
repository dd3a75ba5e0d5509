"""Cross-tokenizer alignment with external spill counting.

Every text is encoded by two tokenizers.  Byte offsets where tokens of both end cut the text into groups,
and tokens whose byte ranges overlap are linked.  How often two ids are linked in the whole corpus is counted
externally: tasks collect links in runs of bounded size, sorted by (radix of the B id, B id, A id, document),
and write them as zstd blocks, keys per radix apart from the documents.  A k-way heap merge of the keys of all
runs of a radix adds up each pair; as B ids come one after the other, the highest count of a B id is known as
soon as its last pair has passed, and totals go back to the runs in the order of their keys.  Merges have a
bounded fan-in: with many runs they form a tree, sums going up and totals coming down.  A frequent pair is one
entry per run, whatever the number of documents that hold it.
"""
from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import drop, keep

_ID_BITS, _DOC_BITS = 20, 22
#: A word or gap of this length is left to the tokenizer library, whose time does not grow with its square.
LONG_STRETCH = regex.compile(r"\S{1000}|\s{1000}")
RESULT_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                 "groups_sha256 string")
_RUN_SCHEMA = ("run long, docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, "
               "body binary, heads array<struct<radix:int,head:binary>>")


@dataclass(frozen=True)
class Limits:
    """Sizes that bound memory; results do not depend on them."""
    run_links: int = 1 << 20
    chunk_bytes: int = 1 << 19
    radix_bits: int = 6
    fan_in: int = 128


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one zstd block; equal bytes of neighbouring values are brought together."""
    parts = [np.ascontiguousarray(a, np.int64) for a in arrays]
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = b"".join([sizes.tobytes(), *(p.view(np.uint8).reshape(-1, 8).T.tobytes() for p in parts)])
    return np.int64(len(parts)).tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(block: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    raw = zstandard.ZstdDecompressor().decompress(block[8:])
    out, at = [], 8 * n
    for size in np.frombuffer(raw, np.int64, n):
        cut = np.frombuffer(raw, np.uint8, int(size) * 8, at).reshape(8, -1)
        out.append(np.ascontiguousarray(cut.T).view(np.int64).reshape(-1))
        at += int(size) * 8
    return out


def load_byte_bpe(path: str) -> dict:
    """A byte-level BPE file as plain data to broadcast; its size does not grow with the corpus."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    spec = json.loads(raw)
    vocab, byte = spec["model"]["vocab"], {s: b for b, s in enumerate(byte_symbols())}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
    special = {t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for t, i in ranks.items() if i not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    ordered = [vocab[a + b] for a, b in pairs]
    split = spec["pre_tokenizer"] or {}
    # ids in merge order make rank merging equal to the library's
    fast = (ordered == sorted(ordered) and len(ranks) == len(ordered) + 256 and spec["normalizer"] is None
            and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"))
    return {"json": raw, "ranks": ranks if fast else None}


def load_pieces(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Pair:
    """Both tokenizers in one task, with the bytes of every id."""

    def __init__(self, a: dict, b: bytes, pattern: str):
        import sentencepiece
        import tiktoken
        import tokenizers
        self.slow = tokenizers.Tokenizer.from_str(a["json"])
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = a["ranks"] and tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=a["ranks"], special_tokens={})
        byte = {s: n for n, s in enumerate(byte_symbols())}
        self.a_bytes = [b""] * (max(self.slow.get_vocab().values()) + 1)
        for t, i in self.slow.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.pieces.get_piece_size()) for p in [self.pieces.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        va, vb = len(self.a_bytes), len(self.b_bytes)
        if max(va, vb) > 1 << _ID_BITS:
            raise ValueError(f"vocabularies of {va} and {vb} ids; at most {1 << _ID_BITS} are supported")
        a_text, b_text = ([str(i) for i in range(n)] for n in (va, vb))
        self.shown = [*(s + "," for s in a_text), *(s + "|" for s in a_text), *(s + "," for s in b_text), *(s + ";" for s in b_text)]

    def a_ids(self, text: str) -> list[int]:
        if self.fast and not LONG_STRETCH.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B per text; none for texts that a tokenizer does not give back byte by byte."""
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1) if texts else []):
            a, raw = (self.a_ids(" " + text), (" " + text).encode()) if text else ([], b"")
            good = text and b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((a, b) if good else ([], []))
        return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    ids = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    return ids, np.concatenate([[0], np.cumsum(sizes)])


def align(pair: Pair, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Per text (n_a, n_b, n_groups, n_links, digest of groups), and A id, B id and text number of every link."""
    both = pair.encode(texts)
    (a, a_at), (b, b_at) = _flat([x for x, _ in both]), _flat([x for _, x in both])
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    n = int(a_end[-1]) if len(a) else 0
    ends_a, ends_b = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    ends_a[a_end] = True
    ends_b[b_end] = True
    cut, common = np.flatnonzero(ends_a | ends_b), np.flatnonzero(ends_a & ends_b)
    # every stretch between neighbouring ends lies in one token of each side, and is one link
    at_a, at_b = np.searchsorted(a_end, cut), np.searchsorted(b_end, cut)
    text_end = np.concatenate([[0], a_end])[a_at[1:]]  # the last byte of each text, in both tokenisations
    of = np.searchsorted(text_end, cut)
    links = np.bincount(of, minlength=len(texts))
    groups = np.bincount(np.searchsorted(text_end, common), minlength=len(texts))
    # output order: the A tokens of a group, then its B tokens
    group_a, group_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
    last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + len(pair.a_bytes) * last_a
    shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = \
        2 * len(pair.a_bytes) + b + len(pair.b_bytes) * last_b
    rows = []
    for i in range(len(texts)):
        lo, hi = int(a_at[i] + b_at[i]), int(a_at[i + 1] + b_at[i + 1])
        name = ""
        if hi > lo:
            name = hashlib.sha256("".join(map(pair.shown.__getitem__, shown[lo:hi].tolist()))[:-1].encode()).hexdigest()
        rows.append((int(a_at[i + 1] - a_at[i]), int(b_at[i + 1] - b_at[i]), int(groups[i]), int(links[i]), name))
    return rows, a[at_a], b[at_b], of


def _side_major(a: np.ndarray, b: np.ndarray, radix_bits: int) -> np.ndarray:
    """Keys ordered by (radix of b, b, a); the radix is the low bits of b."""
    low = b & ((1 << radix_bits) - 1)
    return (((low << (_ID_BITS - radix_bits)) | (b >> radix_bits)) << _ID_BITS) | a


def runs(pair: Pair, rows: Iterator[tuple[int, str]], limits: Limits, first: int) -> Iterator[tuple]:
    """(run, documents, body, heads) from (doc_id, text) rows; a run holds whole documents.

    The body has, in key order, the number of documents of each key, the documents, and the links of each; the
    heads have the keys of each radix, as differences, and their links.
    """
    docs, codes, n_links, run = [], [], 0, first

    def flush():
        nonlocal docs, codes, n_links, run
        code = np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        start = np.flatnonzero(np.diff(code, prepend=-1))
        links = np.diff(start, append=len(code))
        key, doc = code[start] >> _DOC_BITS, code[start] & ((1 << _DOC_BITS) - 1)
        at = np.flatnonzero(np.diff(key, prepend=-1))
        total, keys = (np.add.reduceat(links, at) if len(at) else links), key[at]
        radix = keys >> (2 * _ID_BITS - limits.radix_bits)
        edge = [*np.flatnonzero(np.diff(radix, prepend=-1)), len(keys)]
        heads = [(int(radix[i]), pack(np.diff(keys[i:j], prepend=0), total[i:j])) for i, j in zip(edge, edge[1:])]
        out = run, docs, pack(np.diff(at, append=len(key)), doc, links), heads
        docs, codes, n_links, run = [], [], 0, run + 1
        return out

    def chunk(part):
        nonlocal n_links
        done, a, b, of = align(pair, [t for _, t in part])
        codes.append((_side_major(a, b, limits.radix_bits) << _DOC_BITS) | (of + len(docs)))
        docs.extend((d, *r) for (d, _), r in zip(part, done))
        n_links += len(a)

    part, size = [], 0
    for doc_id, text in rows:
        part.append((doc_id, text))
        size += 4 * len(text) + 64
        if size >= limits.chunk_bytes:
            chunk(part)
            part, size = [], 0
            if n_links >= limits.run_links or len(docs) >= 1 << (_DOC_BITS - 1):
                yield flush()
    if part:
        chunk(part)
    if docs:
        yield flush()


def merge(heads: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """k-way heap merge of (keys, links): all keys, their links, and for each head the place of its keys.

    Keys are read from the heads in short stretches, so that the heap holds one number per head.
    """
    k = len(heads)

    def stream(i, keys):
        for at in range(0, len(keys), 4096):
            yield from (keys[at:at + 4096] * k + i).tolist()

    n = sum(len(keys) for keys, _ in heads)
    code = np.fromiter(heapq.merge(*(stream(i, keys) for i, (keys, _) in enumerate(heads))), np.int64, n)
    key, head = code // k, code % k
    new = np.diff(key, prepend=-1) != 0
    place = np.cumsum(new) - 1
    order = np.argsort(head, kind="stable")
    places = np.split(place[order], np.cumsum([len(keys) for keys, _ in heads])[:-1])
    total = np.zeros(int(new.sum()), np.int64)
    for at, (_, links) in zip(places, heads):
        total[at] += links
    return key[new], total, places


def best_of_side(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which pairs have the highest total of their B id, ties included; keys are in side-major order."""
    side = keys >> _ID_BITS
    at = np.flatnonzero(np.diff(side, prepend=-1))
    return total == np.repeat(np.maximum.reduceat(total, at), np.diff(at, append=len(total)))


def _groups(batches) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows (radix, parent, kind, node, block) with equal radix and parent."""
    now, rows = None, []
    for b in batches:
        for radix, parent, kind, node, block in zip(*(c.to_pylist() for c in b.columns)):
            if (radix, parent) != now:
                if rows:
                    yield now, rows
                now, rows = (radix, parent), []
            rows.append((kind, node, block))
    if rows:
        yield now, rows


_NODE_SCHEMA = "radix int, node long, block binary"


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.binary())], names=["radix", "node", "block"])


def _heads(rows):
    out = []
    for kind, _, block in rows:
        if kind:
            delta, links = unpack(block)
            out.append((np.cumsum(delta), links))
    return out


def _up(batches):
    """Sums of groups of heads."""
    for (radix, parent), rows in _groups(batches):
        keys, total, _ = merge(_heads(rows))
        yield _batch([(radix, parent, pack(np.diff(keys, prepend=0), total))])


def _down(batches):
    """Totals and marks back to every head of a group; at the root they are made, below they come with the group."""
    for (radix, _), rows in _groups(batches):
        keys, total, places = merge(_heads(rows))
        given = [block for kind, _, block in rows if not kind]
        total, best = unpack(given[0]) if given else (total, best_of_side(keys, total))
        for at, (_, node, _) in zip(places, [r for r in rows if r[0]]):
            yield _batch([(radix, node, pack(total[at], best[at]))])


def _sweep(rows: DataFrame, step) -> DataFrame:
    """Rows (radix, parent, kind, node, block), a group of one radix and parent at a time."""
    return rows.select("radix", "parent", "kind", "node", "block").repartition("radix", "parent") \
               .sortWithinPartitions("radix", "parent", "kind", "node").mapInArrow(step, _NODE_SCHEMA)


def pair_totals(heads: DataFrame, n_runs: int, fan_in: int) -> DataFrame:
    """``heads(radix, node, block)`` of runs -> (radix, node, block) with corpus-wide totals and marks per key."""
    levels, n = [], n_runs
    while True:
        n = -(-n // fan_in)
        parent = F.lit(0).cast("long") if n == 1 else F.pmod(F.xxhash64("node"), F.lit(n))
        levels.append(heads.select("radix", parent.alias("parent"), F.lit(1).alias("kind"), "node", "block"))
        if n == 1:
            break
        heads = keep(_sweep(levels[-1], _up), "pair-sums")
    back = keep(_sweep(levels[-1], _down), "pair-totals")
    for level in reversed(levels[:-1]):
        given = back.select("radix", F.col("node").alias("parent"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("node"), "block")
        lower = keep(_sweep(level.unionByName(given), _down), "pair-totals")
        drop(back)
        back = lower
    return back


def _documents(batches):
    """Result rows of each run from its documents, body and totals."""
    names = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
    for b in batches:
        for i in range(b.num_rows):
            docs = b.column(0).slice(i, 1).flatten()
            lens, doc, links = unpack(b.column(1)[i].as_py())
            found = sorted((t for t in b.column(2)[i].as_py() or []), key=lambda t: t["radix"])
            n_best, count_sum = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            if found:
                total, best = (np.concatenate(x) for x in zip(*(unpack(t["block"]) for t in found)))
                np.add.at(count_sum, doc, links * np.repeat(total, lens))
                np.add.at(n_best, doc, links * np.repeat(best, lens))
            f = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), docs.flatten()))
            f |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            yield pa.RecordBatch.from_arrays([f[n] for n in names], names=names)


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, limits: Limits = Limits()) -> DataFrame:
    """Per row of ``docs``: see ``RESULT_SCHEMA``.

    ``a_path`` is a byte-level BPE file, read as space + text; ``b_path`` a piece model that adds the space
    itself; ``pattern`` splits text before the merges of A.  A text that is null or empty, or that a tokenizer
    does not give back byte by byte, has no tokens: zeros and the empty string.  Links of repeated rows count
    once per row.  A null doc_id is returned as null; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    a, b = context.broadcast(load_byte_bpe(a_path)), context.broadcast(load_pieces(b_path))

    def collect(batches):
        pair = Pair(a.value, b.value, pattern)
        rows = ((d, t or "") for x in batches for d, t in zip(x.column(0).to_pylist(), (t.as_py() for t in x.column(1))))
        kinds = [pa.int64(), pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                                                 ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])),
                 pa.binary(), pa.list_(pa.struct([("radix", pa.int32()), ("head", pa.binary())]))]
        for run, done, body, heads in runs(pair, rows, limits, TaskContext.get().partitionId() << 32):
            done = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), d)) for d in done]
            heads = [{"radix": r, "head": h} for r, h in heads]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((run, done, body, heads), kinds)],
                                             names=["run", "docs", "body", "heads"])

    spilled = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                       .mapInArrow(collect, _RUN_SCHEMA), "pair-runs")
    heads = spilled.select("run", F.explode("heads").alias("h")).select(
        F.col("h.radix").alias("radix"), F.col("run").alias("node"), F.col("h.head").alias("block"))
    totals = pair_totals(heads, max(1, spilled.count()), limits.fan_in)
    by_run = totals.groupBy(F.col("node").alias("run")).agg(F.collect_list(F.struct("radix", "block")).alias("totals"))
    return spilled.select("run", "docs", "body").join(by_run, "run", "left").select("docs", "body", "totals") \
                  .mapInArrow(_documents, RESULT_SCHEMA)
