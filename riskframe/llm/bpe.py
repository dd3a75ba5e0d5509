"""Byte-pair encoding and decoding with a contiguous rank array.

Each word holds its parts and the merge rank of every adjacent pair in two arrays; the smallest rank
is found by a scan, its boundary is deleted and the two neighbouring ranks are refreshed.  Words of
more than ``SCAN_PARTS`` parts use a heap over linked parts instead, which gives the same merges
without quadratic time.
"""
from __future__ import annotations

import heapq
import json
import struct
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

SCAN_PARTS = 128
#: Words whose encoding a task remembers; when full it starts anew.
CACHE_WORDS = 150_000
# Fixed value: white space of the tokenizer's regular expressions.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next free code from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs, as plain data that can be broadcast.

    Read on the driver; a vocabulary's size does not grow with the corpus.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return {"vocab": vocab, "merges": merges, "suffix": model.get("end_of_word_suffix") or "",
            "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


def merge(parts: list[int], merges: dict) -> list[int]:
    """Apply merges by rank, leftmost first, until no adjacent pair has one."""
    if len(parts) > SCAN_PARTS:
        return _merge_long(parts, merges)
    none = (_NONE, 0)
    ranks = [merges.get(p, none) for p in zip(parts, parts[1:])]
    while ranks:
        best = min(ranks)
        if best[0] == _NONE:
            break
        i = ranks.index(best)
        parts[i:i + 2] = [best[1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = merges.get((parts[i], parts[i + 1]), none)
        if i:
            ranks[i - 1] = merges.get((parts[i - 1], parts[i]), none)
    return parts


def _merge_long(parts: list[int], merges: dict) -> list[int]:
    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def push(i):
        j = right[i]
        if j >= 0 and (m := merges.get((parts[i], parts[j]))):
            heapq.heappush(heap, (m[0], i, parts[i], parts[j], m[1]))

    for i in range(n):
        push(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = right[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue  # one of the two was merged meanwhile
        parts[i], parts[j] = new, -1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [p for p in parts if p >= 0]


class Codec:
    """Encodes and decodes with one vocabulary; words are cached."""

    def __init__(self, spec: dict):
        vocab, symbols = spec["vocab"], byte_symbols()
        self.merges, self.special = spec["merges"], spec["special"]
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + spec["suffix"]] for s in symbols]
        self.token = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+").findall
        self.cache: dict[str, tuple[bytes, str]] = {}

    def _word(self, word: str) -> tuple[bytes, str]:
        raw = word.encode()
        ids = merge([*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]], self.merges)
        got = struct.pack(f"<{len(ids)}I", *ids), self.text(ids)
        if len(raw) <= 64:  # long words are rare and not worth the memory
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = got
        return got

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower each character by itself: a final sigma is no special case
        text = text.replace("Σ", "σ").lower()
        known, make = self.cache.get, self._word
        return [known(w) or make(w) for w in self.words(text)]

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for piece in self.split.split(text):
            if piece in self.special:
                out.append((struct.pack("<I", self.special[piece]), piece))
            elif piece:
                out += self._plain(piece)
        return out

    def encode(self, text: str) -> list[int]:
        packed = b"".join(p for p, _ in self.parts(text))
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def text(self, ids) -> str:
        """Decoded text; a vocabulary file without a decoder joins its tokens by spaces."""
        return " ".join(self.token[i] for i in ids)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit, packed) and decoded text.

    ``vocabulary`` is the path of a tokenizer file on the driver.  A null text is empty: no ids, empty
    decoded text.  Repeated rows give equal results; other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    schema = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()),
                         StructField("ids", BinaryType()), StructField("decoded", StringType())])

    def run(batches):
        codec = Codec(spec.value)
        for b in batches:
            ids, at = b.column("doc_id"), 0
            packed, decoded, size = [], [], 0
            for n, text in enumerate(b.column("text"), 1):
                parts = codec.parts(text.as_py() or "")
                packed.append(b"".join([p for p, _ in parts]))
                decoded.append(" ".join([t for _, t in parts]))
                size += len(decoded[-1])
                if size > 1 << 22 or n == len(ids):  # small batches out, whatever a batch in holds
                    yield pa.RecordBatch.from_arrays(
                        [ids[at:n], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()),
                         pa.array(decoded, pa.string())], names=schema.names)
                    packed, decoded, size, at = [], [], 0, n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
               .mapInArrow(run, schema)
