"""Language identification by word-first backoff.

A word of the model scores by its log frequency in each language.  A word that the model does not
know falls back to character 4-grams, each unknown gram to its two shorter ones, down to single
letters.  The model is counted by Spark on a bounded sample of labelled rows; its size is bounded by
``max_words`` and ``max_grams``, so it can be broadcast.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

UNKNOWN = "und"
ORDER = 4
#: Unseen words whose scores a task remembers; when full it starts anew.
CACHE_WORDS = 100_000
_letters = regex.compile(r"\p{L}+").findall


def held_out(doc_id: str = "doc_id"):
    """Documents kept out of the training: crc32(doc_id as text) mod 5 is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _grams(word: str, n: int) -> list[str]:
    w = f"_{word}_"
    return [w[i:i + n] for i in range(max(1, len(w) - n + 1))]


def _count_tokens(batches):
    """(lang, order, token, n): words have order 0, character grams their length."""
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(_letters(text.lower()))
        rows = Counter()
        for lang, words in counts.items():
            for w, c in words.items():
                rows[lang, 0, w] += c
                for n in range(1, ORDER + 1):
                    for g in _grams(w, n):
                        rows[lang, n, g] += c
        keys = list(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.string()), pa.array([rows[k] for k in keys], pa.int64())],
            names=["lang", "n", "token", "times"])


@dataclass
class Model:
    langs: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]


def fit(docs: DataFrame, sample_per_lang: int = 3000, max_words: int | None = 40_000,
        max_grams: int | None = 60_000) -> Model:
    """Count words and grams on about ``sample_per_lang`` labelled, not held-out rows of each language.

    The sample takes rows by a hash of their id, at a rate set from each language's row count.
    Rows with null text or lang are not used.  The most frequent ``max_words`` and ``max_grams`` stay, so that
    the model can be broadcast at a known size, without words seen once; None keeps every token of the sample.
    """
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")) \
                .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) * F.col("count")
    sample = known.join(F.broadcast(sizes), "lang").where(draw < sample_per_lang * (1 << 20)).select("lang", "text")
    counted = sample.mapInArrow(_count_tokens, "lang string, n int, token string, times long") \
                    .groupBy("n", "token", "lang").agg(F.sum("times").alias("times"))
    per_token = counted.groupBy("n", "token").agg(
        F.sum("times").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "times"))).alias("by"))
    rank = [F.desc("total"), F.asc("n"), F.asc("token")]
    from .common import keep
    per_token = keep(per_token, "langid")
    top = lambda df, most: df if most is None else df.orderBy(*rank).limit(most)
    words = top(per_token.where("n = 0" if max_words is None else "n = 0 and total > 1"), max_words).collect()
    grams = top(per_token.where("n > 0"), max_grams).collect()
    langs = sorted({x for r in grams for x in r["by"]})
    return Model(langs, _logs(words, langs), _logs(grams, langs))


def _logs(rows, langs) -> dict[str, np.ndarray]:
    """Log frequency per language within each order, less the mean over languages."""
    out = {}
    for order in {r["n"] for r in rows}:
        own = [r for r in rows if r["n"] == order]
        c = np.array([[r["by"].get(x, 0) for x in langs] for r in own], float) + 0.5
        logs = np.log(c / c.sum(axis=0))
        out |= {r["token"]: v for r, v in zip(own, logs - logs.mean(axis=1, keepdims=True))}
    return out


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.base = list(model.words)
        self._reset()

    def _reset(self):
        k = len(self.model.langs)
        self.row = {w: i for i, w in enumerate(self.base)}
        self.table = np.zeros((len(self.base) + CACHE_WORDS, k))
        if self.base:
            self.table[:len(self.base)] = np.array([self.model.words[w] for w in self.base])

    def _gram(self, g: str) -> np.ndarray:
        got = self.model.grams.get(g)
        if got is not None:
            return got
        return (self._gram(g[:-1]) + self._gram(g[1:])) / 2 if len(g) > 1 else np.zeros(len(self.model.langs))

    def _unseen(self, word: str) -> np.ndarray:
        grams = _grams(word, ORDER)
        if len(grams) > 200:  # a run of letters far longer than a word: equal parts count once
            total = sum((self._gram(g) * c for g, c in Counter(grams).items()), np.zeros(len(self.model.langs)))
        else:
            total = sum((self._gram(g) for g in grams), np.zeros(len(self.model.langs)))
        return total / ORDER

    def _rows(self, words: list[str]) -> list[int]:
        row, get = self.row, self.row.get
        out = [get(w) for w in words]
        if None in out:
            for i, r in enumerate(out):
                if r is None:
                    w = words[i]
                    if (r := get(w)) is None:
                        r = row[w] = len(row)
                        self.table[r] = self._unseen(w)
                    out[i] = r
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _letters(text.lower()) if text else []
        langs = self.model.langs
        if not words or not langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(langs))
        for i in range(0, len(words), CACHE_WORDS // 4):
            if len(self.row) > len(self.table) - CACHE_WORDS // 4:
                self._reset()
            total += self.table[self._rows(words[i:i + CACHE_WORDS // 4])].sum(axis=0)
        best = int(total.argmax())  # ties: the first by name
        return langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus held_out, lang_pred and score (0 to 1).

    lang_pred is ``und`` with score 0 if the text is null, has no letter, or nothing was learned.
    Repeated rows get equal results; existing columns of these names are replaced.
    """
    names = ("held_out", "lang_pred", "score")
    base = docs.drop(*names)
    with_part = base.withColumn("held_out", held_out())
    schema = StructType([*base.schema.fields, StructField("held_out", BooleanType()),
                         StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = base.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=schema.names)

    return with_part.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least the score ``least``; columns unchanged."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.predict(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
