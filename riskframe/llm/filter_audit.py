"""Filter interaction audit with decision diagrams of failure masks.

Every document gets one bit per filter it fails.  The documents of a part are counted per mask, and the
counts of a part (at most 2**filters masks) become a decision diagram: a level per filter, a pass and a
fail child per node, equal sub-diagrams shared, the counts at the leaves and each node's weight the sum
below it.  Filter orders are visited by adjacent swaps, each of which exchanges two neighbouring levels of
the diagram; the steps of an order are read off its all-pass path.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

_WHITE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
STEP_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
               "good_lost long, toxic_lost long, shapley long")


class Diagram:
    """Count-weighted decision diagram; ``order[i]`` is the filter tested at level i.

    A node is known by (pass child, fail child) on its level, a leaf by its counts; both are numbered in
    one table per level, so equal ones are the same node.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int, width: int = 3):
        self.order = list(range(filters))
        none = (0,) * width
        self.weights: list[list[tuple[int, ...]]] = [[] for _ in range(filters + 1)]
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in range(filters)]
        self._known: list[dict] = [{} for _ in range(filters + 1)]

        def build(level: int, mask: int) -> int:
            if level == filters:
                return self._leaf(counts.get(mask, none))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _leaf(self, counts: tuple[int, ...]) -> int:
        at = self._known[-1].setdefault(counts, len(self.weights[-1]))
        if at == len(self.weights[-1]):
            self.weights[-1].append(counts)
        return at

    def _node(self, level: int, low: int, high: int) -> int:
        at = self._known[level].setdefault((low, high), len(self.nodes[level]))
        if at == len(self.nodes[level]):
            below = self.weights[level + 1]
            self.nodes[level].append((low, high))
            self.weights[level].append(tuple(a + b for a, b in zip(below[low], below[high])))
        return at

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and ``level + 1``; other levels and all functions stay."""
        upper, lower = self.nodes[level], self.nodes[level + 1]
        for t in (self._known, self.nodes, self.weights):
            t[level + 1] = type(t[level + 1])()
        self._known[level] = {}
        made = []
        for low, high in upper:
            (ll, lh), (hl, hh) = lower[low], lower[high]
            made.append((self._node(level + 1, ll, hl), self._node(level + 1, lh, hh)))
        # the two functions of a pair differ, so nodes of the upper level stay distinct and keep their numbers
        self.nodes[level] = made
        self._known[level] = {pair: i for i, pair in enumerate(made)}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) along the all-pass path."""
        at = self.root
        for level, f in enumerate(self.order):
            low, high = self.nodes[level][at]
            yield f, self.weights[level + 1][low], self.weights[level + 1][high]
            at = low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions i whose swaps (i, i + 1) lead through all orders of n things, each once (plain changes)."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the last thing now stands in front, or at the end
        down = not down


def order_table(counts: dict[int, tuple[int, int, int]], names: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.

    ``counts`` has (documents, good, toxic) per failure mask; bit i of a mask is filter ``names[i]``.
    """
    d = Diagram(counts, len(names))
    paths = [(tuple(d.order), list(d.steps()))]
    for i in adjacent_swaps(len(names)):
        d.swap(i)
        paths.append((tuple(d.order), list(d.steps())))
    fails, alone, shapley = {}, {}, dict.fromkeys(range(len(names)), 0)
    for _, steps in paths:
        fails[steps[0][0]] = steps[0][2][0]  # nothing was removed before the first step
        alone[steps[-1][0]] = steps[-1][2][0]  # the last step removes what only it would
        for f, _, gone in steps:
            shapley[f] += gone[0]
    out = []
    for order, steps in paths:
        label = "".join(names[f] for f in order)
        for k, (f, left, gone) in enumerate(steps, 1):
            out.append((label, k, left[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], shapley[f]))
    return out


def _failed(text: Column) -> list[Column]:
    """Filters A to D on ``text`` with its words in column ``words``."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return [n < 200, 100 * distinct.cast("long") < 50 * n,
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: part, mask (bits A to E), good and toxic (0 or 1).

    A: under 200 words; B: under half of the words are distinct; C: over 2 % of the code points are A-Z;
    D: holds one of ``#$%&*|``; E: identical to the text of a smaller doc_id (by SHA-256 of the text).
    Null texts are empty and null parts the empty string.  A null doc_id is neither smaller nor larger
    than any and has no label; of several label rows of a document the greatest values count.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                      F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    split = own.select("doc_id", "part", "text", F.array_remove(F.split("text", _WHITE), "").alias("words"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(_failed(F.col("text")))), F.lit(0))
    rows = keep(split.select("doc_id", "part", bits.cast("int").alias("mask"),
                             F.unhex(F.sha2("text", 256)).alias("name")), "audit-rows")
    first = rows.groupBy("name").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "name", "left").join(marks, "doc_id", "left").select(
        "part", (F.col("mask") + F.when(late, 1 << 4).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit(failed: DataFrame, names: str = FILTERS) -> DataFrame:
    """Steps of every filter order per part of ``failed(part, mask, good, toxic)``: see ``STEP_SCHEMA``.

    removed: documents that fail this filter and passed all earlier ones; redundant: fail it and were removed
    earlier; unique_fails: fail it alone; good_lost, toxic_lost: removed here with that mark; shapley: removed
    by the filter, summed over all orders.  One row per part, order (len(names) factorial) and step, zeros
    included; no rows for an empty table.  Only counts per part and mask are shuffled.
    """
    counts = failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"),
                                                F.sum("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches):
        for b in batches:
            for part, masks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = order_table({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}, names)
                cols = list(zip(*rows))
                kinds = [pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    names=[f.split()[0] for f in STEP_SCHEMA.split(", ")])

    return parts.mapInArrow(run, STEP_SCHEMA)


def oracle_sql() -> str:
    """DuckDB twin of the registered query."""
    return r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (
  SELECT doc_id, part,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END) AS mask FROM t),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM m LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
  GROUP BY part, mask),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS fs FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT fs, k AS step, fs[k] AS cur, CAST(1 << fs[k] AS INTEGER) AS bit,
    CAST(coalesce(list_sum(list_transform(fs[1:k - 1], lambda y: 1 << y)), 0) AS INTEGER) AS before,
    array_to_string(list_transform(fs, lambda y: substr('ABCDE', y + 1, 1)), '') AS filter_order
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (
  SELECT part, filter_order, step, cur,
    sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, cur)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, cur) AS BIGINT) AS shapley
FROM r"""
