"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages, in natural order.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he in is it not of on or she that the they this to was were "
    "which with you "
    "als an auch auf aus bei das dem den der des die ein eine einer er es für ich im in ist mit nicht sich sie sind "
    "und von war wie zu zum "
    "au aux avec ce ces dans de des du elle en est et il ils la le les mais ne nous ou par pas pour que qui se son "
    "sur un une vous "
    "al con como de del el ella en es esta la las lo los más no o para pero por que se si sin su sus un una y ya"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least`` <= ``part`` / ``whole`` <= ``most``; a zero ``whole`` passes."""
    name: str
    part: str
    whole: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("word length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols per word", "n_symbols", "n_words", most=0.1),
    Rule("stop words per word", "n_stop_words", "n_words", least=0.04),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", most=0.6),
    Rule("closed lines per line", "n_closed_lines", "n_lines", least=0.1),
)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the array ``words`` (64-bit names of windows)."""
    n = F.size(words)
    names = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(
        F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))

    def starts(h):
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(at, lambda s: F.filter(s, lambda x, k: F.coalesce(
            (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
            x["h"] == F.get(s, k - 1)["h"], x["h"] == F.get(s, k + 1)["h"], F.lit(False))))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def count(s):  # a window adds the words up to the next repeated window, three at most
        return F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))),
                           F.lit(0), lambda a, x: a + x)

    some = _let(names, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
                .otherwise(_let(starts(h), count)))
    return F.when(n < 3, F.lit(0)).otherwise(some)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that rules refer to."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    parts = d.select(
        "doc_id", "text",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "").alias("lines"))
    long = lambda c: c.cast("long")
    return parts.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.translate("text", _WHITE, ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(_repeat_words(F.col("words"))).alias("n_repeat_words"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(_WHITE)).rlike(r"[.!?:;\"'»”)]\z")))).alias("n_closed_lines"))


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts of :func:`measures`, base_failed and kept.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows.  kept: not
    base_failed and every rule passes.  A null or empty text has all counts 0 and is base_failed;
    repeated rows give equal results; other columns are ignored.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ok = ~F.col("base_failed")
    for r in rules:
        if r.least is not None:
            ok = ok & (F.col(r.part) >= F.lit(r.least) * F.col(r.whole))
        if r.most is not None:
            ok = ok & (F.col(r.part) <= F.lit(r.most) * F.col(r.whole))
    return measures(docs).withColumn("base_failed", base).withColumn("kept", ok)


def oracle_sql(rules=RULES) -> str:
    """DuckDB twin of the registered query."""
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    tests = [f"{r.part} >= CAST({r.least!r} AS DOUBLE) * {r.whole}" for r in rules if r.least is not None] + \
            [f"{r.part} <= CAST({r.most!r} AS DOUBLE) * {r.whole}" for r in rules if r.most is not None]
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, a || ' ' || b || ' ' || c AS g
  FROM (SELECT doc_id, unnest(ws[1:len(ws) - 2]) AS a, unnest(ws[2:len(ws) - 1]) AS b, unnest(ws[3:len(ws)]) AS c,
          unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda w: lower(w) IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(list_filter(ls, lambda s: regexp_matches(s, '[.!?:;"''»”)][\x20\x09-\x0D]*$'))) AS BIGINT) AS n_closed_lines
  FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {' AND '.join(tests)}) AS kept FROM b"""
