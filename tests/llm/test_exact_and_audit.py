"""Exact deduplication and the filter audit against brute force and their SQL."""
import itertools
import re
import uuid
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from riskframe.llm import exact_dedup, filter_audit
from riskframe.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def index_of(spark, docs, **more):
    path = scratch_path(spark, f"docs-{uuid.uuid4().hex}")
    docs.write.parquet(path)
    return exact_dedup.Index(spark, path, scratch_path(spark, f"index-{uuid.uuid4().hex}"), **more)


def check_groups(rows, got):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lowered(t)].append(d)
    want = sorted((str(d), str(max((x for x in groups[lowered(t)] if x is not None), default=None)), len(groups[lowered(t)]))
                  for d, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


ROWS = [(0, None), (1, ""), (2, "Same Text"), (3, "same text"), (4, "SAME TEXT "), (5, "École"), (6, "école"), (7, "ÉCOLE"),
        (None, "same text"), (None, "alone"), (9, "same text"), (9, "same text"), (10, "z" * 50_000), (11, "Z" * 50_000)]


@pytest.mark.parametrize("key", [lambda d: d, lambda d: F.substring(d, 1, 0), lambda d: F.substring(F.hex(d), 1, 1)])
def test_exact_groups(spark, make_docs, corpus, key):
    """Also with keys under which all or many texts clash: whole texts decide."""
    rows = ROWS + [(100 + i, t) for i, t in enumerate(corpus)]
    index = index_of(spark, make_docs(rows), key=key)
    index.update()
    got = index.result()
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "digest", "keep_file", "keep_row"]
    check_groups(rows, got.collect())


def test_exact_index_takes_in_new_files_only(spark, make_docs):
    index = index_of(spark, make_docs(ROWS).repartition(3))
    index.update(max_files=1)
    check_groups(ROWS, index.result().collect())
    make_docs([(20, "SAME text"), (21, "new")]).write.mode("append").parquet(index.path)
    index.update()
    index.update()  # nothing new
    check_groups([*ROWS, (20, "SAME text"), (21, "new")], index.result().collect())
    assert index.arrivals().count() == len(ROWS) + 2


def test_exact_without_rows(spark, make_docs):
    index = index_of(spark, make_docs([]))
    index.update()
    assert index.result().collect() == []


def test_hits_are_a_small_part_of_the_texts(spark, make_docs):
    """The bitmap lets hits through and, of other rows, hardly any."""
    rows = [(i, f"text {i % 990}") for i in range(1000)]
    index = index_of(spark, make_docs(rows))
    index.update()
    hits = index.arrivals().join(index.groups(), "key").where("n > 1")
    assert index._texts(hits).count() == hits.count() == 20


def brute_audit(docs, labels):
    """Steps by applying the filters one after the other."""
    good, toxic = defaultdict(int), defaultdict(int)
    for d, q, t in labels:
        if d is not None:
            good[d], toxic[d] = max(good[d], q or 0), max(toxic[d], t or 0)
    fails = []
    for d, text, _ in docs:
        x = text or ""
        w = WORD.findall(x)
        f = set()
        if len(w) < 200:
            f.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in x) > 2 * len(x):
            f.add("C")
        if set(x) & set("#$%&*|"):
            f.add("D")
        if d is not None and any(e is not None and e < d and (u or "") == x for e, u, _ in docs):
            f.add("E")
        fails.append(f)
    out, shapley = [], defaultdict(int)
    for part in {p or "" for *_, p in docs}:
        mine = [(d, f) for (d, _, p), f in zip(docs, fails) if (p or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order, 1):
                gone = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                shapley[part, c] += len(gone)
                out.append((part, "".join(order), k, len(left), len(gone), sum(c in f for _, f in mine) - len(gone),
                            sum(f == {c} for _, f in mine), sum(good[d] for d, _ in gone), sum(toxic[d] for d, _ in gone), c))
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


@pytest.fixture(scope="module")
def audit_rows():
    long = " ".join(f"w{i}" for i in range(210))
    docs = [(0, None, None), (1, "", ""), (2, long, "a"), (3, long, "b"), (4, long + " #", "a"), (5, "x " * 300, "a"),
            (6, "X " * 300, "a"), (7, "X " * 300, "b"), (None, long, "a"), (9, "ABC", "a"), (9, "ABC", "a"), (8, "ABC", None),
            (11, long.upper() + " $", "c"), (12, "é" * 50 + "A", "c"), (13, "é" * 49 + "A", "c"), (14, "a\x1cb " * 250, "c")]
    labels = [(2, 1, 0), (3, 1, 1), (3, 0, 0), (5, 0, 1), (9, 1, None), (None, 1, 1), (77, 1, 1), (13, None, 1)]
    return docs, labels


def test_audit_equals_brute_force_and_sql(spark, audit_rows):
    docs, labels = audit_rows
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, mask int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.failures(table, marks))
    want = brute_audit(docs, labels)
    assert sorted(tuple(r) for r in got.collect()) == want
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "source").toArrow())
    con.register("labels", marks.toArrow())
    assert sorted(con.sql(filter_audit.oracle_sql()).fetchall()) == want


def test_audit_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(docs, marks)).collect() == []


def test_diagram_orders_and_sharing():
    for n in range(1, 6):
        order = list(range(n))
        seen = [tuple(order)]
        for i in filter_audit.adjacent_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))
    d = filter_audit.Diagram({0: (5, 1, 0), 1: (2, 0, 1)}, 3)
    assert [len(x) for x in d.nodes] == [1, 2, 3]  # equal halves are shared
    for i in filter_audit.adjacent_swaps(3):
        d.swap(i)
        assert d.weights[0][d.root] == (7, 1, 1)
