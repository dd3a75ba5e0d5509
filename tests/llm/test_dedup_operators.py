"""Deduplication operators against brute force."""
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from riskframe.llm.simhash import gray_links, near_duplicates, one_of_each_group
from riskframe.llm.substring_dedup import remove_repeated_passages
from riskframe.llm.suffix_dedup import remove_repeated_strings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_simhash(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, bits=2):
    fps = [brute_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, (d, f) in enumerate(zip([r[0] for r in rows], fps))),
                  key=str)


@pytest.mark.parametrize("node_rows", [4096])
def test_simhash_groups(make_docs, corpus, node_rows):
    rows = [*enumerate(corpus), (3, corpus[3]), (None, corpus[6]), (None, "lonely null id text")]
    got = near_duplicates(make_docs(rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_groups(rows)


def test_gray_index_finds_every_pair_and_splits_large_nodes(spark, monkeypatch):
    from riskframe.llm import simhash
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre[:6].tolist():
        for _ in range(120):
            x = c
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2}
    x, y = gray_links(np.zeros(len(fps), np.int64), fps, 2)
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} == want and len(x) == len(want)

    def parts(pairs):
        root = {}

        def find(i):
            while root.setdefault(i, i) != i:
                i = root[i]
            return i
        for a, b in pairs:
            root[find(a)] = find(b)
        groups = defaultdict(set)
        for i in list(root):
            groups[find(i)].add(i)
        return sorted(map(sorted, groups.values()))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    signed = fps.view(np.int64).tolist()
    for node_rows in (4096, 8):
        links = simhash.hamming_links(df, 2, node_rows).collect()
        assert parts([tuple(r) for r in links]) == parts([(signed[i], signed[j]) for i, j in want])


def test_one_of_each_group_keeps_columns_and_one_row(make_docs, corpus):
    rows = [*enumerate(corpus), (6, corpus[6])]
    docs = make_docs(rows)
    out = one_of_each_group(docs)
    assert out.columns == docs.columns
    keep = sorted({c for _, _, c in brute_groups(rows)})
    assert sorted(r.doc_id for r in out.collect()) == keep


def test_one_of_each_group_judges_rows_without_or_with_equal_ids(make_docs):
    say = lambda k: " ".join(f"{w}{k}" for w in ("alpha", "bravo", "charlie", "delta", "echo", "golf"))
    rows = [(1, say(1)), (None, say(1)),                                # a copy of an id goes, alone
            (None, say(2)), (None, say(3)), (None, say(3) + " "), (None, say(3)),  # one of each group without id
            (5, say(1)), (5, say(4)), (5, say(5)), (6, say(5)),         # a repeated id in three groups
            (8, say(6)), (8, say(6))]
    got = sorted(((r.doc_id, r.text.strip()) for r in one_of_each_group(make_docs(rows)).collect()), key=str)
    assert got == sorted([(1, say(1)), (None, say(2)), (None, say(3)), (5, say(4)), (5, say(5)), (8, say(6))], key=str)


def test_one_of_each_group_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, 8, "x", 1), (2, "a b c d", 9, 1, "y", 2)],
                                 "doc_id long, text string, _did int, _th int, row string, did int")
    assert [tuple(r) for r in one_of_each_group(docs).collect()] == [(1, "a b c d", 7, 8, "x", 1)]


def brute_passages(rows, W=50):
    first = {}
    ws = [(d, WORD.findall(t or "")) for d, t in rows]
    big = 1 << 63
    for d, w in ws:
        for i in range(len(w) - W + 1):
            k = tuple(w[i:i + W])
            first[k] = min(first.get(k, big), big if d is None else d)
    out = []
    for d, w in ws:
        gone = set()
        for i in range(len(w) - W + 1):
            if first[tuple(w[i:i + W])] < (big if d is None else d):
                gone.update(range(i, i + W))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_repeated_passages(make_docs, corpus):
    rows = [*enumerate(corpus), (8, corpus[8]), (None, corpus[11]), (None, None)]
    got = remove_repeated_passages(make_docs(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_passages(rows)


def test_passages_of_rows_without_id(make_docs):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 400, n))
    common, numbered, cut = say(90), say(70), say(120)
    rows = [(4, say(30) + " " + numbered + " " + say(20)), (9, cut[:len(cut) // 2] + " " + say(60))]
    rows += [(None, " ".join([say(int(rng.integers(1, 80))), common, say(7), cut, say(int(rng.integers(1, 60)))])) for _ in range(12)]
    rows += [(None, say(10) + " " + numbered), (None, common[20:]), (None, rows[5][1]), (None, rows[5][1]), (None, "")]
    rows += [(None, " ".join(["again"] * 130)), (None, None)]
    got = sorted((tuple(r) for r in remove_repeated_passages(make_docs(rows)).collect()), key=str)
    assert got == brute_passages(rows) and sum(r[2] for r in got) > 500


def brute_strings(rows, L=200):
    count = Counter()
    bs = [(d, (t or "").encode()) for d, t in rows]
    for _, b in bs:
        count.update(b[i:i + L] for i in range(len(b) - L + 1))
    out = []
    for d, b in bs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - L + 1):
            if count[b[i:i + L]] > 1:
                gone[i:i + L] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        kept = bytes(c for i, c in enumerate(b) if not gone[i])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [4, 60])
def test_repeated_strings(spark, make_docs, corpus, buckets):
    rows = [*enumerate(corpus), (8, corpus[8]), (None, corpus[11]), (None, None), (5, "different text, same id")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        got = remove_repeated_strings(make_docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                   for r in got), key=str)
    assert have == brute_strings(rows)


def test_empty_tables(make_docs):
    for f in (near_duplicates, one_of_each_group, remove_repeated_passages, remove_repeated_strings):
        assert f(make_docs([])).collect() == []
