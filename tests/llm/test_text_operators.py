"""Tokens, language, extraction, rules, personal data and decontamination against references."""
import hashlib
import random
from collections import Counter, defaultdict
import re
import struct

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import bpe, decontaminate, html_extract, language_id, pii, quality_rules

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["It's  we'LL don'T", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "ΣΑΣ İstanbul ǅ ß", "á ë́ 가",
       "  x　y\x85z\x1c!", "日本語 한국어 ไทย 🎉👩‍👩‍👧", "a" * 700 + " " + "ab" * 400, "1234 ½ ٣ Ⅷ", "#$%&*!!?? ...", "\x00\x01�"]


def test_bpe_equals_library(make_docs, corpus):
    rows = [*enumerate([*corpus, *ODD]), (6, corpus[6]), (None, None)]
    lib = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), ids, lib.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, list(struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids))), r.decoded)
           for r in bpe.encode(make_docs(rows), PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode(make_docs([]), PATH).collect() == []


def test_bpe_scan_and_heap_agree():
    spec = bpe.load_vocabulary(PATH)
    codec, rng = bpe.Codec(spec), random.Random(3)
    for _ in range(200):
        raw = "".join(rng.choice("aabtheing") for _ in range(rng.randint(2, 90))).encode()
        ids = [*(codec.inner[b] for b in raw[:-1]), codec.last[raw[-1]]]
        assert bpe.merge(list(ids), spec["merges"]) == bpe._merge_long(list(ids), spec["merges"])


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, language_id.fit(docs))
    rows = out.where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_vocabulary_bound_costs_no_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = lambda m: language_id.identify(docs, m).where("held_out and lang = lang_pred").count()
    whole = language_id.fit(docs, max_words=None, max_grams=None)
    small = language_id.fit(docs, max_words=5000, max_grams=5000)
    assert len(whole.words) > 5000 == len(small.words) and abs(right(whole) - right(small)) <= 2


def test_language_edges(make_docs, spark):
    docs = make_docs([(1, None), (2, ""), (3, "12 3 !"), (None, "the of and"), (5, "the of and a in"), (5, "the of and a in"),
                      (7, "x" * 5000)])
    model = language_id.fit(docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert got[1, None] == got[2, ""] == got[3, "12 3 !"] == ("und", 0.0)
    assert got[None, "the of and"][0] == "en"
    left = language_id.accepted(docs, model)
    assert left.columns == docs.columns and left.count() == 4
    none = language_id.fit(make_docs([]))
    assert none.langs == [] and {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_language_backs_off_to_shorter_grams():
    import numpy as np
    v = np.array([1.0, -1.0])
    s = language_id.Scorer(language_id.Model(["a", "b"], {"known": 3 * v}, {"_xy": v, "q": -v}))
    assert s.predict("known") == ("a", pytest.approx(1 / (1 + np.exp(-6))))
    assert s.predict("xyz")[0] == "a" and s.predict("qqq")[0] == "b"


PAGES = [
    ("http://h.example/a", "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav>menu</nav>"
     "<div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>One <b>bo</b>ld&nbsp;x\n y<br>z<p>two<div class=\"comments\">bad"
     "<div>worse</div></div><form>f</form><!-- c --><aside>side</aside> end &lt;p&gt;</article><footer>foot</footer>",
     "Head & more One bold x y z two end <p>"),
    ("http://h.example/b", "<nav>never closed<article>text <i>in</i>line <p title=\"a>b\">more", "text inline more"),
    ("http://h.example/c", "<body><header>h</header><div id=cookie-notice>c</div><p>plain page</p> tail <unfinished", "plain page tail"),
    (None, None, ""), ("::bad[url", "", ""), ("http://h.example/d", "no markup &am", "no markup &am"),
]


def test_html_structure(spark):
    rows = [(i, u, h, "x") for i, (u, h, _) in enumerate(PAGES)] + [(0, *PAGES[0][:2], "x")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text) for r in out) == sorted([*((i, t) for i, (_, _, t) in enumerate(PAGES)), (0, PAGES[0][2])])


@pytest.mark.parametrize("n", [4, 50])
def test_html_host_boilerplate(spark, n):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    top = "<p>welcome to our site please read all the rules we have made for you</p>"
    rng = random.Random(1)
    say = lambda k: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(k))
    rows, want = [], []
    for i in range(30):
        body = f"own{i} " + say(rng.randint(1, 40))
        rows.append((i, f"https://site.example/{i}", f"{top}<div>{body}</div>{top if i % 3 else ''}"))
        want.append((i, body))
    rows.append((99, "https://other.example/", f"{top}<div>alone</div>"))
    want.append((99, "welcome to our site please read all the rules we have made for you alone"))
    try:
        out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((r.page_id, r.text) for r in out) == sorted(want)


def test_html_host_boilerplate_in_marked_articles_and_copies(spark):
    ask = "<p>subscribe now to our weekly letter and never miss a story again</p>"
    say = lambda i: " ".join(f"word{i}x{k}" for k in range(20))
    rows, want = [], []
    for i in range(12):
        body = say(0 if i == 1 else i)  # pages 0 and 1 hold the same article
        rows.append((i, f"https://marked.example/{i}", f"<nav>menu</nav><article><p>{body}</p>{ask}</article>"))
        rows.append((100 + i, f"https://plain.example/{i}", f"<div>{body}</div>{ask}"))
        want += [(i, body), (100 + i, body)]
    for i in range(4):  # the same page under several addresses is no boilerplate
        rows.append((200 + i, f"https://same.example/{i}", f"<main><p>{say(50)}</p></main>"))
        want.append((200 + i, say(50)))
    for n in ("4", "50"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert sorted((r.page_id, r.text) for r in out) == sorted(want)


def brute_main_text(rows, every):
    """Blocks that stay, with runs counted per host in a dictionary."""
    import xxhash
    pages = {}
    for _, url, page in rows:
        marked, found = html_extract.blocks(page)
        runs = []
        for x in found:
            words, own = x.split(" "), []
            for k, w in enumerate(words):
                if k == 0 or xxhash.xxh64_intdigest(w) % every == 0:
                    own.append([])
                own[-1].append(w)
            runs.append([tuple(r) for r in own])
        pages[url, page] = html_extract.host(url), marked, found, runs
    on, size = defaultdict(set), Counter(h for h, *_ in pages.values())
    for key, (h, _, _, runs) in pages.items():
        for r in (r for own in runs for r in own):
            on[h, r].add(key)
    out = []
    for i, url, page in rows:
        h, marked, found, runs = pages[url, page]
        least = max(html_extract.LEAST_PAGES, size[h] * (html_extract.MARKED_SHARE if marked else html_extract.SHARE))
        left = [x for x, own in zip(found, runs) if not all(len(on[h, r]) >= least for r in own)]
        out.append((i, " ".join(left or found)))
    return sorted(out)


@pytest.mark.parametrize("every, partitions", [(8, "4"), (1, "30"), (3, "4")])
def test_html_runs_equal_brute_force(spark, every, partitions):
    rng = random.Random(every)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [say(rng.randint(1, 30)) for _ in range(2)] + ["read more", "a a a a a a a a a a"]
    rows = []
    for i in range(60):
        parts = [say(rng.randint(1, 25)) if rng.random() < .3 else rng.choice(shared) for _ in range(rng.randint(0, 7))]
        if rng.random() < .2 and parts:
            parts.append(rng.choice(shared) + " " + say(3))  # only a part of the block is repeated
        body = "".join(f"<p>{x}</p>" for x in parts)
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<article>{body}</article>" if i % 4 == 0 else f"<div>{body}</div>"))
    rows += [(100, rows[5][1], rows[5][2]), (101, None, None), (102, "http://[bad", "<p>x</p>"), (103, "http://h0.example/long", "<p>" + say(40_000) + "</p>")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = sorted((r.page_id, r.text) for r in html_extract.extract(table, every).collect())
        assert html_extract.extract(table.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_main_text(rows, every)
    plain = {i: " ".join(html_extract.blocks(h)[1]) for i, _, h in rows}
    assert sum(t != plain[i] for i, t in got) > 10


def brute_quality(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [s for s in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    seen, cov = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cov.update(i + k for i in at for k in range(3))
    failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(cov), failed


def test_quality_counts(make_docs, corpus):
    rows = [*enumerate([*corpus, "a b c\na b c\n\n a b c", "x|y <z> " * 30, "w " * 51 + "\x0b"]), (None, None), (6, corpus[6])]
    got = quality_rules.quality(make_docs(rows)).collect()
    have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(have, key=str) == sorted(((d, *brute_quality(t)) for d, t in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality(make_docs([])).collect() == []


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute_pii(x):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x)
                 if all(int(p) <= 255 for p in m[0].split("."))]
    only = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(only(m[0])) <= 15]
    return out


def test_pii_base_spans(make_docs):
    rng = random.Random(5)
    bits = ["a.b@c-d.ef.g", "x@y", "@", "%x@y.z_q@w.v", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "4111  1111 1111 1111", "5500000000000004 ", "é", "日本", "+49 (30) 1234-567", "+1 23", "+", "12-",
            " ", "\n", "word", "..", "-", "1", "22.66.242.238", "tel +33.1.23.45.67.89", "a" * 40, "9" * 30]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "", "-", "."]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts += [None, "", "1 " * 4000, "1" * 20000, "a" * 20000, "+" + "1" * 3000, "a.b@c.d " * 300]
    docs = make_docs([*enumerate(texts), (None, "a@b.cd")])
    for r in pii.find(docs).collect():
        want = brute_pii(r.text)
        assert {k: [(s.s, s.e) for s in r[k]] for k in pii.KINDS} == want, r.text[:200]
        assert all(r[f"more_{k}"] == [] for k in pii.KINDS)


#: Written by hand, not by the rule that makes the examples: (text, span, kind), and texts without personal data.
HIDDEN = [("reach me at {} please", "0049 30 1234567", "phone"), ("tel {} now", "(030) 123 4567", "phone"),
          ("cell {}", "0170/1234567", "phone"), ("fax: {}, room 4", "0044-20-7946-0958", "phone"),
          ("write {} now", "john [at] example [dot] com", "email"), ("{}", "jane(at)mail.org", "email"),
          ("ask {} first", "bob [at] x-corp.co [dot] uk", "email"), ("{} wrote", "margaret.h @ verylongcompany.com", "email"),
          ("the host {} is up", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ip"), ("see {} there", "2001:db8::1", "ip"),
          ("paid with {} today", "4111.1111.1111.1111", "card"), ("{}", "5500/0000/0000/0004", "card"),
          ("amex {} used", "3782 822463 10005", "card")]
HARMLESS = ["on 2024-05-17 we met", "at 12:30:45 it began", "call 12:30", "mac 00:1a:2b:3c:4d:5e ok", "met @ noon. then left",
            "lunch (at) noon. maybe", "1234.5678.9012.3456", "from 1990-2020 and 100 200 300", "12:34:56:78",
            "version 10.20.30 build 12.05.2021", "4111.1111.1111.1112 units", "pages 11-20", "1/2/2003", "in 1984 and 2001"]


def test_pii_trees_add_hidden_spans_and_redact(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(docs)
    assert all(t.trees and t.least >= 0 for t in model.values())
    for r in pii.find(docs, model).collect():  # what is added overlaps no base span
        base = [b for k in pii.KINDS for b in r[k]]
        assert all(x.e <= b.s or b.e <= x.s for k in pii.KINDS for x in r[f"more_{k}"] for b in base)
    texts = [t.format(v) for t, v, _ in HIDDEN] + HARMLESS
    rows = {r.doc_id: r for r in pii.find(make_docs([*enumerate(texts)]), model).collect()}
    added = [(d, k, x.m) for d, r in rows.items() for k in pii.KINDS for x in r[f"more_{k}"]]
    right = [(d, k, v) for d, (_, v, k) in enumerate(HIDDEN)]
    hits = len(set(right) & set(added))
    assert hits >= .75 * len(right) and hits >= .9 * len(added), (set(right) - set(added), set(added) - set(right))
    same = pii.find(make_docs([*enumerate(texts)])).collect()  # base spans do not depend on the trees
    assert all(r[k] == rows[r.doc_id][k] for r in same for k in pii.KINDS)
    assert pii.find(make_docs([]), model).collect() == []
    out = {r.doc_id: r.text for r in pii.redact(make_docs([(1, "mail é a@b.cd now"), (2, None), (3, "1.2.3.4")]), {}).collect()}
    assert out == {1: "mail é [email] now", 2: "", 3: "[ip]"}
    out = pii.redact(make_docs([(1, "see john [at] example [dot] com")]), model).first().text
    assert out == "see [email]"
    assert all(t.trees == [] for t in pii.fit(make_docs([(1, None), (2, "")])).values())


def edit_brute(a, t):
    prev = [0] * (len(t) + 1)
    for i, w in enumerate(a, 1):
        row = [i]
        for j, x in enumerate(t, 1):
            row.append(min(prev[j - 1] + (w != x), prev[j] + 1, row[-1] + 1))
        prev = row
    return min(prev)


def test_decontamination_recall_and_precision(spark, make_docs):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghilé") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(rng.randint(12, 60)) for _ in range(40)]
    rows = [(0, None), (1, ""), (2, "short")]
    for d in range(3, 400):
        w = say(rng.randint(0, 150))
        if d % 2:
            got = list(items[d % 40])
            for _ in range(rng.randint(0, int(.3 * len(got)))):
                k = rng.randrange(len(got))
                got[k:k + 1] = rng.choice([[], [rng.choice(vocab)], [got[k], rng.choice(vocab)]])
            w += got + say(rng.randint(0, 50))
        rows.append((d, " ".join(x.upper() if rng.random() < .1 else x for x in w)))
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(90, None, "x"), (91, "", "x"), (92, "two words", "x")],
                                  "item_id long, text string, doc_id string")
    docs = make_docs([*rows, (3, rows[3][1])])
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(docs, bench).collect()}
    want = {}
    for d, t in rows:
        tw = (t or "").lower().split()
        for i, w in enumerate(items):
            if (e := edit_brute(w, tw)) <= int(.2 * len(w) + 1e-9):
                want[d, i] = e
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert all(k in got for k, e in want.items() if e == 0)
    assert len(got) >= 0.95 * len(want), (len(got), len(want))
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns
    bad = {d for d, _ in got}
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in [*rows, (3, "")] if d not in bad)
    assert decontaminate.leaks(make_docs([]), bench).collect() == [] == decontaminate.leaks(docs, bench.limit(0)).collect()


def test_decontamination_of_short_and_unspaced_items(spark, make_docs):
    items = ["four short plain words", "用户可以在这里找到问题的答案", "six words are one more thing", "สวัสดี", "gone"]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    rows = [(0, "x Four short, plain WORDS y"), (1, "four short plain other words"), (2, "说明：用户可以在这里找到问题的答案。完"),
            (3, "用户不可以那里"), (4, "well six words are one thing"), (5, "กสวัสดีก"), (6, "it is gone"), (7, "bygone"),
            (8, "用户可以在这里找到的答案吗")]
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(make_docs(rows), bench).collect()}
    assert got == {(0, 0, 0), (2, 1, 0), (4, 2, 1), (5, 3, 0), (6, 4, 0), (8, 1, 2)}
    left = decontaminate.without_leaks(make_docs(rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 7]


def test_decontamination_expands_common_runs_in_pieces(spark, make_docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(["same old words again"] * 3 + [f"w{i}"])) for i in range(30)], "item_id long, text string")
    docs = make_docs(["same old words again " * 40, "other " * 30])
    want = sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect())
    assert {d for d, *_ in want} == {0} and len(want) == 30
    monkeypatch.setattr(decontaminate, "SEEDS", 50)
    assert sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect()) == want


def test_cgk_distance_follows_edits():
    import numpy as np
    rng = np.random.default_rng(2)
    a = rng.integers(1, 1 << 60, (1, 40), dtype=np.uint64)
    b = a.copy()
    b[0, 20] = 7
    other = rng.integers(1, 1 << 60, (1, 40), dtype=np.uint64)
    picks, size = np.arange(120)[None, :], np.array([40])
    far = [sum(int((decontaminate.cgk(a, size, picks, s) != decontaminate.cgk(x, size, picks, s)).sum()) for s in range(10))
           for x in (a, b, other)]
    assert far[0] == 0 < far[1] < far[2] / 2


def test_registered_digests(spark):
    from riskframe.llm.queries import QUERIES, ORACLES
    assert set(ORACLES) <= set(QUERIES) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    r = QUERIES["op2_pii"](spark, SF).where("n_email > 0").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    spans = ",".join(f"{k}:{a}:{b}" for k, v in brute_pii(text).items() for a, b in v)
    assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
