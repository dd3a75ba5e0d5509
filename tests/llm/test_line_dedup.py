"""Line deduplication against brute force."""
import random

import pytest

from riskframe.llm.line_dedup import dedup_lines

BLANK = " \t\n\r\x0b\x0c"


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1:]


def brute(rows, least):
    big = 1 << 63
    lines = [((big if d is None else d), k, x.strip(BLANK)) for d, t in rows for k, x in enumerate((t or "").split("\n"))]
    out = []
    for d, t in rows:
        kept, own = [], (t or "").split("\n")
        for k, x in enumerate(own):
            me = (big if d is None else d, k)
            s = x.strip(BLANK)
            if len(s) < least or not any((a, b) < me and len(y) >= least and near(s, y) for a, b, y in lines):
                kept.append(x)
        out.append((d, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 8])
def test_lines(make_docs, least):
    rng = random.Random(least)
    say = lambda n: "".join(rng.choice("abé ñ") for _ in range(n))
    pool = [say(rng.randint(0, 30)) for _ in range(60)] + ["aaaaaaaaaaaa", "aaaaaaaaaaa", "abababababab"]

    def edit(x):
        i, c = rng.randrange(len(x) + 1), rng.choice("abé ñ")
        return rng.choice([x[:i] + c + x[i:], x[:i] + x[i + 1:], x[:i] + c + x[i + 1:]])
    rows = [None, "", "\n", "\n\n a \r\n"]
    for _ in range(60):
        own = [rng.choice(pool) for _ in range(rng.randint(1, 6))]
        own = [edit(x) if rng.random() < .4 else x for x in own]
        own = [edit(x) if rng.random() < .2 else "  " + x + "\t" if rng.random() < .1 else x for x in own]
        rows.append("\n".join(own))
    rows = [*enumerate(rows), (10, rows[10]), (None, rows[12]), (None, "x" * 5000)]
    docs = make_docs(rows)
    got = dedup_lines(docs, least)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    have = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert have == brute(rows, least)


def test_no_rows(make_docs):
    assert dedup_lines(make_docs([])).collect() == []


def test_short_lines_are_judged_by_default(make_docs):
    rows = [(1, "Les.\nHome\n\n一章"), (2, "Les.\nShare this\n\n二章"), (3, "Less.\nHome\nOf, edti oner."), (4, "Of, edti oner.")]
    got = dedup_lines(make_docs(rows))
    have = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert have == brute(rows, 1)
    assert [x[3] for x in have] == [0, 2, 2, 1]


def test_rows_without_id_are_documents_of_their_own(make_docs):
    long = "a line that three documents share"
    rows = [(1, long), (None, long + "!\nonly here, in the first"), (None, "wholly unlike the others\nonly there, in a second"),
            (None, "again something else\nequal at one place of two"), (None, "and something new\nequal at one place of two"),
            (7, long + "?\nfirst text of seven"), (7, "7: other text\nits second line, unlike")]
    out = [r.text for r in dedup_lines(make_docs(rows)).collect()]
    lines = sorted(x for t in out for x in t.split("\n") if x)
    assert lines == sorted({x for _, t in rows for x in t.split("\n")} - {long + "!", long + "?"})
