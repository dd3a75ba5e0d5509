"""Cross-tokenizer alignment against a brute-force count with the two public libraries."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from riskframe.llm import tokenizer_alignment as T
from riskframe.llm.bpe import byte_symbols

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    import sentencepiece
    import tokenizers
    ta = tokenizers.Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {s: n for n, s in enumerate(byte_symbols())}

    def b_bytes(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    per, pairs = [], Counter()
    for doc_id, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        wa, wb = [bytes(byte[c] for c in ta.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if not text or not b"".join(wa) == b"".join(wb) == (" " + text).encode():
            per.append((doc_id, 0, 0, 0, [], ""))
            continue
        spans_a, spans_b = ([(sum(map(len, w[:i])), sum(map(len, w[:i + 1]))) for i in range(len(w))] for w in (wa, wb))
        links = [(x, y) for x, (s, e) in zip(a, spans_a) for y, (u, v) in zip(b, spans_b) if s < v and u < e]
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            ga, gb = [], []
            while i < len(a) and spans_a[i][1] <= end:
                ga.append(a[i])
                i += 1
            while j < len(b) and spans_b[j][1] <= end:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        pairs.update(links)
        per.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return sorted(((d, na, nb, g, len(ls), sum(pairs[x] == top[x[1]] for x in ls), sum(pairs[x] for x in ls), h)
                   for d, na, nb, g, ls, h in per), key=str)


TEXTS = [None, "", " ", "a", "<s> and <|endoftext|> and <0x41>", "der Hund läuft schnell über die Straße",
         "l'été à la plage", "unmöglichkeiten \n\n  zwei", "日本語 テキスト 😀 mixed", "under▁score", "x" * 1200 + " y", "tab\there",
         "the cat sat on the mat", "the cat sat on the mat", "the the the the the"]


@pytest.mark.parametrize("limits", [T.Limits(), T.Limits(run_links=40, chunk_bytes=200, radix_bits=2, fan_in=3)])
def test_alignment_equals_brute_force(make_docs, corpus, limits):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "a"), (100, corpus[5]), (101, corpus[23]), (102, corpus[24])]
    got = T.alignment(make_docs(rows), A, B, P.PATTERN, limits)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_alignment_without_rows_and_without_tokens(make_docs):
    assert T.alignment(make_docs([]), A, B, P.PATTERN).collect() == []
    got = T.alignment(make_docs([None, ""]), A, B, P.PATTERN).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_rank_merging_equals_the_library():
    pair = T.Pair(T.load_byte_bpe(A), T.load_pieces(B), P.PATTERN)
    assert pair.fast
    for text in TEXTS:
        if text:
            assert pair.a_ids(" " + text) == pair.slow.encode(" " + text, add_special_tokens=False).ids


def test_blocks_and_merge():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        x, y = rng.integers(-5, 1 << 50, n), rng.integers(0, 3, n)
        assert all((u == v).all() for u, v in zip(T.unpack(T.pack(x, y)), (x, y)))
    heads = []
    for _ in range(9):
        keys = np.unique(rng.integers(0, 9000, 6000))
        heads.append((keys, rng.integers(1, 9, len(keys))))
    keys, total, places = T.merge(heads)
    want = Counter()
    for k, n in heads:
        want.update(dict(zip(k.tolist(), n.tolist())))
    assert dict(zip(keys.tolist(), total.tolist())) == want
    assert all((keys[p] == k).all() for p, (k, _) in zip(places, heads))
