import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, did string, fp string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with those the operators use inside."""
    def make(rows):
        rows = [(r if isinstance(r, tuple) else (i, r)) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empties, copies, near copies, shared passages, periodic and long texts."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, other = say(70), say(55)
    base = say(180)
    texts = [None, "", " \n\t", "one", "A b", say(30), base, base, base + " " + say(5), passage, passage[1:],
             say(60) + "\n" + passage + "  " + say(60), say(20) + " " + other + " " + say(25),
             other + "\x0b" + passage, "ab " * 200, "ab " * 120 + "cd", "z" * 900, "é" * 300, say(3000)]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(25):
        texts.append(say(rng.randint(1, 120)) + (" " + passage if rng.random() < .3 else "") + "\n" + say(40))
    texts.append(base)
    return texts
