"""Ranked search against a plain scoring of every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ridelens.llm import bits
from ridelens.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top):
    counted = [(key, Counter(terms(text))) for key, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    asked: dict = {}
    for key, text in items:
        asked.setdefault(key, set()).update(terms(text))
    out = []
    for key, wanted in asked.items():
        found = []
        for (doc, c), size in zip(counted, sizes):
            if size:
                m = 50 + 50 * size * n // length
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
                found += [(-score, doc is None, doc or 0, doc)] if score > 0 else []
        out += [(key, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def tables(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "a1", "é", "É", "中文", "x-y", "don't", "zz"] + [f"w{i}" for i in range(60)]
    text = lambda size: "".join(rng.choice(words[: rng.choice((4, 70))]) + rng.choice([" ", "\n", ", ", " ", "_"]) for _ in range(size))
    docs = [(i, text(rng.choice((3, 3, 3, 10, 40, 200)))) for i in range(n)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (n, None), (n + 1, ""), (n + 2, " ,.-"), (n + 3, "the " * 30_000)]
    docs += [(n + 10 + i, docs[0][1]) for i in range(80)]  # more ties than places
    items = [(i, text(12)) for i in range(12)] + [(0, "w59 w58"), (None, "the é"), (50, None), (51, "nowhere"), (52, "the the the")]
    return docs, items


def run(spark, docs, items, top):
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, n string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, terms int")
    rows = [tuple(r) for r in R.ranked_search(d, i, top).collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("seed, top", [(1, 50), (2, 5)])
def test_ranks_equal_brute_force(spark, seed, top):
    docs, items = tables(seed)
    assert run(spark, docs, items, top) == brute(docs, items, top)


def test_small_segments_blocks_and_full_filter_change_nothing(spark, monkeypatch):
    docs, items = tables(3)
    monkeypatch.setattr(R, "POSTINGS", 300)
    monkeypatch.setattr(R, "ITEM_TERMS", 20)
    monkeypatch.setattr(R, "FILTER_BITS", 3)
    assert run(spark, docs, items, 10) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = tables(4, 20)
    assert run(spark, [], items, 50) == [] and run(spark, docs, [], 50) == []


def test_visits_stop_at_the_bound():
    """Short documents with the term outrank all long ones: strata of the long ones are not visited."""
    n = np.repeat([1, 100, 1000, 2000, 4000, 8000, 16000], 60)
    one = np.ones(len(n), dtype=np.int64)
    segment = R.Segment(n, one, np.full(len(n), 9, dtype=np.uint64), one, np.array([9], dtype=np.uint64), len(n), int(n.sum()))
    found, score, visited = segment.search(np.array([0]), np.array([1000]), 50)
    assert set(found) == set(range(60)) and len(set(score)) == 1 and visited < segment.n_strata


def test_bit_filter_lets_all_members_through(spark):
    members = [0, 1, -1, 2**63 - 1, -(2**63), 12345, 32767, 32768]
    found = bits.bit_filter(spark.createDataFrame([(m,) for m in members], "h long"), "h", 18)
    assert bits.passes(found, np.array(members, dtype=np.int64).view(np.uint64)).all()
    assert not bits.passes(found, np.arange(2, 1000, dtype=np.uint64)).any()
