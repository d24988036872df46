"""Collocations against plain counting."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import collocations as C

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, longest):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return n, f


def brute(docs, least, longest=5, percent=100, top=2000):
    n, f = counted(docs, longest)
    out = []
    for lang in f:
        candidates = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        most[p[i:j]] = max(most[p[i:j]], a)
        rows = []
        for p, a in candidates.items():
            if p in most and 100 * most[p] >= percent * a:
                continue
            score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, f[lang][p[:k]], f[lang][p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out, key=lambda r: (r[0], r[1]))


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "a", "É", "é", "中", "x y", "'s", "new", "york", "city", "of"] + [f"w{i}" for i in range(15)]
    fixed = ["new york city of w1 w2 w3", "New  York\tcity", "é 中", "the the the the the the"]
    text = lambda: "".join((rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words)) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n"])
                           for _ in range(rng.randrange(80)))
    docs = [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(n)]
    return docs + [("en", None), ("fr", ""), ("en", docs[0][1]), ("en", docs[0][1]), ("xx", ".,;"), ("en", "w1 w2 " * 40_000), ("en", " ".join(f"rare{i}" for i in range(50)))]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "s") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, prefix string")


def found(df):
    return sorted((tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed, least, percent, top", [(1, 10, 100, 2000), (2, 3, 80, 2000), (3, 5, 100, 7)])
def test_ranks_equal_brute_force(spark, seed, least, percent, top):
    docs = corpus(seed)
    got = found(C.collocations(frame(spark, docs), least, percent=percent, top=top))
    assert got == brute(docs, least, percent=percent, top=top) and len(got) > 15


def test_tiny_slices_pieces_and_filter_change_nothing(spark, monkeypatch):
    docs = corpus(4, 100)
    monkeypatch.setattr(C, "SLICE_BYTES", 50)
    monkeypatch.setattr(C, "PIECES", 3)
    monkeypatch.setattr(C, "HELD", 40)
    df = frame(spark, docs)
    want = brute(docs, 4)
    assert found(C.collocations(df, 4)) == want
    phrases, words = C.stripes(df, 4, bits=3)  # eight counters: a filter that lets all through
    assert {r["lang"]: r["n"] for r in words.collect()} == {k: v for k, v in counted(docs, 1)[0].items() if v}
    assert {(r["lang"], r["phrase"]): r["f"] for r in phrases.collect()} == {
        (lang, " ".join(p)): a for lang, c in counted(docs, 5)[1].items() for p, a in c.items() if a >= 4}


def test_stripes_give_totals_and_extensions(spark):
    docs = corpus(5)
    df = frame(spark, docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    n, f = counted(docs, 3)
    rows = C.count_stripes(df, 3, C.window_filter(df, 20, 3, 16)).collect()
    total = Counter()
    for r in rows:
        if r["size"] == 1:
            total[r["lang"]] += r["f"]
        else:
            assert r["f"] == f[r["lang"]][(*r["prefix"].split(" "), r["next"])]
    assert total == Counter({k: v for k, v in n.items() if v}) and any(r["next"] == "" for r in rows)
    found = {(r["lang"], r["prefix"], r["next"]): r["f"] for r in rows}
    for (lang, prefix, _), a in found.items():  # a prefix's total is an entry one word shorter, and bounds its stripe
        if prefix:
            head, _, last = prefix.rpartition(" ")
            assert found[lang, head, last] == f[lang][tuple(prefix.split(" "))] >= a


def test_filter_lets_every_frequent_window_through_and_few_others(spark):
    docs = corpus(7)
    df = frame(spark, docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    entries = C.count_stripes(df, 5, C.window_filter(df, 20, 5, 16)).filter("next != ''").collect()
    found = {(r["lang"], (f"{r['prefix']} " if r["prefix"] else "") + r["next"]): r["f"] for r in entries}
    want = {(lang, " ".join(p)): a for lang, c in counted(docs, 5)[1].items() for p, a in c.items() if a >= 20}
    assert all(found[k] == a for k, a in want.items())
    assert len(found) < 2 * len(want) < sum(len(c) for c in counted(docs, 5)[1].values()) / 4


def test_counters_stop_at_255_and_add_up_over_tasks(spark):
    df = spark.createDataFrame([("en", "a " * 300)] * 3 + [("en", "b " * 60)] * 2 + [("en", "c")] * 99, "lang string, text string").repartition(8)
    found = C.frequent_buckets(C.counted(df, [1], 15, None), [1], 15, 100)
    t = next(iter(C.slices(C.pa.array(["a b c"]), gaps=C.GAPS)))[2]
    h = C.Windows(t, np.array([C.lang_code("en")], dtype=np.uint64)).hashes(np.arange(3), 1)
    assert C.passes(found[1], h).tolist() == [True, True, False]


def test_products_beyond_64_bits(spark, monkeypatch):
    """a * n * 1000 and l * r beyond 2**63 divide exactly."""
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("en", "x", 1, big, "", "x"), ("en", "y", 1, big + 3, "", "y"), ("en", "x y", 2, big - 1, "x", "y")],
                                    "lang string, phrase string, size int, f long, prefix string, next string")
    words = spark.createDataFrame([("en", 90_000_000_000_007)], "lang string, n long")
    monkeypatch.setattr(C, "stripes", lambda *a, **k: (phrases, words))
    row = C.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert row["score"] == 1000 * (big - 1) * 90_000_000_000_007 // (big * (big + 3))


def test_empty_table(spark):
    assert C.collocations(frame(spark, corpus(1)).limit(0)).count() == 0


def test_no_second_exchange_merges_stripes(spark):
    df = frame(spark, corpus(6)).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    plan = C.count_stripes(df, 1, C.window_filter(df, 5, 1, 16))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
