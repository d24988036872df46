import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridelens.llm import repetition as R


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup_lines += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            inside.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup_lines, len(inside))


def share(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, inside = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            inside.update(range(i, i + n))
        seen.add(g)
    return sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))


rng = random.Random(5)
TEXTS = [None, "", " ", "\n\n", "a", "a\na\na b\n", "é ü\né ü", " x\n x\nx", "    ß", "ab " * 5000]
TEXTS += [rng.choice([" ", "\n"]).join(rng.choice("a b c dd é #x".split()) for _ in range(rng.randrange(60))) for _ in range(150)]


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[20], "s"), (None, "b c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    return rows, R.repetition_coverage(df).collect()


def test_base_counts_match_brute_force(result):
    rows, out = result
    assert sorted((-1 if r.doc_id is None else r.doc_id, *[r[c] for c in R.COUNTS]) for r in out) == sorted((i if i is not None else -1, *brute(t)) for i, t, _ in rows)


def test_gram_shares_and_verdict(result):
    rows, out = result
    by_id = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id != 3}
    for i, t, _ in rows[4:-2]:
        r = by_id[i]
        for n in R.GRAM_SHARES:
            assert r[f"dup_{n}gram_share"] == pytest.approx(share(t, n))
        n, _, _, _, rep = brute(t)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert r.kept == (not r.base_failed and r.dup_line_share <= R.LINE_SHARE and all(share(t, k) <= m for k, m in R.GRAM_SHARES.items()))


def test_empty_table_and_rows_kept_whole(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.repetition_coverage(df).count() == 0
    clean = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, clean, "x"), (2, "a " * 99, "y"), (1, clean, "x")], "doc_id long, text string, n_words string")
    kept = R.keep_clean(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, clean, "x")] * 2


def test_slices_do_not_change_results(monkeypatch):
    import pyarrow as pa

    whole = R._batch(pa.array(TEXTS))
    monkeypatch.setattr(R.X, "slices", lambda c, lower=False, f=R.X.slices: f(c, lower, 64))
    parts = R._batch(pa.array(TEXTS))
    assert all(whole[c].to_pylist() == pytest.approx(parts[c].to_pylist()) for c in R.COUNTS + R.SHARES)


def test_other_window_lengths(spark):
    """Any lengths: the shares they name, and the verdict by them."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = R.repetition_coverage(df, gram_shares={3: 0.2, 12: 0.05}).collect()
    assert {c for c in rows[0].asDict() if "gram" in c} == {"dup_3gram_share", "dup_12gram_share"}
    for r in rows:
        assert r.dup_3gram_share == pytest.approx(share(TEXTS[r.doc_id], 3)) and r.dup_12gram_share == pytest.approx(share(TEXTS[r.doc_id], 12))
        assert r.kept == (not r.base_failed and r.dup_line_share <= R.LINE_SHARE and r.dup_3gram_share <= 0.2 and r.dup_12gram_share <= 0.05)
