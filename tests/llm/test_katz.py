import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ridelens.llm import katz as K


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def count_discounts(counts):
    n = Counter(counts)
    k = K.CUTOFF
    plain = {r: (r - 0.5) / r for r in range(1, k + 1)}
    if any(not n[r] for r in range(1, k + 2)):
        return plain
    tail = (k + 1) * n[k + 1] / n[1]
    if tail >= 1:
        return plain
    d = {r: ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in plain}
    return d if all(0 < x < 1 for x in d.values()) else plain


class Brute:
    """The same model, token by token from dictionaries."""

    def __init__(self, rows):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for i, t in rows:
            if not held(i):
                ws = tokens(t)
                self.uni.update(ws)
                for h, w in zip(["<s>", *ws], ws):
                    self.bi[h][w] += 1
        self.n = sum(self.uni.values())
        self.du = count_discounts(self.uni.values())
        self.db = count_discounts([r for c in self.bi.values() for r in c.values()])
        self.div = self.n + all(c > K.CUTOFF for c in self.uni.values())
        self.unk = 1 - sum(self.du.get(c, 1) * c for c in self.uni.values()) / max(self.div, 1)

    def p(self, w, h=()):
        if h == ():
            c = self.uni[w]
            return self.du.get(c, 1) * c / self.div if c else self.unk
        seen = self.bi.get(h)
        if not seen:
            return self.p(w)
        div = sum(seen.values()) + all(r > K.CUTOFF for r in seen.values())
        if seen.get(w):
            return self.db.get(seen[w], 1) * seen[w] / div
        left = 1 - sum(self.db.get(r, 1) * r for r in seen.values()) / div
        return left / (1 - sum(self.p(x) for x in seen)) * self.p(w)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)] + ["É", "Ab"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "\n \t"), (None, "v1 v2 v2"), (903, "the same " * 400), (904, "same the same new" + chr(0x1F600)), rows[4], rows[4], (905, "AB ab É é")]


def test_scores_match_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int")
    got = K.katz_scores(df, batch_bytes=4000, parts=5).collect()
    m = Brute(rows)
    v = len(m.uni)
    want = []
    for i, t in rows:
        ws = tokens(t)
        want.append((str(i), held(i), len(ws), sum(m.uni[w] > 0 for w in ws), m.n, sum(math.log10((m.uni[w] + 1) / (m.n + v + 1)) for w in ws),
                     sum(math.log10(m.p(w, h)) for h, w in zip(["<s>", *ws], ws))))
    have = sorted((str(r.doc_id), *tuple(r)[1:]) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_every_history_sums_to_one():
    m = Brute(corpus(2))
    for h in ["<s>", "v1", "v7", "v250", "same", "never seen"]:
        assert sum(m.p(w, h) for w in [*m.uni, "never seen"]) == pytest.approx(1)


def test_discounts_and_classes():
    assert K.discounts(np.array([0, 900, 300, 150, 90, 60, 40])) == pytest.approx([0, *count_discounts([r for r, n in enumerate([0, 900, 300, 150, 90, 60, 40]) for _ in range(n)]).values()])
    c = K.by_class(np.array([1, 1, 5, 6, 9, 0]), np.array([0, 0, 0, 0, 1, 1]), 2)
    assert c.tolist() == [[2, 0, 0, 0, 1, 1, 6], [0, 0, 0, 0, 0, 0, 9]] and K.occurrences(c).tolist() == [13, 9] and K.bare(c).tolist() == [0, 1]


def test_empty_table_and_no_training_rows(spark):
    schema = "doc_id long, text string"
    assert K.katz_scores(spark.createDataFrame([], schema)).count() == 0
    i = next(i for i in range(100) if held(i))
    r = K.katz_scores(spark.createDataFrame([(i, "a b")], schema)).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_written_tables_hold_the_counts(spark, tmp_path):
    rows = corpus(3, 120)
    K.write_tables(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "m"), batch_bytes=3000, parts=4)
    m = Brute(rows)
    words, pairs = (spark.read.parquet(str(tmp_path / "m" / t)) for t in ("words", "pairs"))
    assert sorted(r["count"] for r in words.collect()) == sorted(m.uni.values())
    assert sorted(r["count"] for r in pairs.collect()) == sorted(r for c in m.bi.values() for r in c.values())
    by_history = {r.history: r.n for r in pairs.groupBy("history").sum("count").withColumnRenamed("sum(count)", "n").collect()}
    assert sorted(by_history.values()) == sorted(sum(c.values()) for c in m.bi.values())
    assert words.filter("(number - 1) % 4 != shard").count() == 0


@pytest.mark.parametrize("n", [[0, 49663, 12919, 5197, 2729, 2383, 1067], [0, 193655, 25105, 6496, 2179, 2497, 618],
                               [0, 1579638, 246704, 51653, 21705, 18939, 7580], [0, 900, 300, 0, 90, 60, 40]])
def test_copies_do_not_switch_good_turing_off(n):
    """Counts of counts of the given tables, where copies raise n[5], and one with a gap: fitted, not half an occurrence."""
    d = K.discounts(np.array(n))[1:]
    b = K.slope(np.array(n))
    r = np.arange(1, 6)
    smooth = r ** b  # n[r] up to a factor
    last = 6 * 6 ** b
    assert d == pytest.approx(((r + 1) * (r + 1) ** b / smooth / r - last) / (1 - last))
    assert (np.diff(d) > 0).all() and 0 < d[0] < 0.5 and d[-1] < 1


def test_slope_of_exact_power_law():
    assert K.slope(np.array([0, *[7200 / r ** 2 for r in range(1, 7)]])) == pytest.approx(-2)
    assert K.slope(np.array([0, 5, 0, 0, 0, 0, 0])) is None


def test_rising_counts_of_counts_fall_back():
    assert K.discounts(np.array([0, 5, 4, 4, 11, 10, 27]))[1:] == pytest.approx([0.5, 0.75, 5 / 6, 0.875, 0.9])
