import random
import re

import numpy as np
import pytest

from ridelens.llm import jaccard as J


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                if sets[a] == sets[b] or None not in (rows[a][0], rows[b][0]):
                    parent[find(a)] = find(b)
    least = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[find(a)] = min(least.get(find(a), 1 << 60), r[0])
    return sorted(((r[0], len(sets[a]), least.get(find(a)) if sets[a] else r[0]) for a, r in enumerate(rows)), key=str)


def corpus(seed=1, n=260, dense=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Ab", "aB"]
    passage = rng.choices(vocab, k=60)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.2:
                words = words[: max(1, len(words) - rng.randrange(1, 4))]
        else:
            words = rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 8, 12, 20, 40, 90, 200, 300]))
            if rng.random() < 0.3:
                words += passage
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    base = rng.choices(vocab, k=150)
    for i in range(dense):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = rng.choice(vocab)
        rows.append((1000 + i, " ".join(words)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, rows[3][1]), (None, "lone words here"), rows[5], (2003, (rows[5][1] or "").upper()), (2004, "a b"), (2005, "A  B"), (5, "other text of the same id")]


@pytest.mark.parametrize("k,percent,chunk", [(3, 90, 400), (5, 80, 15)])
def test_components_match_brute_force(spark, k, percent, chunk):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = J.jaccard_components(df, k, percent, chunk_docs=chunk).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, percent)


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for n in [1, 2, 3, 5, 8, 9, 10, 11, 17, 18, 19, 20, 33, 60, 130, 400, 1500]:
        for _ in range(60):
            a = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            b = a.copy()
            while True:
                c = b[rng.permutation(len(b))][rng.integers(0, 2) :]
                if rng.random() < 0.6:
                    c = np.append(c, rng.integers(0, 2**63, dtype=np.int64).astype(np.uint64))
                if 100 * len(np.intersect1d(a, c)) < percent * len(np.union1d(a, c)) or rng.random() < 0.01:
                    break
                b = c
            s, d = J.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), percent)
            assert set(s[d == 0].tolist()) & set(s[d == 1].tolist())


def test_t_occurrence_finds_all_and_only_frequent_elements():
    rng = random.Random(4)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 14))]
        need = rng.randrange(1, len(lists) + 1)
        total = lambda d: sum(d in x for x in lists)
        found = {d for d, seen, rest in J.t_occurrence(lists, need) if seen + sum(d in x for x in rest) >= need}
        assert found == {d for d in range(40) if total(d) >= need}


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "A b c d e f g", "y"), (3, "A b c d e f g", "y"), (7, "quite another text that stands alone", "z"), (8, None, "n"), (None, "unnamed text of its own", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([tuple(r) for r in kept.collect()], key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_sketches_estimate_similarity_and_followers_keep_partners():
    rng = np.random.default_rng(5)
    for n in (3, 40, 400, 5000):
        for share in (0.0, 0.3, 0.8, 0.95):
            a = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            b = np.concatenate([a[: int(n * share)], rng.integers(0, 2**63, n - int(n * share), dtype=np.int64).astype(np.uint64)])
            s = J.sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs(J.alike(s[0], s[1:])[0] - true) <= 6 * max(0.01, (true * (1 - true) / 256) ** 0.5) + 0.02
    assert 0.2 < J.least_alike(80) < J.least_alike(90) < 0.6 and J.least_alike(30) == 0


def test_bands_keep_linked_sets_together_and_part_unlike_ones(spark, monkeypatch):
    """A footer on every page: all sets share its signatures; only the linked ones stay together."""
    import random

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(100000)}"
    footer = " ".join(f"footer{i}" for i in range(60))
    texts = [" ".join(word() for _ in range(40)) + " " + footer for _ in range(150)]
    texts += [t.replace(t.split(" ")[5], "changed", 1) for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in J.jaccard_components(docs, k=3, percent=90).collect()}
    monkeypatch.setattr(J, "MOST", 16)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, k=3, percent=90).collect()}
    assert got == want and sum(k != v for k, v in got.items()) == 40
    assert J.band_bins(80) == J.band_bins(90) == 4 and J.band_bins(20) == 1


def test_sketches_of_pairs_at_the_threshold():
    """The estimate that joins a set to its leader, for pairs and for a follower's partner, at many sizes."""
    import numpy as np

    rng = np.random.default_rng(3)
    missed = {80: 0, 90: 0}
    for percent in missed:
        cut, r = J.least_alike(percent), J.band_bins(percent)
        for size in (10, 30, 100, 1000):
            n = 1500
            other = max(1, int(size * (100 - percent) / (100 + percent)))  # shingles that each side has alone
            pool = rng.integers(0, 2**63, (n, size + 2 * other), dtype=np.uint64)
            a, b, c = pool[:, : size], pool[:, other : size + other], pool[:, 2 * other :]  # a links b, b links c
            first = np.arange(n + 1) * size
            x, y, z = (J.sketches(v.ravel(), first) for v in (a, b, c))
            for p, q in ((x, y), (x, z)):
                missed[percent] += sum(J.alike(p[i], q[i : i + 1])[0] < cut for i in range(n))
            bands = lambda v: v.reshape(n, -1, r)
            agree = ((bands(x) == bands(y)).all(axis=2) & (bands(x) > 0).any(axis=2)).any(axis=1)
            missed[percent] += int((~agree).sum())
    assert missed == {80: 0, 90: 0}
