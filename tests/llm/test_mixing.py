import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from ridelens.llm import mixing as M


def share(budget, kids, weight):
    """Water-filling by rounds: full children leave and the others share again."""
    got, open_ = {}, {k: c for k, c in kids.items() if weight(k) > 0 and c > 0}
    while open_:
        total = sum(weight(k) for k in open_)
        left = budget - sum(got.values())
        full = [k for k, c in open_.items() if Fraction(left * weight(k), total) >= c]
        if not full:
            return got | {k: left * weight(k) // total for k in open_}
        for k in full:
            got[k] = open_.pop(k)
    return got


def brute(rows, percent, epochs, seed, weights):
    tokens = Counter()
    docs = []
    for i, text, lang, source in rows:
        domain = "dom_" + hashlib.md5((source or "").encode()).hexdigest()[0]
        path = (domain, lang or "(null)", source or "(null)")
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        docs.append((i, path, n))
        tokens[path] += n
    cap = defaultdict(int)
    for path, t in tokens.items():
        for d in range(4):
            cap[path[:d]] += t * epochs
    budget = {(): min(sum(tokens.values()) * percent // 100, cap[()])}
    for d, level in enumerate(M.LEVELS):
        for parent in [p for p in budget if len(p) == d]:
            kids = {p: c for p, c in cap.items() if len(p) == d + 1 and p[:d] == parent}
            budget |= share(budget[parent], kids, lambda p, level=level: weights[level].get(p[-1], 1))
    out = []
    for path, t in tokens.items():
        full, rest = divmod(budget.get(path, 0), t) if t else (0, -1)
        mine = [(i, n) for i, p, n in docs if p == path]
        out += [(str(i), path, n, e) for i, n in mine for e in range(full)]
        order = sorted(mine, key=lambda x: hashlib.md5(f"{seed}:{full}:{'null' if x[0] is None else x[0]}".encode()).hexdigest())
        at = 0
        for i, n in order:
            at += n
            if at > rest:
                break
            out.append((str(i), path, n, full))
    return sorted(out)


def rows(seed, n=600):
    rng = random.Random(seed)
    out = [(i, " ".join("w" * rng.randrange(0, 40)) or None, rng.choice(["en"] * 6 + ["de", "fr", None]), rng.choice(["src0"] * 5 + ["src1", "src2", "src9", None])) for i in range(n)]
    return out + [(None, "a b", "es", "lonely"), (7000, "", "es", "blank"), (7001, "x " * 3000, "en", "src1")]


@pytest.mark.parametrize("percent,epochs", [(60, 2), (150, 2), (100, 1), (500, 3), (0, 1)])
def test_chosen_rows_match_brute_force(spark, percent, epochs):
    data = rows(percent)
    df = spark.createDataFrame([(*r, 5) for r in data], "doc_id long, text string, lang string, source string, epoch int")
    got = M.mix_sources(df, percent=percent, max_epochs=epochs).collect()
    assert sorted((str(r.doc_id), (r.domain, r.lang, r.source), r.n_tokens, r.epoch) for r in got) == brute(data, percent, epochs, M.SEED, M.WEIGHTS)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    """A short leaf's missing tokens go to its sibling, not to another domain."""
    docs = [(i, "t " * 10, "en", s, d) for i, (s, d) in enumerate([("a", "x")] * 1 + [("b", "x")] * 30 + [("c", "y")] * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, domain string")
    got = Counter()
    for r in M.mix_sources(df, weights={}, percent=50, max_epochs=1).collect():
        got[r.source] += r.n_tokens
    assert got == {"a": 10, "b": 140, "c": 150}  # 305: 152 each domain; a gives its 10, b takes the other 142


def test_empty_table(spark):
    assert M.mix_sources(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
