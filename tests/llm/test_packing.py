import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ridelens.llm import packing as P


def test_cut():
    assert P.cut(1, 8) == [(0, 1)] and P.cut(8, 8) == [(0, 8)] and P.cut(16, 8) == [(0, 8), (8, 8)]
    assert P.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def check(bins, lens, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lens)))
    assert all(0 < sum(lens[i] for i in b) <= capacity for b in bins)


def test_operators_keep_every_item_once():
    rng = random.Random(1)
    lens = [rng.randrange(1, 101) for _ in range(300)]
    a = P.best_fit(sorted(range(300), key=lambda i: -lens[i]), lens, [], 100)
    b = P.best_fit(list(range(300)), lens, [], 100)
    for bins in (a, b, P.crossover(a, b, lens, 100, rng), P.crossover(b, a, lens, 100, rng), P.mutate(a, lens, 100, rng)):
        check(bins, lens, 100)
    assert P._bins(P._genome(a, 300)) == [sorted(x) for x in a]


def test_best_fit_takes_the_fullest_bin_that_fits():
    assert P.best_fit([3], [5, 7, 6, 3], [[0], [1], [2]], 10) == [[0], [1, 3], [2]]


def test_search_improves_on_best_fit_decreasing():
    """Triplets that fill a bin exactly, which best-fit decreasing misses."""
    rng = random.Random(9)
    lens = []
    for _ in range(20):
        a = rng.randrange(380, 490)
        b = rng.randrange(250, (1000 - a) // 2)
        lens += [a, b, 1000 - a - b]
    start = P.best_fit(sorted(range(60), key=lambda i: -lens[i]), lens, [], 1000)
    best = start
    for epoch in range(30):
        best = P.evolve(lens, 1000, epoch, [best])
    check(best, lens, 1000)
    assert 20 <= len(best) < len(start)


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(4)
    texts = {i: " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.choice([1, 20, 90, 300, 900]))) for i in range(240)}
    texts |= {900: None, 901: "", 902: "long " * 5000, 903: "<|endoftext|> é 😀"}
    rows = [(i, t, "x") for i, t in texts.items()] + [(5, texts[5], "y"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    return rows, P.pack(P.stage(P.pieces(df), "pieces"), block=100).collect()


def test_pieces_match_the_tokenizer(packed):
    rows, out = packed
    t = Tokenizer.from_file(P.tokenizer_path("byte_bpe_50k.json"))
    want = []
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        rest = len(ids) % 1024 or 1024
        at = 0
        for k, to in enumerate(range(rest, len(ids) + 1, 1024)):
            want.append((str(i), k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
            at = to
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)


def test_sequences_are_gapless_and_few(packed):
    _, out = packed
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    lens = [r.length for r in out]
    whole = P.best_fit(sorted(range(len(lens)), key=lambda i: -lens[i]), lens, [], 1024)
    assert -(-sum(lens) // 1024) <= len(by) <= len(whole) + -(-len(out) // 100)  # blocks of 100 cost one each at worst


def test_empty_table(spark):
    assert P.best_fit_packing(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rank_file_gives_the_ids_of_the_json_tokenizer():
    import base64

    rng = random.Random(1)
    with open(P.tokenizer_path(), "rb") as f:
        tokens = [base64.b64decode(x.split()[0]).decode("utf-8", "ignore") for x in f]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F6FF), 10, 0x3000])) for _ in range(rng.randrange(200))) for _ in range(800)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", "  \n\n x", "a" * 20000]
    t, e = Tokenizer.from_file(P.tokenizer_path("byte_bpe_50k.json")), P.encoder(P.tokenizer_path())
    assert [t.encode(x, add_special_tokens=False).ids for x in texts] == [e.encode(x, allowed_special="all") for x in texts]


@pytest.mark.parametrize("blank", [" ", "\n", " \n"])
def test_very_long_blank_runs_are_encoded(spark, blank):
    text = "a " + blank * (1_200_000 // len(blank)) + "<|endoftext|> b"
    t = Tokenizer.from_file(P.tokenizer_path("byte_bpe_50k.json"))
    ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
    out = P.pieces(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).collect()
    got = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 1)
    assert got == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in P.cut(len(ids), P.CAPACITY)]
    assert sum(r.doc_id == 2 for r in out) == 1
