import re

import corpus_pipeline as C
from ridelens.llm import jaccard as J
from ridelens.llm.common import documents, stage

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_on_what_the_one_before_kept(spark):
    docs = documents(spark, SF)
    seen = {}
    for name, step in C.STAGES:
        seen[name] = (docs.collect(), None)
        out = stage(step(spark, docs, SF), name)
        seen[name] = (seen[name][0], out.collect())
        if step is not C.STAGES[-1][1]:
            assert out.columns == documents(spark, SF).columns
        docs = out
    before, after = seen["quality_rules"]
    assert 0 < len(after) < len(before) and set(after) <= set(before)

    before, after = seen["ngram_jaccard_join"]
    assert set(after) <= set(before)
    shingles = lambda t: frozenset(tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t.lower())] for i in range(max(1, len(w) - 4)))
    kept = {r.doc_id: shingles(r.text) for r in after}
    near = lambda a, b: 100 * len(a & b) >= J.PERCENT * len(a | b)
    ids = sorted(kept)
    assert not any(near(kept[a], kept[b]) for k, a in enumerate(ids) for b in ids[:k])
    # what went is linked, perhaps over others that went, to a smaller id
    gone = {r.doc_id: shingles(r.text) for r in before if r.doc_id not in kept}
    everything = {**kept, **gone}
    assert all(any(near(s, t) for j, t in everything.items() if j != i) for i, s in gone.items())

    before, after = seen["secret_scans"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert any("[secret]" in r.text for r in after)
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text) for r in after)
    same = {r.doc_id: r for r in before}
    assert all(r == same[r.doc_id] for r in after if "[secret]" not in r.text)

    before, after = seen["mix_to_target_weights"]
    assert after and set(after) <= set(before)

    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sum(r.piece == 0 for r in after) == len(before)


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in C.run(spark, "/root/testdata/sf0.001").columns


CLASHES = ["_row", "_runs", "_id", "_th", "_t", "_d", "spans", "epoch", "domain", "n_tokens", "text_hash", "node", "rid", "_text", "_clean"]


def _edge_docs(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *[f"{c}!" for c in CLASHES]) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    """Null ids, texts, langs and sources; empty and repeated rows; columns named like ours come out as they went in."""
    prose = " ".join(f"word{i}" for i in range(40))
    rows = [(1, prose, "en", "a", 5), (2, prose, "en", "a", 5), (None, prose, None, None, None), (None, prose, None, None, None), (3, None, "en", "a", 0),
            (4, "", None, "b", 0), (5, prose + " password=hunter22x other " + prose[::-1], None, "b", 7), (5, prose + " password=hunter22x other " + prose[::-1], None, "b", 7),
            (6, " ".join(f"w{i % 7}x{i}" for i in range(60)), "de", None, None), (7, "one two " * 40, "en", "a", 1)]
    docs = _edge_docs(spark, rows)
    steps = dict(C.STAGES)
    same = lambda r: all(r[c] == f"{c}!" for c in CLASHES)

    kept = steps["quality_rules"](spark, docs, SF)
    got = kept.collect()
    assert kept.columns == docs.columns and all(map(same, got))
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "5", "5", "6", "None", "None"]  # null, empty and repetitive texts fail the rules

    one = steps["ngram_jaccard_join"](spark, docs, SF)
    got = one.collect()
    assert one.columns == docs.columns and all(map(same, got))
    # 2 is 1's copy, the second row of 5 its repeat; rows without an id or words all stay
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "5", "6", "7", "None", "None"]

    clean = steps["secret_scans"](spark, docs, SF)
    got = clean.collect()
    assert clean.columns == docs.columns and len(got) == len(rows) and all(map(same, got))
    assert sum("[secret]" in (r.text or "") for r in got) == 2 and not any("hunter22x" in (r.text or "") for r in got)
    assert sorted(str((r.doc_id, r.n_chars)) for r in got if r.doc_id != 5) == sorted(str((r[0], r[4])) for r in rows if r[0] != 5)

    mixed = steps["mix_to_target_weights"](spark, docs, SF)
    assert mixed.columns == docs.columns and all(map(same, mixed.collect()))

    packed = steps["best_fit_packing"](spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(r[0]) for r in rows)


def test_stages_of_an_empty_table(spark):
    docs = _edge_docs(spark, []).limit(0)
    for name, step in C.STAGES:
        assert step(spark, docs, SF).count() == 0, name
