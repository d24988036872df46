"""Pieces and spans against the library itself, on this model and on copies with character maps."""
import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as formats

from ridelens.llm import sentence_pieces as S

PARTS = [*"abc  \n\t AB12ﬁ①ｱﾞがÅ中😀🧿▁½㍿", "か゚", "é", " ", "　", "​", "\u0000", "  ", "the ", "<s>", "<0x0A>"]
EDGES = [None, "", " ", "   ", "▁", "a", "a ", " a", "  a  b  ", " ▁ ", "x▁▁ ", "😀" * 40, "x" * 300_000, "ab " * 100_000, " " * 200_000]


def texts(n=1500):
    rng = random.Random(1)
    return EDGES + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(n)]


def variant(folder, rule, **settings):
    m, other = formats.ModelProto(), formats.ModelProto()
    with open(S.model_path(), "rb") as f:
        m.ParseFromString(f.read())
    if rule:
        other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        m.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    for name, value in settings.items():
        setattr(m.normalizer_spec, name, value)
    path = folder / "variant.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("rule, settings", [
    (None, {}), ("nmt_nfkc", {}), ("nmt_nfkc_cf", {"remove_extra_whitespaces": True}), ("nfkc", {"add_dummy_prefix": False}),
    (None, {"remove_extra_whitespaces": True}), (None, {"escape_whitespaces": False})])
def test_ids_and_spans_equal_the_library(tmp_path, rule, settings):
    model, rows = S.Model(variant(tmp_path, rule, **settings)), texts()
    for at, to, data, offsets in S.runs(pa.array(rows)):
        ids, begins, ends, tokens = model.encode(data, offsets)
        for i, text in enumerate(rows[at:to]):
            a, b = tokens[i], tokens[i + 1]
            pieces = model.library.encode(text or "", return_type="proto").pieces
            assert ids[a:b].tolist() == [p.id for p in pieces]
            assert list(zip(begins[a:b].tolist(), ends[a:b].tolist())) == [(p.begin, p.end) for p in pieces]


def test_uncut_model_gives_the_same_ids():
    model, cut = S.Model(S.model_path()), S.load(S.model_path())
    model.cut = False
    for _, _, data, offsets in S.runs(pa.array(texts(200)[:9] + texts(200)[15:])):
        assert model.encode(data, offsets)[0].tolist() == cut.encode(data, offsets)[0].tolist()


def test_query_over_hand_rows(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts(100))] + [(5, "a", None), (None, "b c", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    library = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "")
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode())))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in S.encoding_digests(df).collect()), key=order) == sorted(want, key=order)
    assert S.encode_pieces(df).columns == ["doc_id", "ids", "begins", "ends"]
    assert S.encoding_digests(df.limit(0)).count() == 0


def test_decode_is_the_inverse_and_null_is_empty(spark):
    df = spark.createDataFrame([(1, "Zwei  Wörter\n🧿"), (2, None)], "doc_id long, text string")
    ids = S.encode_pieces(df).withColumn("ids", F.when(F.col("doc_id") == 1, F.col("ids")))
    assert {r["doc_id"]: r["decoded"] for r in S.decode_pieces(ids).collect()} == {1: "Zwei  Wörter\n🧿", 2: ""}


def test_unsuitable_models_raise(tmp_path):
    m = formats.ModelProto()
    with open(S.model_path(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        S.Model(str(tmp_path / "unigram.model"))
