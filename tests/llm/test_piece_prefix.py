import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from remuneria.llm import piece_prefix as pp

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
LETTERS = list("aeiouthrns  ▁▁\n\t.,<>/0x日本🎉éßﬁ①１‍́") + ["</s>", "<s>", "<0x41>", "the ", "    "]


@pytest.fixture(scope="module")
def model():
    return pp.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encode_and_decode_equal_the_library(model, library):
    e, d = pp.made(pp.Encoder, model), pp.made(pp.Decoder, model)
    rng = random.Random(2)
    texts = ["", " ", "a", "\n", "x" * 5000, " " * 5000, "ab " * 3000, "".join(map(chr, range(32, 0x2FFF)))]
    for _ in range(3000):
        texts.append("".join(rng.choice(LETTERS) if rng.random() < .9 else chr(rng.randrange(1, 0xD7FF))
                             for _ in range(rng.randint(0, 60))))
    for t in texts:
        ids = e.encode(t)
        assert ids == library.encode(t), t[:80]
        assert d.decode(ids + [2]) == library.decode(ids + [2])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 260), st.sampled_from([1, 2, 259, 28705])), max_size=12))
def test_decode_of_any_ids(ids):
    m = pp.read_model(PATH)
    assert pp.made(pp.Decoder, m).decode(ids) == sentencepiece.SentencePieceProcessor(model_file=PATH).decode(ids)


def test_table_holds_the_last_token_of_each_prefix(model):
    e = pp.made(pp.Encoder, model)
    for part in ("▁international", "▁▁▁▁▁", "▁thntwhre", "日本語"):
        assert [t[4] for t in e.last_tokens(part)] == [e.v.merged(part[:i + 1])[-1] for i in range(len(part))]


def test_memories_stay_bounded(model, monkeypatch, library):
    monkeypatch.setattr(pp, "MEMO", 5)
    monkeypatch.setattr(pp, "PAIRS", 7)
    e, rng = pp.Encoder(model), random.Random(4)
    for _ in range(50):
        t = " ".join("".join(rng.choice("aeinrt") for _ in range(rng.randint(1, 9))) for _ in range(20))
        assert e.encode(t) == library.encode(t)
        assert len(e.memo) <= 5 and len(e.older) <= 5 and sum(len(t[2]) for t in e.tokens) <= 7


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in pp.op12_piece_prefix(spark, SF).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_eos=True)
        assert got[doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_odd_rows(spark, odd_docs, empty_docs, model, library, monkeypatch):
    monkeypatch.setattr(pp, "BATCH_CHARS", 500)
    more = odd_docs.withColumn("ids", odd_docs.h).withColumn("__IN", odd_docs.n)
    out = pp.decode(pp.encode(more, model), model)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and set(out.columns) == set(odd_docs.columns) | {"ids", "decoded", "__IN"}
    for r in rows:
        assert r["ids"] == library.encode(r.text or "", add_eos=True) and r.decoded == library.decode(r["ids"])
    both = pp.encode(more, model, decoded="text").collect()
    assert sorted((r["ids"], r.text) for r in both) == sorted((r["ids"], r.decoded) for r in rows)
    assert pp.token_digests(empty_docs, model).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in pp.decode(none, model).orderBy("doc_id").collect()] == [None, ""]


def test_other_models_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pp.Vocabulary(proto.SerializeToString())
