"""Chunked byte-level BPE against the library, whole and piece by piece."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from lodestone.llm import chunk_bpe

SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", "'", "'re", "'s", " ", "  ", "\n", "1", "²", "é", "日", "$", "<|endoftext|>", "ab" * 40, "\t \n", "don't", " it'll", "́", "x" * 700, " " * 90, "lorem ipsum dolor sit amet " * 9]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(path("byte_bpe_50k.json")))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=120).map("".join), min_size=1, max_size=3))
def test_ids_equal_the_library(texts):
    library = Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    coder = chunk_bpe.chunk_coder()
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert coder.decode(ids) == t


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 30_000, "'" * 20_000, "\n " * 20_000, "x" + " " * 9_000 + "y", "é" * 20_000, "<|endoftext|>" * 3])
def test_texts_whose_chunks_never_agree(text, library):
    assert chunk_bpe.chunk_coder().encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=80))
def test_decoding_equals_the_library(ids):
    library = Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    assert chunk_bpe.chunk_coder().decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_cuts_follow_content():
    rnd = np.random.default_rng(3)
    body = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], 6000).tolist())
    for text in (body, "", "ab", body[:70]):
        ends = chunk_bpe.cut_points(text)
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(text) and (sizes <= chunk_bpe.MOST).all() and (sizes[:-1] >= chunk_bpe.LEAST).all()
    cut = lambda t: {t[a:b] for a, b in zip([0, *chunk_bpe.cut_points(t)], chunk_bpe.cut_points(t), strict=False)}
    one, two = cut(body), cut("Another beginning. " + body[:9000] + " an edit " + body[9000:])
    assert len(one & two) > 0.8 * len(one)
    assert chunk_bpe.cut_points(body, stretch=1000) == chunk_bpe.cut_points(body)  # stretches don't show


def test_shared_chunks_are_encoded_once():
    from lodestone.llm.wordbpe import byte_encoder

    coder = chunk_bpe.ChunkCoder(byte_encoder())
    rnd = np.random.default_rng(5)
    body = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], 4000).tolist())
    coder.encode([body])
    before = coder.encoded
    coder.encode([body, body + " end"])
    windows = 2 * len(chunk_bpe.cut_points(body)) * (chunk_bpe.AHEAD + 40)
    assert coder.encoded - before < windows and coder.encoded - before < 0.6 * len(body)
    small = chunk_bpe.ChunkCoder(byte_encoder(), kept_chars=2000)
    assert small.encode([body, body])[1].tolist() == coder.encode([body])[0].tolist()
    assert sum(map(len, small.young)) + sum(map(len, small.old)) < 2000 + 3 * chunk_bpe.MOST


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(None, "a b", "x"), (7001, None, "x"), (7002, "", "x"), (7003, "one", "x"), (7003, "one", "x"), (7004, "é à ü " * 9000, "x"), (7005, "a<|endoftext|>b", "x")]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumnRenamed("lang", "ids_sha256")
    rows = chunk_bpe.encode_documents(df).collect()
    assert len(rows) == df.count()
    texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = chunk_bpe.decode_ids(chunk_bpe.encode_documents(df.where("doc_id IS NOT NULL")))
    assert {r.doc_id: r.text for r in back.collect()} == {k: v for k, v in texts.items() if k is not None}
    assert chunk_bpe.encode_documents(df.limit(0)).count() == 0
    assert chunk_bpe.encode_documents(df, keep_ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
