import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from envsense.llm import pieces, token_counts, token_output
from envsense.llm.common import new_dir, vocabulary

TEXTS = [(3, "don't stop \n\n 12 a''s ''ll <|endoftext|> x<|endoftext|>"), (1, None), (2, ""), (None, "null id"), (1, "déjà vu 漢字   wide"), (1, "déjà vu 漢字   wide"), (9, "word " * 9000), (10, "a  b\t\tc \n d   ")]


@pytest.fixture(scope="module")
def vocabulary_json():
    return open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read()


def expected(vocabulary_json, text):
    return pieces.library(vocabulary_json).encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(spark, vocabulary_json):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(TEXTS)], "n_tokens long, text string, k int")
    for first in (None, token_counts.frequent_pieces(docs, "text", vocabulary_json, most=2), token_counts.frequent_pieces(docs.limit(0), "text", vocabulary_json)):
        got = token_counts.count_tokens(docs, vocabulary_json, first=first)
        assert got.columns == ["n_tokens", "k", "_n_tokens"]
        for r in got.collect():
            assert r["_n_tokens"] == len(expected(vocabulary_json, TEXTS[r.k][1]))
    assert token_counts.count_tokens(docs.limit(0), vocabulary_json).count() == 0


def test_files_come_back_whole_and_in_order(spark, vocabulary_json):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    path = new_dir(spark, "test")
    token_output.write_tokens(docs, path, vocabulary_json)
    got = sorted(token_output.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 2, 3, 9, 10]
    want = sorted((-1 if i is None else i, len(ids := [*expected(vocabulary_json, t), 0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in TEXTS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_empty_table(spark, vocabulary_json):
    path = new_dir(spark, "test")
    token_output.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary_json)
    assert token_output.read_digests(spark, path).count() == 0


ALPHABET = st.sampled_from(list("ab sstdmrevl'''\\n\\t .,1\\u00e9\\u00df\\u00a0\\u0085\\u00b2\\x1c\\x00\\u0130"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60) | st.sampled_from(["'ll''re 've", "x" * 50, "漢字", "a<|endoftext|>b"]), max_size=6))
def test_ids_are_the_library_s(vocabulary_json, encoder, texts):
    n, ids = encoder.encode(pa.array([None, *texts, "end"]).slice(1))
    want = [encoder.backend.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, "end"]]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.fixture(scope="module")
def encoder(vocabulary_json):
    return pieces.Encoder(pieces.Library(vocabulary_json), bits=6)  # so small that it runs over again and again


def test_long_text_is_cut_and_whole(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "STRIDE", 64)
    text = "some words here, and  there 's more\n" * 50
    n, ids = encoder.encode(pa.array([text, "a"]))
    assert ids[: n[0]].tolist() == encoder.backend.tokenizer.encode(text, add_special_tokens=False).ids


WIDE = st.sampled_from(list("ab s1'.\n\u00a0\u0301\u0391\u0416\u05d0\u0661\u0e01\u0e31\u1680\u2003\u2028\u3000\u3002\u4e00\u6f22\u8fff\uac00\uff11\U0001f600\U0001f469\u200d\U00020000\U0001d7d8\u0378")) | st.characters(codec="utf-8")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(WIDE, max_size=40), max_size=5))
def test_texts_of_any_script(vocabulary_json, encoder, by_ranks, texts):
    n, ids = encoder.encode(pa.array(texts, pa.string()))
    want = [expected(vocabulary_json, t) for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [k for w in want for k in w]
    own, library = by_ranks
    n, ids = own.encode(pa.array(texts, pa.string()))
    want = [library.encode_ordinary(t) for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [k for w in want for k in w]


@pytest.fixture(scope="module")
def by_ranks():
    import tiktoken

    from envsense.llm import bpe, merges

    tokens = merges.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    return pieces.Encoder(bpe.Backend(tokens), bits=12), library


def test_long_texts_without_spaces(vocabulary_json, encoder, monkeypatch):
    monkeypatch.setattr(pieces, "STRIDE", 1 << 10)
    texts = ["漢字仮名。" * 900, "漢字" * 2000, "。。漢。 漢" * 700, "é" * 3000]
    n, ids = encoder.encode(pa.array(texts))
    want = [expected(vocabulary_json, t) for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [k for w in want for k in w]
