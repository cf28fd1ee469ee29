import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from envsense.llm import bpe, merges
from envsense.llm.common import vocabulary
from tests.llm.test_tokens import TEXTS


@pytest.fixture(scope="module")
def tokens():
    return merges.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_two_folds_agree_with_the_library(spark, tokens, reference):
    r = random.Random(4)
    words = ["", "a", "é", " the", "x" * 300, "abc" * 200, "'s", "\n\n", *("".join(r.choice("etaoinsrhl dé") for _ in range(r.randrange(1, 30))).strip() for _ in range(200))]
    want = [reference.encode_ordinary(w) if " " not in w[1:] else None for w in words]
    n, ids = merges.Merger(tokens).encode([w.encode() for w in words])
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert all(g == w for g, w in zip(got, want) if w is not None)
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)] + [(-1, None)], "k int, w string")
    spark_ids = {x.k: x.ids for x in df.select("k", merges.SparkMerges(tokens).encode(F.col("w").cast("binary")).alias("ids")).collect()}
    assert spark_ids.pop(-1) is None and [spark_ids[k] for k in range(len(words))] == got
    few = merges.SparkMerges(tokens, [w.encode() for w in words])
    assert [x.ids for x in df.where("k >= 0").orderBy("k").select(few.encode(F.col("w").cast("binary")).alias("ids")).collect()] == got


def test_round_trip_with_edge_cases(spark, tokens, reference):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(TEXTS)], "ids long, text string, k int")
    got = bpe.encode(docs, tokens)
    assert got.columns == ["ids", "k", "_ids"]
    back = bpe.decode(got, tokens, column_name="_ids").collect()
    for r in back:
        text = TEXTS[r.k][1] or ""
        assert r._ids == reference.encode_ordinary(text) and bytes(r.bytes).decode() == text
    assert bpe.encode(docs.limit(0), tokens).count() == 0
    for r in bpe.digests(docs, tokens).collect():
        text = TEXTS[r.k][1] or ""
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_query(spark, reference):
    from tests.conftest import SF

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op8_bpe(spark, SF).collect():
        ids = np.array(reference.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_every_distinct_word_goes_through_the_spark_functions(spark, tokens, reference, monkeypatch):
    """rare words, words beyond ASCII and words too long for a worker's table are folded by Spark functions, block by block."""
    monkeypatch.setattr(bpe, "BLOCK", 1 << 12)
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioutnsrlmdé漢") for _ in range(r.randrange(1, 12)))
    texts = [" ".join(word() for _ in range(r.randrange(1, 200))) for _ in range(60)] + ["x" * 700 + " 'll", "y" * 5000, "", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(3, "k").sortWithinPartitions("k")
    state = spark.sparkContext.broadcast(("own", tokens))
    path = bpe.new_dir(spark, "test")
    bpe.write_words(docs.select("text"), tokens, state, path)
    held = spark.read.parquet(path)
    got = {bytes(x.word): x.ids for x in held.collect()}
    want = {w.encode() for t in texts for w in _words(t or "")}
    assert set(got) == {w for w in want if len(w) <= bpe.LONG_WORD} and len(want) > 3000
    assert all(ids == reference.encode_ordinary(w.decode()) for w, ids in got.items())
    assert held.select("block").distinct().count() > 10
    _, counts, ids = bpe.read_words(path, held.first().block)
    assert counts.sum() == len(ids) > 0
    for x in bpe.encode(docs, tokens).collect():
        assert x.ids == reference.encode_ordinary(texts[x.k] or "")


def _words(text):
    import re

    return re.findall(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+", text)


def test_a_worker_s_table_grows(tokens, reference):
    """A table takes the memory of the words it holds, not of the most it may hold, and starts anew only there."""
    encoder = bpe.pieces.Encoder(bpe.Backend(tokens), 6, most_bits=14)
    texts = [" ".join(f"w{k * j}q" for k in range(80)) for j in range(1, 40)]
    n, ids = encoder.encode(bpe.pa.array(texts))
    assert ids.tolist() == [x for t in texts for x in reference.encode_ordinary(t)]
    assert 6 < encoder.bits <= 14 and encoder.table.n <= len(encoder.table.slots) // 2


def test_the_tables_of_pairs_are_no_literals_of_the_plan(spark, tokens, reference):
    """they filled the driver, and each task read them anew; nor does a step of the plan return them with its rows."""
    words = ["", "a", " the", "x" * 300, " inestimable", "漢字", "zz\n", *(f" w{k}aeiou{k * k}" for k in range(50)), None]
    df = spark.createDataFrame([(k, w and w.encode() if w != "" else b"") for k, w in enumerate(words)], "tables int, word binary").repartition(3)
    df = df.groupBy("word").agg(bpe.F.max("tables").alias("tables"))
    out = merges.SparkMerges(tokens).encoded(df, "word", "ids")
    assert out.columns == ["word", "tables", "ids"]
    merger = merges.Merger(tokens)
    for r in out.collect():
        assert r.ids is None if r.word is None else r.ids == merger.encode([bytes(r.word)])[1].tolist()
    plan = out._jdf.queryExecution()
    assert len(plan.optimizedPlan().toString()) < 50_000
    nodes = [plan.optimizedPlan()]
    for node in nodes:
        assert all("bytes:array" not in node.output().apply(k).dataType().simpleString() for k in range(node.output().size()))
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert len(nodes) > 2
    # ``get`` of a transformed array works the type of its whole function out for each row
    assert "transform(array(" not in plan.optimizedPlan().toString() and "aggregate(array(" in plan.optimizedPlan().toString()
