"""Operator 12 against all pairs of contents."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from envsense.llm import exact_dedup as E

SCHEMA = "doc_id long, text string"


def brute(rows):
    """doc_id, keep_id, group_size, kept, digest of each row; of rows that share the greatest id one is kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        left = [True]
        out += [(i, best, len(ids), i == best and bool(left and left.pop()), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_nulls_ties_and_empty_texts(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "n"), (None, "n"), (5, "t"), (5, "t"), (5, "u"), (6, "a "), (7, "Ä\U0001f600" * 9000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(E.exact_groups(docs)) == brute(rows)
    assert E.exact_groups(docs.limit(0)).count() == 0
    folded = E.exact_groups(docs, normalise=lambda t: F.trim(t))
    assert {r.doc_id: r.keep_id for r in folded.collect() if r.doc_id in (1, 6)} == {1: 6, 6: 6}


def test_buckets_that_do_not_fit_are_spilled_and_dealt_again(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc ", k=400)) for _ in range(300)]
    rows = [(i, rng.choice(texts) if i % 3 else "the hot text") for i in range(3000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(E.exact_groups(docs, limit=2000)) == brute(rows)


def test_contents_with_one_hash_are_told_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(100)]
    each = spark.createDataFrame(rows, SCHEMA).select(F.lit(1).cast("long").alias("hash"), F.col("text").cast("binary").alias("text"), F.col("doc_id").alias("id"))
    got = {(r.text_sha256, r.n, r.id) for r in E.classes(each, limit=20).collect()}
    assert got == {(hashlib.sha256(f"text {k}".encode()).hexdigest(), sum(i % 7 == k for i in range(100)), max(i for i in range(100) if i % 7 == k)) for k in range(7)}


def test_table_grows_and_probes():
    held = E.Contents(slots=4)
    words = [str(k % 500).encode() for k in range(3000)]
    hashes = np.array([int(w) % 50 for w in words], np.uint64)  # ten contents for each hash
    entry = np.concatenate([held.place(hashes[k : k + 700], lambda j, k=k: words[k + j]) for k in range(0, 3000, 700)])
    assert len(held) == 500 and [held.contents[e] for e in entry] == words


def test_records_keep_the_greatest_id():
    held = E.Contents()
    for ids in ([None, 3, None], [-5, None, 3]):
        n = len(ids)
        held.add(pa.RecordBatch.from_arrays([pa.array([9] * n), pa.array([b"x"] * n, pa.binary()), pa.array([1] * n), pa.array(ids, pa.int64()), pa.array([1] * n)], names=list("abcde")))
    assert (held.n[0], held.ids[0], held.valid[0], held.n_max[0]) == (6, 3, True, 2)


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a", "p", 1), (2, "a", "q", 2), (2, "a", "r", 3), (None, None, "s", 4), (9, "b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n long")
    got = E.one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=repr)
    assert len(kept) == 3 and {r[:2] for r in kept} == {(2, "a"), (None, None), (9, "b")} and set(kept) <= set(rows)


def test_copies_are_numbered_in_chunks(spark):
    from envsense.llm.common import numbered

    got = numbered(spark.createDataFrame([("a", 7), ("b", 1)], "k string, n long"), "n", "i", chunk=3)
    assert sorted(map(tuple, got.select("k", "i").collect())) == [("a", i) for i in range(7)] + [("b", 0)]
