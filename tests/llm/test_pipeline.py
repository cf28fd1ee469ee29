import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from envsense.llm import quality
from tests.llm import test_decontamination, test_line_dedup, test_ngram_join, test_quality
from tests.llm.test_bpe import reference  # noqa: F401


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioutnsrlm") for _ in range(r.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(25)) for i in range(4)]
    base = [[line(20) for _ in range(5)] for _ in range(12)]
    docs = ["\n".join(b) for b in base]
    docs += ["short text", " ".join(["same old words"] * 40)]
    docs += ["\n".join(base[0]), "\n".join([*base[1][:4], line(20)])]  # a copy, and one that line dedup leaves a line of
    docs += [f"{line(30)}\n{line(10)} {items[1][1]} {line(10)}\n{line(20)}"]
    w = [[word() for _ in range(90)] for _ in range(2)]  # near copies in one long line whose lines differ enough
    for k in range(3):
        docs.append("\n".join(" ".join(x[i : i + 4]) for x in w for i in range(0, 90 - 5 * k, 4)))
    path = tmp_path_factory.mktemp("sf")
    frame = pd.DataFrame({"doc_id": range(len(docs)), "text": docs, "lang": "en", "source": ["a", "b"] * (len(docs) // 2) + ["a"] * (len(docs) % 2), "n_chars": list(map(len, docs))})
    frame.to_parquet(path / "documents.parquet")
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(path / "benchmark.parquet")
    return str(path), frame, items


def test_against_brute_force(spark, sf_dir, reference):  # noqa: F811
    path, frame, items = sf_dir
    rows = list(frame.itertuples(index=False))
    verdict = test_quality.brute([(r.doc_id, r.text, r.source) for r in rows], quality.MIN_DOCS, quality.MAX_SHARE)
    good = {v[0] for v in verdict if v[-1]}
    docs = [(r.doc_id, r.text) for r in rows if r.doc_id in good]
    gone = set()
    for first, places in test_line_dedup.brute(docs):
        stay = min(p for p in places if p[0] == first)
        gone |= set(places) - {stay}
    docs = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in docs]
    docs = [(d, t) for d, t in docs if t.split()]
    docs = [(d, t) for (d, t), (_, _, c) in zip(sorted(docs), sorted(test_ngram_join.brute(docs))) if d == c]
    leaked = {d for d, _, _ in test_decontamination.brute(docs, items)}
    docs = [(d, t) for d, t in docs if d not in leaked]
    want = set()
    for d, t in docs:
        ids = reference.encode_ordinary(t)
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert set(map(tuple, corpus_pipeline.run(spark, path).collect())) == want
    assert 5 < len(want) < len(rows) - 4 and leaked


def test_stages_return_documents(spark, sf_dir):
    path = sf_dir[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), path).count() == 0


def test_stages_with_nulls_repeats_and_other_columns(spark, sf_dir):
    path = sf_dir[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"gone": F.lit(1), "n_removed": F.lit("x")})
    odd = docs.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")})
    docs = docs.union(docs.limit(2)).union(odd).union(docs.limit(2).withColumns({"text": F.lit(None).cast("string")})).union(docs.limit(1).withColumn("text", F.lit("")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count()
