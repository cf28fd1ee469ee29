import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from envsense.llm import ngram_join as J


def brute(docs, n=5, percent=75):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(k)] = min(d, ids.get(find(k), d))
    return sorted(((d, len(sets[k]), ids.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(docs)), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 12))) for _ in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs = [text(r.randrange(0, 60)) for _ in range(60)]
    passage = text(60)
    docs += [passage + text(r.randrange(1, 30)) for _ in range(30)]  # a passage that many share
    for base in [text(80), text(40), text(12), passage]:  # near copies, some at the limit, some by way of others
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(w[: r.randrange(len(w) * 3 // 4, len(w) + 1)])
    docs += [["Word"], ["word"], [], ["a", "b"], ["A", "B"], ["a"] * 400, ["a"] * 500]
    docs = [" ".join(w) for w in docs] + [None, None, "  "]
    r.shuffle(docs)
    return [(None if k % 40 == 7 else 10_000 - k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("seed,range_bytes", [(1, J.RANGE_BYTES), (2, 4000), (3, 400)])
def test_against_all_pairs(spark, seed, range_bytes):
    docs = corpus(seed)
    given = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, size int").repartition(3)
    got = sorted((tuple(r) for r in J.similar_documents(given, range_bytes=range_bytes).collect()), key=str)
    assert got == brute(docs)


def test_empty_table(spark):
    assert J.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlap_and_suffix_filter():
    r = np.random.default_rng(0)
    for _ in range(300):
        pool = np.sort(r.choice(2**40, 400, replace=False).astype(np.uint64))
        a = np.sort(r.choice(pool, r.integers(200, 400), replace=False))
        b = np.sort(r.choice(pool, r.integers(200, 400), replace=False))
        i = len(np.intersect1d(a, b))
        assert J.linked(a, b, 75) == (100 * i >= 75 * (len(a) + len(b) - i))


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(2)
    pool = r.choice(2**50, 4000, replace=False).astype(np.uint64)
    for _ in range(200):
        a, b = (np.sort(r.choice(pool[: r.integers(60, 4000)], r.integers(1, 60), replace=False)) for _ in range(2))
        if r.random() < 0.3:
            b = np.concatenate([a, r.choice(pool, 200)])
        b = np.unique(b)
        x, y = (np.frombuffer(J.bitmap(s), "<u8") for s in (a, b))
        differ, common = J.differences(x, y), len(np.intersect1d(a, b))
        assert differ <= len(a) + len(b) - 2 * common
        if 100 * common >= 75 * (len(a) + len(b) - common):
            assert J.may_link(differ, len(a), len(b), 75)


def test_pairs_are_verified_once(spark, monkeypatch):
    seen, verify = [], J._verified

    def counted(pairs, *rest):
        seen.extend(map(tuple, pairs.select("a", "b").collect()))
        return verify(pairs, *rest)

    monkeypatch.setattr(J, "_verified", counted)
    J.similar_documents(spark.createDataFrame(corpus(4), "doc_id long, text string")).collect()
    assert len(seen) == len(set(seen)) > 20 and all(a < b for a, b in seen)


def test_one_row_of_each_group(spark):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(n))
    base, other, third = text(60), text(60), text(40)
    near = base + " xx"
    rows = [(5, base, 1), (3, near, 1), (3, near, 1), (3, near, 2), (3, other, 1), (None, base, 1), (None, third, 1), (None, third, 2), (8, None, 1), (8, None, 1), (9, "", 1), (9, " ", 1), (2, "one two", 1), (1, "ONE two", 1), (1, "One two", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int").withColumn("row_a", F.create_map(F.lit("k"), F.col("gone"))).repartition(3)
    out = J.one_of_each(docs)
    assert out.dtypes == docs.dtypes
    got = sorted(((x.doc_id, x.text, x.gone) for x in out.collect()), key=str)
    for must in [(3, other, 1), (8, None, 1), (9, "", 1), (9, " ", 1)]:
        assert got.count(must) == rows.count(must), must
    groups = [{(3, near, 1), (3, near, 2)}, {(None, third, 1), (None, third, 2)}, {(1, "ONE two", 1), (1, "One two", 1)}]
    for group in groups:
        assert sum(got.count(x) for x in group) == 1
    assert len(got) == 1 + 2 + 2 + 3
    assert J.one_of_each(docs.limit(0)).count() == 0
