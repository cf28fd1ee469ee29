import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from envsense.llm import lm_score, merges, textkit
from envsense.llm.attention import Model, windows
from envsense.llm.common import vocabulary


@pytest.fixture(scope="module")
def tokens():
    return merges.read_ranks(vocabulary("byte_bpe_50k.tiktoken"), lm_score.SUBWORDS)


def test_gradients_against_differences():
    m = Model(7, 10, 5, dim=4, seed=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    x, y, c = r.integers(0, 7, (3, 5)), r.integers(0, 10, (3, 5)), r.random((3, 5)) < 0.7
    _, g = m.gradients(x, y, c)
    for name, v in m.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in v.shape)
            if name.startswith("member") and at[0] * m.side + at[1] >= 10:
                continue
            old, e = v[at], 1e-5
            v[at] = old + e
            up = -m.score(x, y, c).mean()
            v[at] = old - e
            down = -m.score(x, y, c).mean()
            v[at] = old
            assert abs((up - down) / 2 / e - g[name][at]) < 1e-4, name


def test_probabilities_sum_to_one_and_are_causal():
    m = Model(6, 11, 4, dim=8, seed=2)
    x = np.array([[1, 2, 3, 0]])
    last = np.array([[False, False, True, False]])
    total = sum(math.exp(m.score(x, np.full((1, 4), t), last)[0]) for t in range(11))
    assert abs(total - 1) < 1e-5
    later = x.copy()
    later[0, 3] = 5
    assert m.score(x, x, last)[0] == m.score(later, x, last)[0]


def test_each_place_counts_once():
    lengths = np.array([0, 1, 5, 8, 9, 40, 13])
    place, counted = windows(lengths, 8, 3)
    assert sorted(place[counted].tolist()) == list(range(lengths.sum()))
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    context = place[counted] - place[np.nonzero(counted)[0], 0]
    assert all(k >= min(5, p - first[p]) for k, p in zip(context, place[counted]))


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(docs):
    c = Counter()
    for d, t in docs:
        if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2:
            c.update(words_of(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    found = {}
    for k, (d, t) in enumerate(docs):
        w = [*words_of(t), None]
        found[k] = (zlib.crc32(str("" if d is None else d).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    return found


def test_base_and_edge_cases(spark, tokens):
    docs = [(i, " ".join(f"Word{(i * j) % 37} the" for j in range(i % 60))) for i in range(120)]
    docs += [(None, "the null"), (500, None), (501, ""), (502, "x" * 5000 + " the"), (7, docs[7][1]), (7, docs[7][1]), (503, "é " * 3000)]
    given = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(docs)], "doc_id long, text string, score int").repartition(3)
    want = sorted(((d, *w) for (d, _), w in zip(docs, base(docs).values())), key=str)
    for frequent in (1 << 19, 3, 0):
        got = lm_score.score_documents(given, tokens, frequent=frequent, rounds=1, share=1).collect()
        rows = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
        assert len(rows) == len(want)
        for a, b in zip(rows, want):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score.score_documents(given.limit(0), tokens).count() == 0


def test_better_than_the_base_on_held_out_documents(spark):
    got = [r for r in lm_score.op3_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(got) > 100
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_score_does_not_depend_on_the_tier(spark, tokens):
    docs = spark.createDataFrame([(i, f"alpha beta gamma{i % 3} delta") for i in range(30)], "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in lm_score.score_documents(docs, tokens, frequent=f, rounds=0).collect()} for f in (100, 0))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_a_text_with_more_words_than_the_table(tokens, monkeypatch):
    flats = [m.flat() for m in lm_score.Reader(tokens).models()]
    text = pa.array([" ".join(f"id{k}" for k in range(3000))])
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    found = []
    for bits in (16, 6):
        monkeypatch.setattr(lm_score, "WORD_BITS", bits)
        scorer = lm_score.Scorer(tokens, flats, *none, np.zeros(len(tokens) + 1, np.int64), 0, 1.0)
        words = textkit.Words(text)
        found.append(scorer.known(words, words.hashes()))
    assert (found[0][0] == found[1][0]).all() and np.allclose(found[0][1], found[1][1], atol=1e-4)


def test_every_training_document_is_learned_from(spark, tokens):
    state = spark.sparkContext.broadcast(("x", tokens))
    start = np.concatenate([m.flat() for m in lm_score.Reader(tokens).models()])
    for k in range(3):
        texts = spark.createDataFrame([(f"text {k} of some words",)], "text string")
        assert not np.array_equal(np.concatenate(lm_score.train(texts, state)), start)


def test_stretches_of_training():
    reader = lm_score.Reader([bytes([b]) for b in range(256)] + [b" a", b" b"])
    first = np.array([0, 0, 31, 32 + 31, 63 + 200])
    given, target, place, counted = reader.text_windows(np.arange(first[-1]) % 2, first, 2)
    got = sorted(place[counted].tolist())
    want, at = [], 0
    for n in np.diff(first) + 1:
        want += [at + k for k in range(n) if k // 32 % 2 == 0]
        at += n
    assert got == want


def test_training_starts_from_frequencies(tokens):
    reader = lm_score.Reader(tokens)
    times = np.zeros(reader.n_heads + 1)
    times[5], times[reader.end] = 900, 90
    model = reader.models(heads=times)[0]
    logs = model.score(np.zeros((1, 32), np.int64) + 3, np.array([[5, reader.end] * 16]), np.ones((1, 32), bool))
    assert -1.2 < logs[::2].mean() < -0.5 and -4 < logs[1::2].mean() < -2.3


def test_scores_from_the_parameters(spark, tokens):
    docs = [(k, " ".join(f"wor{(k * j) % 11}d the" for j in range(k * 7 % 90))) for k in range(40)] + [(99, None), (100, "漢字 " * 50), (None, "the the")]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score_documents(given, tokens, frequent=4).collect()}
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    state = spark.sparkContext.broadcast(("y", tokens))
    reader = lm_score.Reader(tokens)
    head = lambda w: int(reader.head_of[reader.merger.encode([b" " + w.encode()])[1][0]])
    counts, ends = Counter(w for d, t in docs if not held(d) for w in words_of(t)), sum(not held(d) for d, _ in docs)
    of_head = Counter()
    for w, n in counts.items():
        of_head[head(w)] += n
    times = np.array([*(of_head[h] for h in range(reader.n_heads)), ends])
    flats = lm_score.train(given.where(~lm_score.held_out(F.col("doc_id"))).select("text"), state, heads=times)
    first, rest = (m.load(f) for m, f in zip(reader.models(), flats))
    size = sum(counts.values()) + ends + len(counts) + (ends > 0) + 1
    for d, t in docs:
        words, total = words_of(t), 0.0
        heads = [head(w) for w in words]
        sequence, targets = [reader.end, *heads], [*heads, reader.end]
        for k, target in enumerate(targets):
            begin = 0 if k < lm_score.WIDTH else (k - lm_score.WIDTH) // lm_score.STRIDE * lm_score.STRIDE + lm_score.STRIDE
            x = np.array([sequence[begin : k + 1]])
            last = np.zeros(x.shape, bool)
            last[0, -1] = True
            p = math.exp(first.score(x, np.full(x.shape, target), last)[0])
            if k == len(words):
                total += math.log10(lm_score.LAMBDA * p + (1 - lm_score.LAMBDA) * (ends + 1) / size)
                continue
            ids = reader.merger.encode([b" " + words[k].encode()])[1]
            inner = lm_score._scores(rest, *reader.word_windows(np.array([len(ids)]), ids)).sum()
            c = counts[words[k]]
            p *= lm_score.WITHIN * math.exp(inner) + (1 - lm_score.WITHIN) * c / max(1, of_head[heads[k]])
            total += math.log10(lm_score.LAMBDA * p + (1 - lm_score.LAMBDA) * (c + 1) / size)
        assert abs(total - got[d]) < 2e-3 * max(1, abs(total)), d


def test_every_place_of_a_text_is_trained_on(tokens, monkeypatch):
    class Given:
        def __init__(self, value):
            self.value = value

    reader, seen, gradients = lm_score.Reader(tokens), [], Model.gradients
    monkeypatch.setattr(Model, "gradients", lambda self, x, target, counted: seen.append((self.width, int(counted.sum()))) or gradients(self, x, target, counted))
    words = [f"word{k}" for k in range(300)]
    texts = pa.array([" ".join(words), "", None, " ".join(words[:33])])
    flats = [m.flat() for m in reader.models()]
    list(lm_score._trainer(Given(("x", tokens)), Given((*flats, 0)))(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    assert sum(n for width, n in seen if width == lm_score.WIDTH) == 301 + 1 + 1 + 34
    counts, _ = reader.merger.encode([b" " + w.encode() for w in words])
    assert sum(n for width, n in seen if width == lm_score.WORD_WIDTH) == counts.sum()
