"""Operator 13 against plain Python in big integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from envsense.llm import divergence as D
from envsense.llm.textkit import Words

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "text string, lang string, source string"


def terms(text):
    return [t.decode() for t in TERM.findall((text or "").encode().translate(LOWER))]


def brute(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: [counts[lang, s][t] for t in kept] for s in sources}
        of[None] = [sum(of[s][k] for s in sources) for k in range(len(kept))]
        p = {s: [1 + 10**9 * (c + 1) // (sum(n) + len(kept)) for c in n] for s, n in of.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o) for o in sources - {s}]
            high = [(-f(a, b), t) for t, c, a, b in zip(kept, of[s], p[s], p[None]) if c and a > b]
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(high, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, i, -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["Über", "über", "été", "naïve x", "THE", "the", "cat's", "a1b", "\U0001f600", "x" * 40, "y" * 31 + "é", "d", "longer-hyphenated-compound", "ABCDEFGH", "abcdefghi"]
    words += [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    made = lambda: (" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "É"]))
    return [made() for _ in range(n)] + [(None, "xx", "s1"), ("", "xx", "s2"), ("only here", "yy", "s"), (None, None, None)]


def test_against_plain_python(spark):
    rows = corpus(150)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(D.divergences(docs)) == brute(rows)
    assert rows_of(D.divergences(docs, least_docs=1, top=4, block=20)) == brute(rows, 1, 4)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, "z", 1) for r in corpus(20)], SCHEMA + ", term string, n int")
    assert rows_of(D.divergences(docs)) == brute(corpus(20))
    assert D.divergences(docs.limit(0)).count() == 0


def test_xxhash_is_the_librarys():
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(k)) for k in [*range(70), 500]]
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    assert D.xxhashes(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(t) for t in texts]


def test_slices_with_one_hash_are_told_apart():
    words = Words(pa.array(["abc abd abcdefghij abcdefghik abc abcdefghij", "abd zz"]))
    names = [words.word(k) for k in range(len(words.starts))]
    for hashes in (np.zeros(len(names), np.uint64), np.array([len(n) for n in names], np.uint64)):
        first, group = D.grouped(words.data, words.starts, words.ends, hashes)
        assert [names[f] for f in first[group]] == names and len(first) == len(set(names))


def test_shares_are_exact():
    counts, total = [0, 1, 7, 999_999_937, 2**52], 2**53 - 111
    assert D.share(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_pair_sums_of_a_sparse_matrix():
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 4, (5, 30)) * rng.integers(1, 10**8, (5, 30))
    dense[2] = 0
    rare = rng.integers(1, 50, 5)
    row, term = np.nonzero(dense)
    full = np.where(dense > 0, dense, rare[:, None])
    want = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(full[s], full[q])) for q in range(5)] for s in range(5)]
    assert D.pair_sums(row, term, dense[row, term], rare, 30).tolist() == want
