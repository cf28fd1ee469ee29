"""Operator 11 against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

from envsense.llm import importance as I

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def features(text, orders=2):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return len(words), [zlib.crc32(b" ".join(words[k : k + n])) % 10_000 for n in range(1, orders + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, percent=25, least=20, orders=2):
    each = [(i, *features(t, orders)) for i, t in rows]
    s, t = Counter(b for *_, f in each for b in f), Counter(b for x in target for b in features(x, orders)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out = []
    for i, n, f in each:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        u = (int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(repr((r[0], r[2], r[3], r[4], rank.get(id(r)))) for r in out)


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


TEXTS = ["the Cat sat on THE mat " * 6, "ÉTÉ été, naïve Ünder über 12 a1b2 " * 5, "", None, "...", "\nx", "one two three", "z\x00y z\x7fy " * 20]


def test_against_plain_python(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"word{i % 11} and {i % 7} more of these " * (i % 9)) for i in range(120)]
    target = ["the cat on the mat of these words", None, "été naïve"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert rows_of(I.resampled(docs, items)) == brute(rows, target)
    assert rows_of(I.resampled(docs, items, percent=60, least_words=3, orders=3)) == brute(rows, target, 60, 3, 3)


def test_null_and_repeated_rows(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u"
    rows = [(1, long), (1, long), (1, long + " v"), (None, long), (None, long), (None, None), (4, "x " * 4000 + long)]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, weight string")
    items = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    got, want = rows_of(I.resampled(docs, items, percent=100)), brute(rows, ["b c d"], 100)
    drop_rank = lambda x: sorted(r.rsplit(",", 1)[0] for r in x)  # noqa: E731  rows with one id and score are placed by hashes
    assert drop_rank(got) == drop_rank(want)
    assert sorted(int(r.rsplit(", ", 1)[1][:-1]) for r in got if "None)" not in r) == [1, 2, 3, 4, 5, 6]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert I.resampled(docs.limit(0), items).count() == 0
    assert rows_of(I.resampled(docs, items.limit(0))) == brute([(1, "a b")], [])


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 30, i) for i in range(40)], "doc_id long, text string, score long")
    items = spark.createDataFrame([(1, "w3 w3 w3 w5")], "item_id long, text string")
    got = I.drawn(docs, items)
    assert got.columns == ["doc_id", "text", "score", "weight", "_score"]
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in I.resampled(docs, items).where("rank is not null").collect()} and got.count() == 10
