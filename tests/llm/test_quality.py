import re
from collections import Counter, defaultdict

import pytest

from envsense.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return re.sub(r"[ \t\x0b-\r]+", " ", line.translate(str.maketrans(quality.UPPER, quality.LOWER))).strip(" ")


def brute(rows, min_docs, max_share):
    held, size = defaultdict(set), Counter()
    for _, text, host in rows:
        size[host or ""] += 1
        for line in (text or "").split("\n"):
            if norm(line):
                held[host or "", norm(line)].add(text)
    found = []
    for i, text, host in rows:
        t, host = text or "", host or ""
        words = W.findall(t)
        tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if W.search(x)]
        removed = sum(len(W.findall(x)) for x in lines if (k := len(held[host, norm(x)])) > min_docs and k > max_share * size[host])
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        found.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, removed, not failed and 2 * (len(words) - removed) >= len(words)))
    return sorted(found, key=str)


@pytest.mark.parametrize("min_docs,max_share", [(2, 0.3), (0, 0.0), (100, 0.5)])
def test_against_brute_force(spark, min_docs, max_share):
    own = [" ".join(f"w{i}x{k}" for k in range(52)) for i in range(12)]
    rows = [(i, f"{own[i]}\nCookie  Notice #1\n\n cookie notice #1\t\n{'long ' + ' '.join(f'b{j}' for j in range(60 if i % 2 else 3))}", "h" if i < 8 else None) for i in range(12)]
    rows += [(0, rows[0][1], "h"), (3, None, "h"), (None, "", None), (5, "a b c a b c a b", "h"), (5, "a b c a b c a b", "h"), (6, "x y z " * 3000, "k"), (7, "\x0b\x0c\r\n \n", "k"), (8, "Ü ü a\x85b c", "k"), (9, "p q p q p q", "k")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    got = sorted((tuple(r) for r in quality.quality(docs, min_docs=min_docs, max_share=max_share).collect()), key=str)
    assert got == brute(rows, min_docs, max_share)
    assert quality.quality(docs.limit(0)).count() == 0


def test_frequent_lines_are_removed(spark):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(70))
    docs = [(k, f"Share  THIS page now\n{own(k)}\nshare this page now", "a", k) for k in range(6)] + [(9, f"share this page now\n{own(9)}", "b", 9)]
    docs += [(20, None, "a", 1), (21, "", "a", 1), (7, f"{own(7)}\n\n  x", None, 1), (0, docs[0][1], "a", 0), (None, f"{own(30)}\nshare this page now", "a", 2)]
    given = spark.createDataFrame(docs, "doc_id long, text string, source string, good_row int").repartition(3)
    out = quality.cleaned_documents(given, min_docs=3, max_share=0.0)
    assert out.dtypes == given.dtypes
    want = [(k, own(k), "a", k) for k in range(6)] + [docs[6], docs[9], (0, own(0), "a", 0), (None, own(30), "a", 2)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert quality.cleaned_documents(given.limit(0)).count() == 0
