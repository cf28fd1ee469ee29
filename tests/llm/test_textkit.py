import re

import pyarrow as pa

from envsense.llm import textkit


def test_words_and_shingles_match_plain_python():
    texts = ["", None, "One two\tTHREE\x0bfour\r\nfive six", "a b", "ß é\x85x verylongwordindeed-" * 3 + " q", "   ", "no", "one TWO three four five", "x" * 1000 + "A y"]
    both = pa.array(["skip this", *texts]).slice(1)
    w = textkit.Words(both)
    plain = [[x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for t in texts]
    assert [[w.word(k) for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))] == plain
    h = w.hashes()
    by = {}
    for k, x in enumerate(x for p in plain for x in p):
        assert by.setdefault(x, h[k]) == h[k]
    assert len(set(by.values())) == len(by)
    s, bounds = textkit.shingles(w, 5)
    seen = {}
    for d, p in enumerate(plain):
        grams = [tuple(p[i : i + 5]) for i in range(len(p) - 4)] or ([tuple(p)] if p else [])
        got = s[bounds[d] : bounds[d + 1]]
        assert len(got) == len(grams)
        for g, x in zip(grams, got):
            assert seen.setdefault(g, x) == x
    assert len(set(seen.values())) == len(seen)
