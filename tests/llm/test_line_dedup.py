import random
import re

from pyspark.sql import functions as F

from envsense.llm import line_dedup as L


def norm(line):
    return re.sub(r"[ \t\r]+", " ", line.lower()).strip(" ")


def shingle_set(n):
    return {n[k : k + 20] for k in range(0, len(n) - 19, 2)} if isinstance(n, bytes) else shingle_set(n.encode("utf-16-be"))


def brute(docs):
    """Of each component of lines, over all pairs: its first document, and its places with their lines."""
    at = {}
    for d, t in docs:
        for place, line in enumerate((t or "").split("\n")):
            if len(norm(line)) >= 40:
                at.setdefault(norm(line), set()).add((L._LAST if d is None else d, place))
    names = list(at)
    sets = [shingle_set(n) for n in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and k >= 0.8 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(names)):
        groups.setdefault(find(i), []).append(names[i])
    for members in groups.values():
        places = {(d, p): n for n in members for d, p in at[n]}
        yield min(d for d, _ in places), places


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    line = lambda n=20: " ".join(word() for _ in range(n))
    base = [line() for _ in range(12)]
    docs = []
    for d in range(40):
        lines = [line(r.randrange(1, 30)) for _ in range(3)] + r.sample(base, 2)
        w = r.choice(base).split()
        w[r.randrange(len(w))] = word()  # a near copy
        lines.append("  ".join(w).upper())
        lines += [base[0], "short line", "short line", ""]
        r.shuffle(lines)
        docs.append((d, "\n".join(lines)))
    long = "x" * 3000 + "".join(r.choice("abc") for _ in range(3000))
    docs += [(50, long), (51, long + "d"), (52, "x" * 60), (53, "x" * 59 + " y"), (None, base[1]), (None, base[1]), (7, docs[7][1]), (60, None), (61, ""), (62, "漢字" * 40)]
    return docs


def test_against_all_pairs(spark):
    docs = corpus()
    given = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, n_removed int, gone_doc string").repartition(3)
    gone = {r.doc: set(r.places) for r in L.removed_lines(given)[1].collect()}
    groups = list(brute(docs))
    assert len(groups) > 50
    for first, places in groups:
        stays = [(d, p) for d, p in places if p not in gone.get(d, ())]
        assert len(stays) == 1 and stays[0][0] == first
        assert stays[0][1] == min(p for d, p in places if d == first and places[d, p] == places[stays[0]])
    out = L.dedup_lines(given)
    assert out.columns == ["doc_id", "text", "n_removed", "gone_doc", "_n_removed"]
    rows = out.collect()
    assert len(rows) == len(docs)
    texts = {d: t for d, t in docs}
    for r in rows:
        t, places = texts[r.doc_id], gone.get(L._LAST if r.doc_id is None else r.doc_id, set())
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in places)
        assert r.text == want and r._n_removed == len(places)
    assert L.dedup_lines(given.limit(0)).count() == 0


def test_shingles(spark):
    for text in ("a bc def", "abcdefghijklmnop qr", "x" * 25, "é ü" * 9, "a\u0085b\u2028c\u2029" * 4, "one 😀 two 😀 three", ""):
        got = spark.range(1).select(L.shingle_set(F.lit(text)).alias("s")).first().s
        assert len(got) == len(shingle_set(text)) and len(set(got)) == len(got)


def test_bands_meet():
    assert len(L.BANDS) == 12 and all(len({*x} & {*y}) < 2 for x in L.BANDS for y in L.BANDS if x != y)
    met = 0.0
    for k in range(1 << 9):
        same = {i for i in range(9) if k >> i & 1}
        if any(same >= {*band} for band in L.BANDS):
            met += 0.8 ** len(same) * 0.2 ** (9 - len(same))
    assert met > 0.99


def test_pairs_of_a_bucket_that_holds_several_groups(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    frame = [word() for _ in range(40)]
    docs = []
    for g in range(150):  # lines of one frame; two and two share what they put in it
        own = [word() if k % 14 == 0 else x for k, x in enumerate(frame)]
        for _ in range(2):
            docs.append((len(docs), " ".join(own)))
            own = [*own[:-1], word()]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    gone = {x.doc for x in L.removed_lines(given)[1].collect()}
    groups = list(brute(docs))
    assert 100 < len(groups) <= 150
    assert gone == {d for first, places in groups for d, _ in places if d != first}


def test_equal_short_lines(spark):
    docs = [(1, "A Short  sentence here\nyes"), (2, "x\n a short sentence here\nyes"), (3, "a short sentence there"), (4, "漢字" * 8), (5, "漢字" * 8)]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc: r.places for r in L.removed_lines(given)[1].collect()} == {2: [1], 5: [0]}
    assert L.removed_lines(given, shortest=L.MIN_CHARS)[1].count() == 0


def test_texts_under_one_id_lose_nothing_of_their_own(spark):
    a, b, c, d = (f"line number {x} with {x * 7} and more than forty characters" for x in ("alpha", "beta", "gamma", "delta"))
    docs = [(1, a), (None, f"{a}\n{b}"), (None, c), (7, a), (7, d), (7, f"{d}\n{b}"), (None, None), (7, d)]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in L.dedup_lines(given).collect()), key=repr)
    # Of rows of one id the one with the lesser hash comes first, so line d stays in one of two texts.
    left = [t.split("\n") if t else [] for _, t, _ in got]
    assert len(got) == len(docs) and {x for lines in left for x in lines} == {a, b, c, d}
    assert (None, c, 0) in got and (1, a, 0) in got and (7, "", 1) in got and (None, None, 0) in got
    kept_twice = [t for i, t, _ in got if i == 7 and t and d in t]
    assert kept_twice in ([d, d], [d], [f"{d}\n{b}"])  # rows equal in id and text are one
    assert sum(b in lines for lines in left) == 1


def test_a_pair_is_compared_in_one_of_its_buckets(spark):
    r = random.Random(8)
    norms = ["".join(r.choice("abcdefghij ") for _ in range(300))] * 30
    norms = [n[:k] + "#" + n[k:] for k, n in enumerate(norms)]  # all similar
    held = spark.createDataFrame(list(enumerate(norms)), "key long, norm string")
    shared = spark.createDataFrame([(k, b, 0, None) for k in range(30) for b in range(12)], "key long, bucket long, least long, before long")
    roots = spark.createDataFrame([(k, 0) for k in range(10)], "id long, root long")
    pairs = L.apart_pairs(shared, roots, L.sketches(held))
    want = {(a, b) for b in range(10, 30) for a in range(b)}
    got = [(x.a, x.b) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan  # nothing is made several times and dropped later


def test_few_lines_of_a_bucket_join_what_is_similar(spark, monkeypatch):
    r, made, apart = random.Random(8), [], L.apart_pairs
    base = "".join(r.choice("abcdefghij ") for _ in range(300))
    docs = []
    for k in range(150):  # similar to some of the others, by far not to all
        line = list(base)
        for at in r.sample(range(300), 2):
            line[at] = "#"
        docs.append((k, "".join(line)))

    def counted(shared, roots, known, hubs=0):
        pairs = apart(shared, roots, known, hubs)
        made.append((hubs, pairs.count()))
        return pairs

    monkeypatch.setattr(L, "apart_pairs", counted)
    monkeypatch.setattr(L, "candidate_pairs", lambda shared, known: shared.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0))
    gone = {x.doc for x in L.removed_lines(spark.createDataFrame(docs, "doc_id long, text string"))[1].collect()}
    groups = list(brute(docs))
    assert gone == {d for first, places in groups for d, _ in places if d != first}
    assert [h for h, _ in made] == [L.HUBS, 0] and made[0][1] <= 12 * L.HUBS * 150 and made[1][1] < 150


def test_the_result_keeps_only_the_removed_places(spark, capsys):
    """pipeline: what the next stage starts with on disk is one small checkpoint, not all lines and the joins of copies."""
    docs = spark.createDataFrame([(k, f"some line {k % 3} that is long enough to be compared with others\nand one more {k}") for k in range(9)], "doc_id long, text string")
    out = L.dedup_lines(docs)
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    assert out.where("n_removed > 0").count() == 6


def test_short_lines_are_compared_too(spark):
    """op9_line_dedup: near copies of 10 to 39 characters, some of a line of 40 and more."""
    r = random.Random(11)
    lines = []
    for n in [*range(10, 45)] * 4:
        line = "".join(r.choice("abcdefghij ") for _ in range(n - 2))
        lines += [f"a{line}b", f"A{line}b{r.choice('xyz')}", f"q{line}bc", f"a{line}b"]
    docs = [(k, "\n".join(lines[k::7])) for k in range(7)]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    at, root = {}, {}
    for d, t in docs:
        for place, line in enumerate(t.split("\n")):
            at.setdefault(norm(line), []).append((d, place))
    names = [n for n in at if len(n) >= 10]
    sets = {n: shingle_set(n) for n in names}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    links = [(a, b) for k, a in enumerate(names) for b in names[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for n in names:
        groups.setdefault(find(n), []).append(n)
    gone = {(x.doc, p) for x in L.removed_lines(given)[1].collect() for p in x.places}
    stays = [[p for n in members for p in at[n] if p not in gone] for members in groups.values()]
    assert sum(min(len(a), len(b)) < 40 for a, b in links) > 50 and any(len(a) < 40 <= len(b) or len(b) < 40 <= len(a) for a, b in links)
    assert all(len(left) == 1 for left in stays)
    assert all(left[0][0] == min(d for n in members for d, _ in at[n]) for members, left in zip(groups.values(), stays))
    assert {p for n in at if len(n) < 10 for p in at[n]}.isdisjoint(gone)
