import random

import numpy as np
import pyarrow as pa

from envsense.llm import decontamination as D


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_plain_python():
    r = random.Random(1)
    pairs = [([r.randrange(1, 6) for _ in range(r.randrange(1, 12))], [r.randrange(1, 6) for _ in range(r.randrange(1, 20))]) for _ in range(60)]
    pad = lambda rows: np.array([x + [0] * (20 - len(x)) for x in rows], np.uint64)
    a, b = zip(*pairs)
    got = D.align(pad(a), np.array([len(x) for x in a]), pad(b), np.array([len(x) for x in b]))
    assert got.tolist() == [smith_waterman(x, y) for x, y in pairs]


def brute(docs, items):
    clean = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    found = set()
    for d, t in docs:
        for i, s in items:
            x, y = clean(s), clean(t)
            if i is not None and len(x) >= 4 and (best := smith_waterman(x, y)) >= len(x) and best >= 2 * min(len(x), 8):
                found.add((d, i, round(best / 2 / len(x), 6)))
    return found


def test_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioutnsr") for _ in range(r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randrange(10, 50))) for i in range(20)] + [(20, "too short"), (None, text(20)), (21, None), (22, text(5))]
    docs = [(d, text(r.randrange(0, 200))) for d in range(60)] + [(100, None), (101, ""), (None, f"{text(9)} {items[0][1]} {text(5)}")]
    docs += [(200 + k, f"{text(60)}\n{items[k][1].upper()}, {text(80)}") for k in range(20)]
    docs.append((250, f"{text(3000)} {items[5][1]} {text(9)} {items[6][1]} {items[5][1]}"))
    docs.append((250, docs[-1][1]))
    docs.append((260, f"{text(5)} {items[22 + 1][1]} {text(5)}"))
    for k in range(20):  # every seventh word replaced, one dropped
        w = items[k][1].split()
        w = [word() if j % 7 == 3 else x for j, x in enumerate(w) if j != 9]
        docs.append((300 + k, f"{text(20)} {' '.join(w)} {text(20)}"))
    given = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 40
    for size in (D.BLOCK_BYTES, 900):
        got = D.leaks(given, benchmark, block_bytes=size).collect()
        assert {(x.doc_id, x.item_id, round(x.score, 6)) for x in got} == want
    assert len(got) == len(want) + 2  # the repeated row
    kept = D.without_leaks(given, benchmark, block_bytes=900)
    held = {d for d, _, _ in want}
    assert kept.columns == given.columns and sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in held)
    assert D.leaks(given.limit(0), benchmark).count() == 0 and D.leaks(given, benchmark.limit(0)).count() == 0


def test_leaked_everywhere_still_has_seeds():
    items = D.index_items([1], ["a b c d e f g h i j k l"], 4)
    chosen = D.choose_seeds(items, np.full(len(items.grams), 10**6))
    assert len(chosen.grams) == 9
    common = D.choose_seeds(items, np.where(np.arange(9) < 2, 10**6, 3))
    assert len(common.grams) == 8  # seven are rare, eight are the least
    t, i, score, _ = D.find(chosen, chosen.filter(), pa.array(["x a b c d e f g h i j k l y"]), 4)
    assert (t.tolist(), i.tolist(), score.tolist()) == ([0], [0], [24])


def test_one_edited_passage_in_hundreds_of_documents(spark):
    words = [f"w{k}" for k in range(40)]
    edited = " ".join("other" if k % 5 == 4 else x for k, x in enumerate(words))
    docs = spark.createDataFrame([(d, f"before{d} {edited} after{d}") for d in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted(r.doc_id for r in D.leaks(docs, items).collect()) == list(range(300))
    assert D.without_leaks(docs, items).count() == 0


def test_edits_that_leave_no_long_run(spark):
    r = random.Random(4)
    words = [[f"w{i}x{k}" for k in range(n)] for i, n in enumerate((9, 16, 17, 30, 31, 45))]
    edits = [
        lambda w: ["new" if k % 4 == 3 else x for k, x in enumerate(w)],
        lambda w: ["new" if k % 3 == 2 else x for k, x in enumerate(w)],
        lambda w: [y for k, x in enumerate(w) for y in (["new", x] if k else [x])],  # a word between each two
        lambda w: [x for k, x in enumerate(w) if k % 4],
        lambda w: [y for x in w if r.random() > 0.15 for y in ([x, "new"] if r.random() < 0.3 else [x])],
    ]
    filler = lambda n: [f"f{r.randrange(50)}" for _ in range(n)]
    docs = [(10 * i + k, " ".join(filler(20) + edit(w) + filler(40))) for i, w in enumerate(words) for k, edit in enumerate(edits)]
    items = [(i, " ".join(w)) for i, w in enumerate(words)] + [(90, "one two three"), (91, "only")]
    docs += [(100, "x one, two three y"), (101, "one two and three"), (102, "the only one"), (103, "lonely")]
    clean = [(i, s.split()) for i, s in items]
    want = set()
    for d, t in docs:
        for i, w in clean:
            best = smith_waterman(w, t.replace(",", "").split())
            if best >= max(len(w), 2 * min(len(w), 8)):
                want.add((d, i, round(best / 2 / len(w), 6)))
    assert len(want) > 20 and {(100, 90, 1.0), (102, 91, 1.0)} < want
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, round(x.score, 6)) for x in got} == want


def test_rare_seeds_miss_nothing():
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 2, 5, 8, 9, 12, 17, 30, 41, 60) for _ in range(3)]
    items = D.index_items(list(range(len(texts))), texts, 2)
    few = D.rare_seeds(items, np.array([r.randrange(100) for _ in range(1 << 10)]))
    assert len(few.rare) < len(items.grams) and set(few.rare.tolist()) <= set(items.grams.tolist())
    edited = []
    for _ in range(300):
        w = r.choice(texts).split()
        w = [y for x in w if r.random() > 0.15 for y in (["new"] if r.random() < 0.2 else [x, "more"] if r.random() < 0.2 else [x])]
        edited.append(" ".join(["before", *w, "after"]))
    every, some = (sorted(zip(*(x.tolist() for x in D.find(i, i.filter(), pa.array(edited), 2)[:3]))) for i in (items, few))
    passing = lambda found: [x for x in found if x[2] >= len(texts[x[1]].split()) and x[2] >= 2 * min(len(texts[x[1]].split()), 8)]
    assert passing(every) == passing(some) and len(passing(some)) > 100


def test_counts_of_pairs(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c", "a b", None, "", "b x c a b"])], "doc_id long, text string").repartition(2)
    items = D.index_items([1], ["a b c d"], 2)
    counts = D.pair_counts(docs, "text", spark.sparkContext.broadcast(items))
    slot = lambda a, b: int(D._pairs(D.textkit.Words(pa.array([f"{a} {b}"])).hashes(), np.array([0, 2]), 1)[0][0] >> np.uint64(46))
    assert counts[slot("a", "b")] == 3 and counts[slot("b", "c")] == 2 and counts[slot("a", "c")] == 1 and counts[slot("c", "d")] == 0
