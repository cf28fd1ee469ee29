import random

from envsense.llm import components as module
from envsense.llm.common import cut
from envsense.llm.components import components


def test_against_union_find(spark):
    random.seed(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(70)] + [(5, 5), (None, 3), (-9, 260)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    cuts, ids = [], list(range(400))
    random.Random(2).shuffle(ids)
    monkeypatch.setattr(module, "cut", lambda df, small=False: cuts.append(1) or cut(df, small))
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in ids}
    assert len(cuts) < 16


def test_few_links_take_few_tasks_whatever_the_partitions(spark, monkeypatch):
    """pipeline: each task leaves files and log entries, so rounds over few ids must not run one for each partition of a shuffle."""
    tasks = []

    def counted(df, small=False):
        made = cut(df, small)
        tasks.append(made.rdd.getNumPartitions())
        return made

    monkeypatch.setattr(module, "cut", counted)
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        links = spark.range(1, 3000).selectExpr("id as a", "id - id % 10 as b").repartition(3)
        assert {tuple(r) for r in components(links).collect()} == {(i, max(1, i - i % 10) if i >= 10 else 0) for i in range(3000)}
        assert max(tasks[1:]) == 1 and tasks[0] <= 6
        monkeypatch.setattr(module, "FEW", 100)  # more than few: as many as before, same result
        assert components(links).where("root % 10 = 0").count() == 3000
        assert max(tasks) == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_links_between_groups_of_before(spark, monkeypatch):
    links = spark.createDataFrame([(k, k - k % 4) for k in range(40) if k % 4], "a long, b long")
    more = spark.createDataFrame([(3, 41), (5, 9), (39, 2), (50, 51)], "a long, b long")
    want = {(r.id, r.root) for r in components(links.union(more)).collect()}
    for few in (200_000, 0):
        monkeypatch.setattr(module, "FEW", few)
        assert {(r.id, r.root) for r in module.extended(components(links), more).collect()} == want
