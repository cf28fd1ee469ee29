"""Connected components of links between 64-bit ids, by distributed union-find.

Each round gives every id, and the id that its label names, the smallest label among its neighbours (union:
whole trees are hooked, so a long path takes a logarithm of its length in rounds), then the label of its label
(find with path halving). Links and labels stay in DataFrames; each round is cut with a checkpoint. Minima
are taken before the shuffle, so an id with very many links costs one row a task. Where links and labels are few
they are kept in as many partitions as their rows are worth and labels are broadcast, so a round runs few tasks
however many partitions a shuffle has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut

#: Rows, where they are few, for which a task is run.
TASK_ROWS = 50_000


def _few(rows: int):
    """What broadcasts a side of a join, and what keeps rows in few partitions, if so many ``rows`` are few; else both change nothing."""
    if rows > FEW:
        return (lambda df: df), (lambda df: df)
    return F.broadcast, lambda df: df.coalesce(max(1, -(-rows // TASK_ROWS)))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root (the smallest id reachable) for every id in a link. Nulls and loops are ignored; no link, no row."""
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    both = cut(pairs.union(pairs.select("b", "a")).toDF("id", "other"))
    held, dense = _few(both.count())
    both = dense(both)
    labels = cut(dense(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("root"))))
    while True:
        heard = both.join(held(labels.select(F.col("id").alias("other"), "root")), "other").groupBy("id").agg(F.min("root").alias("near"))
        joined = dense(heard).join(held(labels), "id").select("id", F.col("root").alias("old"), "near")
        own = F.struct("id", "old", F.least("old", "near").alias("root"))
        hook = F.struct(F.col("old").alias("id"), F.lit(None).cast("long").alias("old"), F.col("near").alias("root"))
        hooked = dense(joined.select(F.explode(F.array(own, hook)).alias("x")).groupBy("x.id").agg(F.max("x.old").alias("old"), F.min("x.root").alias("root")))
        top = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = cut(hooked.join(held(top), "root").select("id", "old", F.least("root", "top").alias("root")))
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("id", "root")
        if not changed:
            return labels


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (what ``components`` gave for other links) after further links (a, b): only the components that these join are worked on."""
    held, _ = _few(roots.count())
    a, b = (held(roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(ends)
    moves, _ = _few(joined.count())
    moved = roots.join(moves(joined.toDF("root", "to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return cut(moved.union(joined.join(held(roots.select("id")), "id", "left_anti")), small=True)
