"""Folds over a key's ordered samples, and the same as parallel scans for keys that are too long for one task.

A scan sorts the samples into ranges and cuts each key into chunks of consecutive samples, wherever its ranges
lie. The steps of a recursion are elements of an associative operation: a chunk is reduced to one element, the
elements of a key are scanned (in groups, level by level, where they are many) for what comes before each chunk, and
each chunk is then folded from there. No task has more than a chunk's samples or ``FAN`` elements of a key at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions.columns import let
from ..shared import cut

#: Samples that are folded before their rows are appended to the result.
CHUNK = 256
#: Samples of a chunk of a scan, elements that are scanned together, samples of a key that is split.
SPLIT, FAN, LONG = 4096, 4096, 1 << 17


def fold(samples: Column, state_type: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Array of the states after each sample; ``step(state, sample)`` gives a struct of ``state_type``.

    Samples are folded in chunks of 256: within a chunk rows are appended to a small array, and the
    chunks are flattened once, so a key of n samples costs n times a chunk at most, not n squared.
    """
    rows = f"array<{state_type}>"

    def one(acc, x):
        return let(step(acc["state"], x), lambda s: F.struct(s.alias("state"), F.concat(acc["rows"], F.array(s)).alias("rows")))

    def chunk(acc, c):
        part = F.aggregate(F.slice(samples, c * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), F.array().cast(rows).alias("rows")), one)
        return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["done"], F.array(p["rows"])).alias("done")))

    first = F.struct(start.cast(state_type).alias("state"), F.array().cast(f"array<{rows}>").alias("done"))
    chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(samples), F.lit(1)) - 1) / CHUNK).cast("int"))
    return F.flatten(F.aggregate(chunks, first, chunk)["done"])


@dataclass(frozen=True)
class Scan:
    """An associative operation on structs of type ``kind``, whose field n counts samples and is 0 in ``unit`` alone."""

    kind: str
    unit: Column
    combine: Callable[[Column, Column], Column]


def is_long(rows: DataFrame, keys: list[str], most: int = LONG) -> bool:
    """Whether a key has more samples than one task should fold."""
    return (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > most


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by keys to as many tasks as shuffles have: folds take long for the bytes they read, by which adaptive plans would merge tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def chunked(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], size: int = SPLIT) -> DataFrame:
    """keys, block_, samples: stretches of up to ``size`` consecutive samples (structs of order and values) of a key.

    Blocks are numbered in the order of keys and samples, with gaps. A key may have stretches in any number of tasks.
    """
    flat = rows.select(*keys, *order, *(c.alias(k) for k, c in values.items()))
    ranges = flat.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order, *values)
    blocks = ranges.withColumn("block_", F.floor(F.monotonically_increasing_id() / size))
    return cut(together(blocks, *keys, "block_").groupBy(*keys, "block_").agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("samples")))


def reduced(samples: Column, scan: Scan, later: Callable[[Column], Column], first: Callable[[Column], Column] | None = None) -> Column:
    """struct of ``first`` and ``later``: the samples' elements combined, if the key begins with them and if it does not."""
    rest = F.aggregate(F.slice(samples, F.lit(2), F.size(samples)), scan.unit, lambda a, s: scan.combine(a, later(s)).cast(scan.kind))
    head = F.get(samples, F.lit(0))
    whole = lambda r: F.struct(scan.combine((first or later)(head), r).cast(scan.kind).alias("first"), scan.combine(later(head), r).cast(scan.kind).alias("later"))
    return let(rest, whole)


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    """Equal keys, nulls among them, of two aliases."""
    return F.expr(" AND ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in keys))


def prefixes(parts: DataFrame, keys: list[str], scan: Scan, fan: int = FAN) -> DataFrame:
    """keys, block_, before: what the key's parts in earlier blocks come to. parts: keys, block_, part (see ``reduced``)."""
    item = F.array_sort(F.collect_list(F.struct("block_", "part"))).alias("parts")
    if not is_long(parts, keys, fan):
        groups = parts.groupBy(*keys).agg(item).withColumn("start", scan.unit)
    else:
        lists = cut(parts.groupBy(*keys, F.floor(F.col("block_") / fan).alias("block_")).agg(item))
        above = lists.select(*keys, "block_", reduced(F.col("parts"), scan, lambda p: p["part"]["later"], lambda p: p["part"]["first"]).alias("part"))
        starts = prefixes(cut(above), keys, scan, fan)
        groups = lists.alias("x").join(starts.alias("y"), same_keys("x", "y", [*keys, "block_"])).select(*(F.col(f"x.{k}") for k in keys), "x.parts", F.col("y.before").alias("start"))
    step = lambda s, p: F.when(s["n"] == 0, p["part"]["first"]).otherwise(scan.combine(s, p["part"]["later"]).cast(scan.kind))
    after = fold(F.col("parts"), scan.kind, F.col("start"), step)
    each = groups.select(*keys, F.explode(F.arrays_zip(F.col("parts").alias("p"), F.concat(F.array(F.col("start").cast(scan.kind)), after).alias("s"))).alias("e"))
    return cut(each.where("e.p is not null").select(*keys, F.col("e.p.block_").alias("block_"), F.col("e.s").alias("before")))


def with_prefixes(chunks: DataFrame, keys: list[str], scan: Scan, part: Column, fan: int = FAN) -> DataFrame:
    """The chunks with ``before``, what the key's earlier chunks come to (the unit for its first). part: see ``reduced``."""
    starts = prefixes(cut(chunks.select(*keys, "block_", part.alias("part"))), keys, scan, fan)
    return chunks.alias("x").join(starts.alias("y"), same_keys("x", "y", [*keys, "block_"])).select("x.*", "y.before")


def scanned(chunks: DataFrame, keys: list[str], scan: Scan, later: Callable[[Column], Column], first: Callable[[Column], Column] | None = None, fan: int = FAN) -> DataFrame:
    """The chunks with ``before``, what the key's earlier samples come to by their elements."""
    return with_prefixes(chunks, keys, scan, reduced(F.col("samples"), scan, later, first), fan)


def gaussian(axes: int) -> Scan:
    """Steps of ``axes`` filters of one constant state each, which share their gains (the associative form of filtering).

    An element takes a mean b and variance c before to those after: with a = 0 it holds mean and variance themselves.
    """
    names = range(axes)
    kind = "struct<n:bigint,a:double,c:double,j:double," + ",".join(f"b{k}:double,e{k}:double" for k in names) + ">"
    unit = F.struct(F.lit(0).alias("n"), F.lit(1.0).alias("a"), F.lit(0.0).alias("c"), F.lit(0.0).alias("j"), *(F.lit(0.0).alias(f"{x}{k}") for k in names for x in "be")).cast(kind)

    def combine(x, y):
        def with_weight(w):
            return F.struct(
                (x["n"] + y["n"]).alias("n"), (y["a"] * w * x["a"]).alias("a"), (y["a"] * w * x["c"] * y["a"] + y["c"]).alias("c"), (x["a"] * w * y["j"] * x["a"] + x["j"]).alias("j"),
                *(c for k in names for c in ((y["a"] * w * (x[f"b{k}"] + x["c"] * y[f"e{k}"]) + y[f"b{k}"]).alias(f"b{k}"), (x["a"] * w * (y[f"e{k}"] - y["j"] * x[f"b{k}"]) + x[f"e{k}"]).alias(f"e{k}"))),
            )

        return let(1 / (1 + x["c"] * y["j"]), with_weight)

    return Scan(kind, unit, combine)


def gaussian_step(zs: list[Column], q: float, r: Column) -> Column:
    """The element of an ordinary sample: a random walk of variance q, measured with variance r."""
    s = r + F.lit(q)
    return F.struct(F.lit(1).cast("long").alias("n"), (r / s).alias("a"), (r * F.lit(q) / s).alias("c"), (1 / s).alias("j"), *(c for k, z in enumerate(zs) for c in ((F.lit(q) / s * z).alias(f"b{k}"), (z / s).alias(f"e{k}"))))


def gaussian_first(zs: list[Column], p: float) -> Column:
    """The element of a key's first sample, which is the state as it is, with variance p."""
    return F.struct(F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("a"), F.lit(p).alias("c"), F.lit(0.0).alias("j"), *(c for k, z in enumerate(zs) for c in (z.alias(f"b{k}"), F.lit(0.0).alias(f"e{k}"))))


def counts() -> Scan:
    """Samples."""
    return Scan("struct<n:bigint>", F.struct(F.lit(0).cast("long").alias("n")), lambda x, y: F.struct((x["n"] + y["n"]).alias("n")))


def matrix_affine(n: int) -> Scan:
    """Maps x -> a x + b of vectors of n values."""
    kind = "struct<n:bigint,a:array<array<double>>,b:array<double>>"
    unit = F.struct(F.lit(0).cast("long").alias("n"), M.literal(M.identity(n)).alias("a"), F.array(*[F.lit(0.0)] * n).alias("b"))
    return Scan(kind, unit, lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), M.product(y["a"], x["a"], n).alias("a"), M.added(M.apply(y["a"], x["b"]), y["b"]).alias("b")))


def affine() -> Scan:
    """Maps r -> a r + c; later ones on the right."""
    kind = "struct<n:bigint,a:double,c:double>"
    unit = F.struct(F.lit(0).alias("n"), F.lit(1.0).alias("a"), F.lit(0.0).alias("c")).cast(kind)
    return Scan(kind, unit, lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), (x["a"] * y["a"]).alias("a"), (x["c"] * y["a"] + y["c"]).alias("c")))


def last_values(most: int) -> Scan:
    """The last ``most`` values."""
    kind = "struct<n:bigint,tail:array<double>>"
    unit = F.struct(F.lit(0).alias("n"), F.array().cast("array<double>").alias("tail")).cast(kind)
    last = lambda v: F.slice(v, F.greatest(F.size(v) - most, F.lit(0)) + 1, F.lit(most))
    return Scan(kind, unit, lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), let(F.concat(x["tail"], y["tail"]), last).alias("tail")))
