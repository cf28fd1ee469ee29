"""Helpers that the operators of this folder share: table access, the shared folder, checkpoints."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the directory with the public vocabulary files when the package is not importable.
TOKENIZER_DIR = "/opt/tokenizers"
#: Seconds between two collections of garbage that ``cut`` asks for at least, and when the last one was.
COLLECT_EVERY = 10
_COLLECTED = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZER_DIR}/{name}"
    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset a temporary folder is made and
    set as the checkpoint directory, but only on one machine (a local master): elsewhere that is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="envsense-checkpoint-"))
    return sc.getCheckpointDir()


def new_dir(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/envsense-{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    small: rows that are few against the tables they come from; they are dealt anew, to as many partitions as
    their bytes are worth, so that what reads them runs few tasks, and many where they are many after all.
    """
    shared_dir(df.sparkSession)
    made = (df.hint("rebalance") if small else df).checkpoint(eager=True)
    release(df.sparkSession)
    return made


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and checkpoints of plans that are done with.

    Its cleaner does so when the driver's JVM has collected their objects, by default every half an hour;
    an operator of many short steps would keep all of them on disk, and the driver's heap would grow, until then.
    """
    if time.monotonic() - _COLLECTED[0] > COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()


def free_name(df_or_columns, wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name (case ignored, as Spark does)."""
    columns = df_or_columns.columns if isinstance(df_or_columns, DataFrame) else df_or_columns
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def column(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value, f):
    """f(value) with ``value`` bound to a lambda variable: it is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bound(value, kind: str, f):
    """``let`` for functions that run very often, with the type of f(value).

    ``get`` asks for the type of what ``let`` gives it, which Spark works out anew from all of f for each row; ``aggregate`` doesn't.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: f(x))


def numbered(df: DataFrame, copies: str, name: str, chunk: int = 100_000) -> DataFrame:
    """Each row as many times as its column ``copies`` says, numbered from 0 in ``name``; many copies are dealt to several tasks."""
    last = F.floor((F.col(copies) - 1) / chunk)
    parts = df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(F.col(name), F.col(copies))
    return parts.withColumn(name, F.explode(F.sequence(F.col(name) * chunk, F.least(F.col(copies), (F.col(name) + 1) * chunk) - 1)))


#: Rows of a few columns that are broadcast at most.
FEW = 200_000


def joined_few(rows: DataFrame, few: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined to ``few`` by keys, without a task that gets all rows of a frequent key.

    few must be cut, with distinct keys, and its column ``n`` counts the rows of a key, or bounds them. Up to FEW
    rows of it are broadcast. Beyond that, keys with a thousandth of its counts or more, a thousand at most, are broadcast,
    and the others are dealt out with the rows that have other keys.
    """
    size, total = few.agg(F.count("*"), F.sum(n)).first()
    if size <= FEW:
        return rows.join(F.broadcast(few), keys)
    hot = F.broadcast(few.where(F.col(n) * 1000 >= total))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(few.where(F.col(n) * 1000 < total), keys))
