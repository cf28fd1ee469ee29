"""Operator 11: resampling towards a target distribution by importance weights of hashed n-grams.

Each text becomes a position table: ``posexplode`` gives a row for each word, ``lead`` over the document's rows
brings the words that follow, one for each order above 1, and each n-gram is hashed to a bucket. The table
is written once, with buckets for words. Its counts and those of the target give each bucket's gain, at most
``BUCKETS`` rows, which are broadcast and joined; a document's mean gain is its weight. Gumbel noise from the
id makes the highest scores a draw without replacement.

Texts are dealt out once, by row, and a text's words are never shuffled: the sums of a document leave the task
that holds its stretch of the table. Ranks come from sorted ranges of scores and the rows before each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, free_name, new_dir, table

#: Buckets of the n-grams, longest n-gram, least words of a document that may be drawn, percentage drawn, seed.
BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: What separates words: ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["id", "h1", "h2"]


def lowered(word: Column) -> Column:
    """A-Z lowered and nothing else; a word of ASCII alone takes the quick way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def position_table(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """id, h1, h2, copies, b1, b2 ...: the buckets of the n-grams that begin at each word of each distinct (id, text).

    h1 and h2 are hashes of the text, copies the number of rows with this id and text. A bucket is null where
    the text ends before its n-gram does. A text without words has one row without buckets.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = texts.select("id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    rows = rows.groupBy(*_KEY).agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    words = rows.select(*_KEY, "copies", F.posexplode(F.split("text", SEPARATORS)).alias("pos", "word"))
    words = words.withColumn("word", F.when(F.col("word") != "", lowered(F.col("word"))))
    w = Window.partitionBy(*_KEY).orderBy("pos")
    grams = words.select(*_KEY, "copies", "word", *(F.lead("word", k).over(w).alias(f"next{k}") for k in range(1, orders)))

    def bucket(n: int) -> Column:
        parts = ["word", *(f"next{k}" for k in range(1, n))]
        spaced = [x for p in parts for x in (F.lit(" "), F.col(p))][1:]
        return (F.crc32(F.concat(*spaced) if n > 1 else F.col("word")) % buckets).cast("int")

    return grams.select(*_KEY, "copies", *(bucket(n).alias(f"b{n}") for n in range(1, orders + 1)))


def bucket_counts(positions: DataFrame, orders: int = ORDERS) -> DataFrame:
    """bucket, n: how many n-grams of all rows fall into each bucket."""
    each = positions.select("copies", F.explode(F.array(*(f"b{n}" for n in range(1, orders + 1)))).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: thousandths of the log ratio of the target's add-one estimate to the source's; a row for each bucket."""
    total = lambda counts: counts.agg(F.sum("n")).first()[0] or 0
    s_all, t_all = total(source), total(target)
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(F.broadcast(source.withColumnRenamed("n", "s")), "bucket", "left").join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + F.lit(1.0)
    ratio = part("t") * F.lit(float(s_all + buckets)) / (part("s") * F.lit(float(t_all + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def floored_mean(total: Column, n: Column) -> Column:
    """total / n, rounded down, in integers; 0 for n = 0."""
    of = F.when(n > 0, n)
    return F.coalesce(F.floor((total - F.pmod(total, of)) / of), F.lit(0)).cast("long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the digest of seed and id; rounded down. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform))).cast("long")


def ranked(rows: DataFrame, order: list[Column], copies: str) -> DataFrame:
    """The rows with ``first``, 1 plus the copies before them in the order. The order must tell all rows apart.

    Rows are sorted in ranges; the counts of the ranges, a row for each, give where each of them begins.
    """
    ranges = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranges = cut(ranges)
    sizes = ranges.groupBy("part").agg(F.sum(copies).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    within = F.sum(copies).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(copies)
    return ranges.join(F.broadcast(before), "part").withColumn("first", F.col("before") + within + 1).drop("part", "before")


def scored(texts: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id, h1, h2, copies, n_words, n_features, weight, score of each distinct (id, text); ``target`` has a column text."""
    spark = texts.sparkSession
    path = new_dir(spark, "positions")
    position_table(texts, orders, buckets).write.parquet(path)
    positions = spark.read.parquet(path)
    of_target = position_table(target.select(F.lit(None).cast("long").alias("id"), "text"), orders, buckets)
    gain = cut(gains(cut(bucket_counts(positions, orders)), cut(bucket_counts(of_target, orders)), buckets))
    for n in range(1, orders + 1):
        positions = positions.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
    gained = sum((F.coalesce(F.col(f"g{n}"), F.lit(0)) for n in range(1, orders + 1)), F.lit(0).cast("long"))
    found = sum((F.col(f"b{n}").isNotNull().cast("long") for n in range(1, orders + 1)), F.lit(0).cast("long"))
    each = positions.groupBy(*_KEY, "copies").agg(F.count("b1").alias("n_words"), F.sum(found).alias("n_features"), F.sum(gained).alias("gained"))
    each = each.withColumn("weight", floored_mean(F.col("gained"), F.col("n_features")))
    return each.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).drop("gained")


def resampled(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each row of ``docs``; drawn ones have ranks 1, 2, 3 ...

    Of the documents with ``least_words`` words or more, ``percent`` hundredths (rounded down) are drawn, those of
    the highest scores; ties go to the smaller id, null ids last, then by hashes of the text. A null text has no
    words; without words the weight is 0. Rows equal in id and text are scored alike and each is drawn by
    itself. Of other columns nothing is read. An empty table gives an empty result; an empty target gives gains
    against the add-one estimate alone. Texts are read whole.
    """
    texts = docs.select(column(doc_id).cast("long").alias("id"), column(text).cast("string").alias("text"))
    rows = cut(scored(texts, target.select(column(target_text).cast("string").alias("text")), orders, buckets, seed))
    able = rows.where(F.col("n_words") >= least_words)
    draw = (able.agg(F.sum("copies")).first()[0] or 0) * percent // 100
    out = ["id", "copies", "n_features", "weight", "score"]
    placed = ranked(able, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("h1"), F.col("h2")], "copies").select(*out, "first")
    both = placed.unionByName(rows.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("first")))
    single = both.where("copies = 1").select(*out, F.col("first").alias("place"))
    repeated = both.where("copies > 1").select(*out, "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    each = single.unionByName(repeated.select(*out, (F.col("first") + F.col("k")).alias("place")))
    return each.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.when(F.col("place") <= draw, F.col("place")).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and ``weight`` and ``score``; see ``resampled``.

    Ids must be distinct and not null. Where a column has one of these two names, the new one gets underscores in front.
    """
    names = [free_name(docs, x) for x in ("weight", "score", "drawn_id")]
    chosen = resampled(docs, target, doc_id=doc_id, **options).where("rank is not null").select("weight", "score", "doc_id").toDF(*names)
    return docs.join(chosen, column(doc_id).cast("long") == column(names[2])).drop(names[2])


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` drawn towards ``benchmark``: doc_id, n_features, weight, score, rank."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 byte by byte through its table of 256 values, over the distinct n-grams of a corpus.
OP11_SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i)
  )
), texts AS (
  SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), words AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM texts
), features AS (
  SELECT side, id, unnest(w) AS f FROM words
  UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i - 1 : 2 * i])::BIGINT)),
         lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM features), crc_table
), counted AS (
  SELECT side, id, b FROM features JOIN hashed USING (f)
), buckets AS (
  SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM counted GROUP BY b
), totals AS (
  SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM buckets
), gain AS (
  SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM buckets, totals
), weighed AS (
  SELECT id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM counted JOIN gain USING (b) WHERE side = 's' GROUP BY id
), scores AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) AS n_words,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents d JOIN words w ON w.side = 's' AND w.id = d.doc_id LEFT JOIN weighed g ON g.id = d.doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_words >= 20
)
SELECT doc_id::BIGINT AS doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END::BIGINT AS rank FROM scores LEFT JOIN placed USING (doc_id)
"""
