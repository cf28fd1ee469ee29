"""Operator 9 [native]: fuzzy deduplication of lines by MinHash.

Lines are normalised (lower case, runs of blanks to one, trimmed); equal ones are one line from then on.
A line's shingles are its stretches of 10 characters, at every character, in any script (characters are
UTF-16 units). Nine MinHash values of a line are laid out as a square of three by three; its twelve
bands are the lines of that affine plane, so two lines meet unless their differing values block all twelve.
In each bucket of a band a line is a candidate with the least line and with the line before it.

A parity bitmap of 1,024 bits of a line's shingles bounds from below, exactly, in how many shingles two
lines differ; candidates that it leaves are verified by the exact Jaccard similarity of their shingle sets, and
links go to distributed union-find. Lines that share a bucket and are still in different components are then
compared with a few lines of it, and those that even so are in different components with all of it, by their bitmaps,
in blocks, and verified where these allow it, so that no pair of a bucket is left out. Of each component the line of the first document stays, once.

Lines similar to 0.8 meet in a band with a probability of 0.990, to 0.85 with 0.997, to 0.9 with 0.9996. Lines of 10
characters or more are compared, whatever their lengths; shorter ones, which have no shingle, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, free_name, let
from .components import components, extended

#: Characters of a shingle, and so of the shortest line; of the shortest line that the pipeline compares; least similarity; side of the square of MinHash values.
SHINGLE, MIN_CHARS, SIMILARITY, SIDE = 10, 40, 0.8, 3
#: The values of each band: the columns of the square, and its rows and diagonals.
BANDS = [[SIDE * c + y for y in range(SIDE)] for c in range(SIDE)] + [[SIDE * x + (m * x + c) % SIDE for x in range(SIDE)] for m in range(SIDE) for c in range(SIDE)]
#: Words of a line's bitmap; lines of a bucket that a block compares with others of it; share of all places that a hot line has.
WORDS, BLOCK, HOT = 16, 4000, 1000
#: Lines of a bucket with which all others of it are compared before what is then apart is compared line by line.
HUBS = 4
#: What tells rows apart: the id, and two hashes of the text.
ROW = ["doc", "h1", "h2"]
#: Most bits of the filter that tells which lines are needed (16 MB).
NEEDED_BITS = 27
#: Constants of the hash functions: rotations, and words to combine with (odd multiples of one).
_ROTATIONS = (0, 13, 26, 39, 52)
_WORD = 0x9E3779B97F4A7C15
_LAST = 2**63 - 1


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def normalised(text):
    """Lower case, blanks but line ends to one space; texts without double or odd blanks need no pattern."""
    low = F.lower(text)
    odd = low.contains("  ")
    for blank in "\t\r":
        odd = odd | low.contains(blank)
    return F.when(odd, F.regexp_replace(low, r"[ \t\r]+", " ")).otherwise(low)


def lines_of(docs: DataFrame, doc_id: str, text: str, shortest: int = SHINGLE) -> DataFrame:
    """doc, h1, h2, place, key (hash; null for lines under ``shortest`` characters): a row for each line, one without a place for a null text."""
    # Two steps: in one, the hashes of a text would be taken again for each of its lines.
    rows = docs.select(*row_of(doc_id, text), F.split(normalised(column(text).cast("string")), "\n").alias("lines")).select(*ROW, F.posexplode_outer("lines").alias("place", "raw"))
    line = F.trim("raw")
    return rows.select(*ROW, "place", F.when(F.char_length(line) >= shortest, F.xxhash64(line)).alias("key"))


def row_of(doc_id: str, text: str) -> list:
    """The columns ROW; a null id is the last."""
    value = column(text).cast("string")
    return [F.coalesce(column(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def text_rows(docs: DataFrame, doc_id: str, text: str, shortest: int = SHINGLE) -> DataFrame:
    """key, norm: a row for each line of ``shortest`` characters or more that has a shingle."""
    rows = docs.select(*(c for c in docs.columns if c not in (doc_id, text)), F.explode(F.split(normalised(column(text).cast("string")), "\n")).alias("raw"))
    rows = rows.withColumn("norm", F.trim("raw")).where(F.char_length("norm") >= max(shortest, SHINGLE))
    return rows.select(F.xxhash64("norm").alias("key"), "norm")


def shingle_places(units):
    """Where the shingles begin in a line's UTF-16 units (1-based bytes)."""
    return F.sequence(F.lit(1), F.octet_length(units) - (2 * SHINGLE - 1), F.lit(2))


def shingle_hash(units, place):
    return F.xxhash64(F.substring(units, place, F.lit(2 * SHINGLE)))


def shingle_set(norm):
    """Hashes of a normalised line's distinct shingles; none if the line is shorter than one."""
    of = lambda units: F.array_distinct(F.transform(shingle_places(units), lambda i: shingle_hash(units, i)))
    return F.when(F.octet_length(F.encode(norm, "UTF-16BE")) >= 2 * SHINGLE, let(F.encode(norm, "UTF-16BE"), of)).otherwise(F.array().cast("array<bigint>"))


def shared_buckets(lines: DataFrame) -> DataFrame:
    """key, bucket, least, before: the lines (key, norm) of buckets that hold two or more, with the least line and the one before."""
    rows = lines.select("key", F.encode("norm", "UTF-16BE").alias("units"))
    rows = rows.select("key", "units", F.explode(shingle_places(F.col("units"))).alias("i")).select("key", shingle_hash(F.col("units"), F.col("i")).alias("h"))
    # Rotations of a hash order the shingles by other bits of it; combining with a word moves where the least is looked for.
    turned = [F.col("h") if not r else F.shiftleft("h", r).bitwiseOR(F.shiftrightunsigned("h", 64 - r)) for r in _ROTATIONS]
    rows = rows.select("key", *(t.alias(f"h{k}") for k, t in enumerate(turned)))
    values = [F.min(F.col(f"h{i % len(_ROTATIONS)}").bitwiseXOR(F.lit(_signed(_WORD * (2 * i + 1))))).alias(f"m{i}") for i in range(SIDE * SIDE)]
    signed = rows.groupBy("key").agg(*values)
    bands = [F.xxhash64(F.lit(b), *(f"m{i}" for i in band)) for b, band in enumerate(BANDS)]
    buckets = signed.select("key", F.explode(F.array(*bands)).alias("bucket"))
    w = Window.partitionBy("bucket").orderBy("key")
    least = F.first("key").over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = buckets.select("key", "bucket", least.alias("least"), F.lag("key").over(w).alias("before"), F.lead("key").over(w).alias("after"))
    return near.where("before is not null or after is not null").drop("after")


def marked(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Rows whose column ``name`` may be in the one column of ``wanted``: a bitmap with 16 bits for each, or 16 MB if that is less, decides."""
    size = min(NEEDED_BITS, max(15, (16 * wanted.count()).bit_length()))
    slots = wanted.select(F.pmod(F.xxhash64(F.col(wanted.columns[0])), F.lit(1 << size)).alias("slot"))
    maps = slots.groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits"))
    slot = F.pmod(F.xxhash64(name), F.lit(1 << size))
    bit = F.pmod(slot, F.lit(32768))
    found = rows.withColumns({"part": F.shiftright(slot, 15), "bit": bit.cast("int")}).join(F.broadcast(maps), "part")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright("bit", 3) + 1, F.lit(1))), 16, 10).cast("long")
    return found.where(F.getbit(byte, F.pmod("bit", F.lit(8))) == 1).select(*rows.columns)


def held_lines(keys: DataFrame, each: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, norm of the lines ``keys``, each taken from the first document that holds it; few others are among them."""
    wanted = cut(each.join(keys, "key").select(F.col("first.h1").alias("h1"), F.xxhash64("key", "first.h1").alias("own")))
    texts = marked(docs.select(row_of(doc_id, text)[1], column(text).cast("string").alias("text")), wanted.select("h1").distinct(), "h1")
    lines = texts.select("h1", F.explode(F.split(normalised(F.col("text")), "\n")).alias("raw")).select("h1", F.trim("raw").alias("norm"))
    lines = lines.where(F.char_length("norm") >= SHINGLE).withColumn("key", F.xxhash64("norm"))
    lines = marked(lines.select("key", "norm", F.xxhash64("key", "h1").alias("own")), wanted.select("own"), "own")
    return lines.groupBy("key").agg(F.min("norm").alias("norm"))


def sketches(held: DataFrame) -> DataFrame:
    """key, n, bits of the lines (key, norm): how many shingles each has, and its bitmap: every shingle turns one bit over.

    The bitmap is one column: with a column for each word, the planner takes minutes over the conditions of ``may_be_similar``.
    """
    rows = held.select("key", F.explode(shingle_set(F.col("norm"))).alias("h")).select("key", F.expr(f"int((h >>> 32) & {WORDS - 1})").alias("w"), F.expr("shiftleft(1L, int(h & 63))").alias("bit"))
    found = rows.groupBy("key").agg(F.count("*").alias("n"), *(F.bit_xor(F.when(F.col("w") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(WORDS)))
    return found.select("key", "n", F.array(*(f"s{k}" for k in range(WORDS))).alias("bits"))


def may_be_similar(a: str, b: str):
    """Whether the bitmaps of two rows differ no more than similar lines can: |A xor B| <= (1 - s) / (1 + s) (|A| + |B|)."""
    differ = sum((F.bit_count(F.get(f"{a}.bits", F.lit(k)).bitwiseXOR(F.get(f"{b}.bits", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    return differ * F.lit(1 + SIMILARITY) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * F.lit(1 - SIMILARITY + 1e-9)


def candidate_pairs(shared: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: each pair of lines that a bucket proposes first and that may be similar, once; a < b. known: sketches."""
    pairs = shared.where("before is not null").select(F.col("key").alias("b"), F.explode(F.array_distinct(F.array("least", "before"))).alias("a"))
    pairs = pairs.where("a <> b").select("a", "b").distinct()
    both = pairs.join(known.alias("x"), F.col("a") == F.col("x.key")).join(known.alias("y"), F.col("b") == F.col("y.key"))
    return both.where(may_be_similar("x", "y")).select("a", "b")


def apart_pairs(shared: DataFrame, roots: DataFrame, known: DataFrame, hubs: int = 0) -> DataFrame:
    """a, b: each pair of lines, once, that share a bucket, are in different components and may be similar; a < b.

    In a bucket the lines outside its largest component are compared with all of it, block by block; two lines are a
    pair in the least bucket that they share. With ``hubs``, all lines of a bucket are compared with as many of it alone,
    chosen by hash: what these join need not be compared line by line.
    """
    rows = shared.select("key", "bucket").join(roots.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = rows.groupBy("bucket", "root").count()
    mixed = sizes.groupBy("bucket").agg(F.sum("count").alias("n"), F.max_by("root", "count").alias("top"), F.count("*").alias("roots")).where("roots > 1")
    of = rows.join(mixed.select("bucket", "top", F.floor(F.col("n") / BLOCK).alias("last")), "bucket")
    lines = cut(of.groupBy("key").agg(F.first("root").alias("root"), F.collect_list(F.struct("bucket", "top", "last")).alias("own")).join(known, "key"), small=True)
    rows = lines.select("key", "root", "n", "bits", F.col("own.bucket").alias("own"), F.inline("own"))
    one, every = F.pmod(F.xxhash64("key"), F.col("last") + 1).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block")
    met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    if hubs:
        nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("key", "bucket"), "key"))
        x = rows.withColumn("nth", nth).where(F.col("nth") <= hubs).select("bucket", every, F.col("key").alias("a"), "root", "n", "bits")
        y = rows.select("bucket", one, F.col("key").alias("b"), "root", "n", "bits")
        return x.alias("x").join(y.alias("y"), met & may_be_similar("x", "y")).select(*ordered).distinct()
    x = rows.where("root <> top").select("bucket", every, F.col("key").alias("a"), "root", "n", "bits", "own")
    y = rows.select("bucket", one, F.col("key").alias("b"), "root", "n", "bits", "own", (F.col("root") == F.col("top")).alias("inside"))
    once = (F.col("y.inside") | (F.col("a") < F.col("b"))) & may_be_similar("x", "y") & (F.array_min(F.array_intersect("x.own", "y.own")) == F.col("x.bucket"))
    return x.alias("x").join(y.alias("y"), met & once).select(*ordered)


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar. held: key, norm."""
    sets = held.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key").select("key", shingle_set(F.col("norm")).alias("set"))
    a, b = sets.select(F.col("key").alias("a"), F.col("set").alias("x")), sets.select(F.col("key").alias("b"), F.col("set").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("i") >= F.lit(SIMILARITY) * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The lines of the documents (see ``lines_of``), and doc, h1, h2, places (0-based, of the lines that go) for rows that lose any.

    Rows with a null id have doc 2^63 - 1. Rows equal in id and text are one.
    """
    of_docs = cut(lines_of(docs, doc_id, text, shortest))
    places = of_docs.where("key is not null")
    each = cut(places.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "place")).alias("first")))
    shared = cut(shared_buckets(text_rows(docs.select(column(text).alias("text")), "", "text", shortest)))
    held = cut(held_lines(cut(shared.select("key").distinct()), each, docs, doc_id, text))
    known = cut(sketches(held))
    pairs = cut(candidate_pairs(shared, known), small=True)
    roots = components(cut(verified(pairs, held), small=True))
    for hubs in (HUBS, 0):  # the second time all that is still apart
        apart = cut(apart_pairs(shared, roots, known, hubs), small=True)
        if not apart.isEmpty():
            roots = extended(roots, cut(verified(apart, held), small=True))
    copies = each.join(roots.withColumnRenamed("id", "key"), "key", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "key"))
    first = [F.col(f"first.{c}") for c in ROW]
    stays = copies.groupBy("root").agg(F.min(F.struct(*first, "key", "first.place")).alias("stays"))
    of = cut(copies.join(stays, "root").select("key", "n", "stays"), small=True)
    # Lines with a thousandth of all places or more are a thousand at most.
    hot = F.col("n") * HOT >= (each.agg(F.sum("n")).first()[0] or 0)
    many = F.broadcast(of.where(hot))
    rest = places.join(many.select("key"), "key", "left_anti").join(of.where(~hot), "key")
    gone = places.join(many, "key").select(*rest.columns).union(rest)
    gone = gone.where(F.struct(*ROW, "key", "place") != F.col("stays"))
    return of_docs, gone.groupBy(*ROW).agg(F.array_sort(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHINGLE) -> DataFrame:
    """The documents with the text cut down to the lines that stay, and ``n_removed`` (lines).

    All rows stay, with all columns; a text that loses all lines becomes empty; a null or empty text stays
    as it is. Rows equal in id and text are one document: what stays in it stays in each of them. Rows with one id and
    different texts are different documents; rows with a null id come last, and rows of one id in the order of hashes of
    their texts. Between equal lines of one document the first place wins. If there is a column ``n_removed``, the new one gets underscores in
    front. Lines under ``shortest`` characters stay. An empty table gives an empty result. Lines and texts of any length are read whole.
    """
    out = free_name(docs, "n_removed")
    names = [free_name(docs, x) for x in ("gone_doc", "gone_h1", "gone_h2", "gone_places")]
    # Cut, so that the result does not keep the lines of all documents and the shuffles behind it on disk.
    gone = cut(removed_lines(docs, doc_id=doc_id, text=text, shortest=shortest)[1]).toDF(*names)
    same = [a.eqNullSafe(F.col(b)) for a, b in zip(row_of(doc_id, text), names)]
    joined = docs.join(gone, same[0] & same[1] & same[2], "left")
    places, lines = F.col(names[-1]), F.split(column(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    cut_text = F.when(places.isNotNull() & column(text).isNotNull(), F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(column(text))
    joined = joined.withColumns({out: F.coalesce(F.size(F.coalesce(places, F.array().cast("array<int>"))), F.lit(0)).cast("long"), names[0]: cut_text})
    return joined.select(*((column(names[0]) if c == text else column(c)).alias(c) for c in docs.columns), out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each of the ``documents``: doc_id, n_lines, n_removed, removed (places of the removed lines, 0-based)."""
    rows, gone = removed_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lines = rows.groupBy(*ROW).agg(F.coalesce(F.max("place") + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = lines.join(gone, ROW, "left")
    ids = F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id")
    return joined.select(ids, "n_lines", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("places", ","), F.lit("")).alias("removed"))
