"""Operator 2 [native]: quality rules with the frequency of lines across the documents of a host.

Lines are normalised (A-Z to lower case, runs of blanks to one, trimmed) and hashed. For each host the
distinct documents that hold a line are counted: exact copies of a text are one document. A line in more
documents than the limit is boilerplate of that host and is removed from its documents (``cleaned_documents``);
a document that loses more than half of its words that way is depleted and rejected, as are documents that
fail the base rules. The limit is ``min_docs`` documents or ``max_share`` of the host's documents, whichever is more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, free_name, joined_few, let

#: The characters that separate words, and those counted as symbols.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, MAX_SHARE = 20, 0.01
#: A document is rejected if fewer than so many hundredths of its words are left.
LEAST_LEFT = 50


def words_of(text):
    """Array of the words of a text column."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def repeat_words(words):
    """Words that lie in a 3-word window found twice or more.

    Where the windows' hashes are not all distinct, they are sorted with their places; windows with an equal
    neighbour repeat. The sorted places of those cover min(3, gap to the next) words each, and the last 3: n log n for
    any length.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(a):
        def repeated(x, k):
            return F.coalesce(x["h"] == F.get(a, k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(a, k - 1)["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(a, repeated), lambda x: x["i"]))

    def covered(p):
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def found(h):
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.array_sort(placed), lambda a: let(places(a), covered))).otherwise(F.lit(0).cast("long"))

    return F.when(n >= 4, let(windows, found)).otherwise(F.lit(0).cast("long"))


def base_rules(docs: DataFrame, text: str = "text") -> dict:
    """Columns of the base rules for a text column; a null text has no words, lines or symbols."""
    t = F.coalesce(column(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    return {
        "word_chars": F.char_length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def row_of(doc_id: str, host: str, text: str):
    """Two hashes of id, host and text: what tells rows apart."""
    parts = [column(doc_id), F.coalesce(column(host).cast("string"), F.lit("")), column(text).cast("string")]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def line_rows(docs: DataFrame, *, doc_id: str, text: str, host: str) -> DataFrame:
    """host, line (hash), doc (hash of the text), row (see ``row_of``), place, words: a row for each line with a word."""
    t = column(text).cast("string")
    low = F.regexp_replace(F.translate(t, UPPER, LOWER), r"[\x20\x09\x0B-\x0D]+", " ")
    h = F.coalesce(column(host).cast("string"), F.lit(""))
    doc = F.xxhash64(t)
    rows = docs.select(h.alias("host"), doc.alias("doc"), row_of(doc_id, host, text).alias("row"), F.posexplode(F.split(low, "\n")).alias("place", "raw"))
    line = F.trim("raw")
    return rows.where(line != "").select("host", F.xxhash64(line).alias("line"), "doc", "row", "place", F.size(F.split(line, " ")).alias("words"))


def frequent_lines(rows: DataFrame, docs: DataFrame, host: str, min_docs: int, max_share: float) -> DataFrame:
    """host, line, n (its occurrences) of the lines above their host's limit."""
    sizes = docs.groupBy(F.coalesce(column(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("docs"))
    held = rows.groupBy("host", "line").agg(F.count_distinct("doc").alias("held"), F.count("*").alias("n")).where(F.col("held") > min_docs)
    return joined_few(held, cut(sizes), ["host"], "docs").where(F.col("held") > F.col("docs") * F.lit(max_share)).select("host", "line", "n")


def judged(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, places: bool = False) -> DataFrame:
    """What ``quality`` returns, and ``row``: hashes of id, host and text; with ``places`` also the 0-based places of the frequent lines, null for none."""
    rows = line_rows(docs, doc_id=doc_id, text=text, host=host)
    frequent = cut(frequent_lines(rows, docs, host, min_docs, max_share), small=True)
    lost = joined_few(rows, frequent, ["host", "line"], "n").groupBy("row", "place").agg(F.first("words").alias("words"))
    lost = lost.groupBy("row").agg(F.sum("words").cast("long").alias("n_removed"), *([F.collect_list("place").alias("places")] if places else []))

    t = column(text).cast("string")
    words = words_of(F.coalesce(t, F.lit("")))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    counted = docs.select(column(doc_id).alias("doc_id"), row_of(doc_id, host, text).alias("row"), both.alias("both"), *(c.alias(k) for k, c in base_rules(docs, text).items()))
    counted = counted.select("doc_id", "row", F.col("both.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("both.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rated = counted.withColumn("base_failed", failed).join(lost, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    depleted = 100 * (F.col("n_words") - F.col("n_removed")) < LEAST_LEFT * F.col("n_words")
    return rated.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """doc_id, the base rules' counts, base_failed, n_removed (words in frequent lines), kept.

    One row for each input row. A null text counts as empty and fails the base rules; null hosts are one
    host named ''. Rows with equal id, host and text get equal results. Other columns are not read, so
    their names do not matter. An empty table gives an empty result. Texts of any length are read whole.
    """
    return judged(docs, doc_id=doc_id, text=text, host=host, min_docs=min_docs, max_share=max_share).drop("row")


def cleaned_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that the rules keep, with all columns, and their texts without the lines that are frequent on their host.

    What is left of a text are its other lines, in their order, as they were. Null texts and texts without
    words are rejected; null hosts are one host named ''. Rows that are equal in id, host and text are cleaned
    alike and all stay. Columns may have any names. An empty table gives an empty result.
    """
    names = []
    for wanted in ("row", "good_row", "good_places"):
        names.append(free_name([*docs.columns, *names], wanted))
    row, good_row, good_places = names
    good = judged(docs, doc_id=doc_id, text=text, host=host, places=True, **limits).where("kept").groupBy("row").agg(F.first("places").alias("places"))
    given = docs.withColumn(row, row_of(doc_id, host, text))
    joined = given.join(good.toDF(good_row, good_places), F.col(row) == F.col(good_row))
    lines = F.split(column(text).cast("string"), "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(good_places)), lambda k: F.get(lines, k)), "\n")
    return joined.select(*((F.when(F.col(good_places).isNull(), column(c)).otherwise(left) if c == text else column(c)).alias(c) for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules over all ``documents``; hosts are sources."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))



OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, text, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
  SELECT rid, i, ws[i] || chr(1) || ws[i+1] || chr(1) || ws[i+2] AS tri
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, tri) > 1
), cov AS (
  SELECT rid, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid
), raw AS (
  SELECT rid, host, text, unnest(string_split(t, chr(10))) AS l FROM d
), lines AS (
  SELECT * FROM (
    SELECT rid, host, text, l, trim(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS norm FROM raw
  ) WHERE norm <> ''
), dup AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY rid
), sizes AS (
  SELECT host, count(*) AS docs FROM d GROUP BY host
), freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS held FROM lines GROUP BY host, norm) JOIN sizes USING (host)
  WHERE held > {MIN_DOCS} AND held > docs * {MAX_SHARE}::DOUBLE
), lost AS (
  SELECT rid, CAST(sum(len(string_split(norm, ' '))) AS BIGINT) AS n_removed FROM lines JOIN freq USING (host, norm) GROUP BY rid
), c AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_removed, 0) AS n_removed
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * (n_words - n_removed) < {LEAST_LEFT} * n_words) AS kept
FROM c
"""
