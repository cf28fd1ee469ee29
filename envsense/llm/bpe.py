"""Operator 8: byte-level BPE encoding and decoding.

The texts are read twice. First each worker finds the words (matches of the public pattern) of its texts with array
operations and sends the distinct ones of each block, 32 MB of a task's texts. A shuffle brings equal words together,
and Spark higher-order functions fold the ranked merges over the bytes of every distinct word, by a table of
pairs. The words of a block with their ids are written to the shared folder. Then the workers find the words again and
put the texts together from their blocks' tables. Decoding concatenates the binary pieces of the ids.

Only words of more than ``LONG_WORD`` bytes are folded with a heap by the worker that holds them, since a step of the functions
copies the word; so are words that a table lacks, should the blocks differ between the readings (Spark may split files
anew when executors come or go). The classes of characters are the library's, so its Unicode version decides where texts are cut.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merges, pieces
from .common import column, free_name, new_dir, vocabulary

#: Fixed value: the public pattern that cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text of a block, and of the longest word that goes through Spark functions; bits of the table of a block's words.
BLOCK, LONG_WORD, BITS = 1 << 25, 2048, 16
#: Documents that are encoded at a time.
ROWS = 500


class Backend:
    """Encodes what a table misses, by merges; the library says which class a character is of."""

    special = None

    def __init__(self, tokens: list[bytes]):
        import tiktoken

        self.tokens, self.merger, self.long = tokens, None, {}
        # An encoding keeps what its pattern matches.
        kept = lambda pattern: tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        self.of_class = [(pieces.LETTER, kept(r"\p{L}")), (pieces.NUMBER, kept(r"\p{N}")), (pieces.OTHER, kept(r"[^\s\p{L}\p{N}]"))]

    def classes(self, chars: list[str]) -> np.ndarray:
        found = np.full(len(chars), pieces.SPACE, np.uint8)
        for kind, encoding in self.of_class:
            of = set(encoding.decode(encoding.encode_ordinary("".join(chars))))
            found[[k for k, c in enumerate(chars) if c in of]] = kind
        return found

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known = [self.long.get(w) for w in words]
        missing = [w for w, ids in zip(words, known) if ids is None]
        if missing:
            self.merger = self.merger or merges.Merger(self.tokens)
            n, ids = self.merger.encode(missing)
            found = iter(np.split(ids, np.cumsum(n)[:-1]))
            known = [next(found) if ids is None else ids for ids in known]
        counts = np.fromiter(map(len, known), np.int64, len(known))
        return counts, np.concatenate(known) if known else np.empty(0, np.int64)


class Collector(Backend):
    """Notes the words that a table misses and gives them no ids."""

    def __init__(self, tokens: list[bytes]):
        super().__init__(tokens)
        self.words: set[bytes] = set()

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.words.update(w for w in words if len(w) <= LONG_WORD)
        return np.zeros(len(words), np.int64), np.empty(0, np.int64)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A task's rows, text last, ROWS at most at a time, and the number of their block; the rows before a row alone decide its block."""
    first, before = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        sizes = np.array(pa.compute.binary_length(texts).fill_null(0), np.int64)
        of = (before + np.cumsum(sizes) - sizes) // size
        before += int(sizes.sum())
        cuts = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
            for k in range(a, b, ROWS):
                yield first + int(of[k]), batch.slice(k, min(ROWS, b - k))


def distinct_words(texts: DataFrame, state) -> DataFrame:
    """block, word (its bytes) of the one column of texts: each word of a block once, or a few times."""
    size = BLOCK

    def rows(block: int, words: set[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(list(words), pa.binary())], names=["block", "word"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend, last, encoder = Collector(state.value[1]), None, None
        for block, part in blocks(batches, size):
            if block != last:
                if backend.words:
                    yield rows(last, backend.words)
                backend.words, last, encoder = set(), block, pieces.Encoder(backend, BITS, most_bits=22)
            encoder.encode(part.column(0))
        if backend.words:
            yield rows(last, backend.words)

    return texts.mapInArrow(collect, "block long, word binary")


def write_words(texts: DataFrame, tokens: list[bytes], state, path: str) -> None:
    """The words of each block and their ids, folded by Spark functions, as files of ``path``."""
    words = distinct_words(texts, state).groupBy("word").agg(F.collect_set("block").alias("blocks"))
    coded = merges.SparkMerges(tokens).encoded(words, "word", "ids")
    coded.select(F.explode("blocks").alias("block"), "word", "ids").repartition("block").write.partitionBy("block").option("compression", "zstd").parquet(path)


def read_words(path: str, block: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a block, the number of ids of each, and all ids."""
    files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    words, counts, ids = [pa.array([], pa.binary())], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for info in files.get_file_info(fs.FileSelector(f"{place}/block={block}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                table = pq.ParquetFile(f).read(columns=["word", "ids"])
            for batch in table.to_batches():
                found = batch.column(1)
                words.append(batch.column(0).cast(pa.binary()))
                counts.append(found.value_lengths().to_numpy().astype(np.int64))
                ids.append(found.flatten().to_numpy().astype(np.int64))
    return pa.concat_arrays(words), np.concatenate(counts), np.concatenate(ids)


class Decoder:
    """Ids to bytes."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where each id's end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - sizes), sizes)], ends


def block_encoder(tokens: list[bytes], path: str, block: int) -> pieces.Encoder:
    """An encoder that knows the words of a block from the start."""
    words, counts, ids = read_words(path, block)
    backend, short = Backend(tokens), pa.compute.binary_length(words).to_numpy() <= pieces.LONGEST
    long = np.flatnonzero(~short)
    of = np.split(ids[np.repeat(~short, counts)], np.cumsum(counts[long])[:-1])
    backend.long = dict(zip(words.take(pa.array(long)).to_pylist(), of))
    known = words.filter(pa.array(short)), counts[short], ids[np.repeat(short, counts)]
    return pieces.Encoder(backend, max(BITS, (2 * len(words)).bit_length() + 1), known=known)


def _mapped(docs: DataFrame, text: str, tokens: list[bytes], outputs: dict[str, str], make) -> DataFrame:
    """docs without ``text``, and the output columns that ``make(encoder, decoder, texts)`` gives for a batch."""
    spark = docs.sparkSession
    state = spark.sparkContext.broadcast((uuid.uuid4().hex, tokens))
    path, size = new_dir(spark, "words"), BLOCK
    write_words(docs.select(column(text).cast("string").alias("text")), tokens, state, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, last, encoder = Decoder(state.value[1]), None, None
        for block, rows in blocks(batches, size):
            if block != last:
                encoder = None  # the memory of one at a time
                last, encoder = block, block_encoder(state.value[1], path, block)
            found = make(encoder, decoder, rows.column(rows.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *found], names=[str(k) for k in range(rows.num_columns - 1 + len(found))])

    keep = [c for c in docs.columns if c != text]
    names = []
    for c in outputs:
        names.append(free_name([*keep, *names], c))
    given = docs.select(*(column(c).alias(str(k)) for k, c in enumerate(keep)), column(text).cast("string").alias(str(len(keep))))
    kinds = [*(docs.schema[c].dataType.simpleString() for c in keep), *outputs.values()]
    return given.mapInArrow(run, ", ".join(f"`{k}` {kind}" for k, kind in enumerate(kinds))).toDF(*keep, *names)


def encode(docs: DataFrame, tokens: list[bytes], *, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns but ``text``, and its ids as array column ``out``.

    A null or empty text has no ids. If a column has the name ``out``, the new one gets underscores in
    front. Rows are independent: order, ties and repeated rows do not matter; an empty table gives an
    empty result. Texts of any length are encoded whole.
    """

    def make(encoder, _, texts):
        n, ids = encoder.encode(texts)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return _mapped(docs, text, tokens, {out: "array<int>"}, make)


def decode(ids: DataFrame, tokens: list[bytes], *, column_name: str = "ids", out: str = "bytes") -> DataFrame:
    """All columns, and the bytes of the ids as binary column ``out``: the ids' pieces, one after the other.

    Null gives null, no ids give no bytes; an id outside the vocabulary raises an error.
    """
    literal = F.from_json(F.lit("[" + ",".join(f'"{t.hex()}"' for t in tokens) + "]"), "array<string>")
    col = column(column_name)
    hexes = F.transform(col, lambda i: F.when((i >= 0) & (i < len(tokens)), F.get(literal, i)).otherwise(F.raise_error(F.lit("no such id"))))
    return ids.withColumn(free_name(ids, out), F.unhex(F.array_join(hexes, "")))


def digests(docs: DataFrame, tokens: list[bytes], *, text: str = "text") -> DataFrame:
    """All columns but ``text``, n_tokens, ids_sha256 and decoded_sha256 of each text; see ``encode``."""

    def make(encoder, decoder, texts):
        n, ids = encoder.encode(texts)
        ends = np.cumsum(n)
        raw = memoryview(ids.astype("<u4")).cast("B")
        data, byte_ends = decoder.decode(ids)
        data, byte_ends = memoryview(data), np.concatenate([[0], byte_ends])
        of = list(zip((ends - n).tolist(), ends.tolist()))
        a = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in of]
        b = [hashlib.sha256(data[byte_ends[i] : byte_ends[j]]).hexdigest() for i, j in of]
        return [pa.array(n, pa.int64()), pa.array(a), pa.array(b)]

    return _mapped(docs, text, tokens, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, make)


def op8_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    """All ``documents`` encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    tokens = merges.read_ranks(rank_file or vocabulary("byte_bpe_50k.tiktoken"))
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokens)
