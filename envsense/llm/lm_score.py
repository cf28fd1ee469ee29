"""Operator 3: scores of a causal self-attention language model over subword ids.

A text is its words and one end. A word is its subwords by the first 2,048 merges of the public byte-level
vocabulary, with a space in front. Two attention models share the work: one predicts each word's first subword (or the end)
from the first subwords before it, in overlapping windows of 32 that score each place once; the other
predicts a word's further subwords and its close from those before, so its scores are computed once for
a distinct word of a worker. Given its first subword, a word's probability is interpolated with its share of the
training words that begin with that subword; the result is interpolated with the add-one estimate, in which, as in the
base score, all words that training has not seen have one probability.

Training: the models start from the frequencies of first subwords. In each round every task trains both on its
share of the training documents (by hash; the rounds share out all of them, each document in one round), and the
parameters are averaged in parts. Of each document every stretch of 32 words is trained on, and each distinct word of a
task; no place of a text is left out.

Word counts cover all training documents. Words above a frequency at which 2^19 words at most stand are broadcast;
other occurrences are joined with their counts by hash. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merges, pieces, textkit
from .attention import Adam, Model, windows
from .common import column, cut, vocabulary

#: Subwords; windows and strides for first subwords and within words; size of the models.
SUBWORDS, WIDTH, STRIDE, WORD_WIDTH, WORD_STRIDE, DIM = 2048, 32, 24, 12, 6, 16
#: Rounds of training; of how many documents one is trained on in a round (as many as rounds: each in one of them); windows of a step; learning rate.
ROUNDS, SHARE, BATCH, RATE = 3, 3, 128, 0.02
#: Weight of the attention models against the add-one estimate, and within words against the words' shares; frequent words that are broadcast (6 MB at most).
LAMBDA, WITHIN, FREQUENT = 0.8, 0.1, 1 << 19
#: Parts in which parameters are averaged; windows that are scored at a time; words that a worker keeps.
PARTS, SCORED, WORD_BITS = 16, 768, 20


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


class Reader:
    """Words of texts to first subwords and the rest, by a table that fills as it works."""

    def __init__(self, tokens: list[bytes]):
        self.merger = merges.Merger(tokens)
        heads = [k for k, t in enumerate(tokens) if t.startswith(b" ")]
        self.head_of = np.full(len(tokens), -1, np.int64)
        self.head_of[heads] = np.arange(len(heads))
        self.n_heads, self.n_tokens = len(heads), len(tokens)
        self.end = self.n_heads  # target: the text ends; input: it begins
        self.close = self.n_tokens  # target: the word is over

    def models(self, seed: int = 1, heads: np.ndarray | None = None) -> tuple[Model, Model]:
        """The models before training; heads: how often each first subword occurs, and the end."""
        first, rest = Model(self.n_heads + 1, self.n_heads + 1, WIDTH, DIM, seed), Model(self.n_tokens, self.n_tokens + 1, WORD_WIDTH, DIM, seed + 1)
        return first if heads is None else first.expect(heads), rest

    def subwords(self, words: textkit.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = words.data.tobytes()
        return self.merger.encode([b" " + raw[a:b] for a, b in zip(words.starts[which].tolist(), words.ends[which].tolist())])

    def text_windows(self, heads: np.ndarray, first: np.ndarray, every: int = 0):
        """Inputs, targets and counted slots for the texts' first subwords; ``first`` bounds the texts' words.

        With ``every``, each such stretch of a text, the first included, instead of windows that overlap.
        """
        lengths = np.diff(first) + 1
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        target = np.full(total, self.end, np.int64)
        inside = np.ones(total, bool)
        inside[ends - 1] = False
        target[inside] = heads
        given = np.full(total, self.end, np.int64)
        begins = np.zeros(total, bool)
        begins[ends - lengths] = True
        given[~begins] = heads
        if every:
            place, counted = windows(lengths, WIDTH, WIDTH)
            mine = (place[:, 0] - (ends - lengths)[np.searchsorted(ends, place[:, 0], "right")]) // WIDTH % every == 0
            return given, target, place[mine], counted[mine]
        place, counted = windows(lengths, WIDTH, STRIDE)
        return given, target, place, counted

    def word_windows(self, counts: np.ndarray, ids: np.ndarray):
        target = np.full(len(ids), self.close, np.int64)
        last = np.cumsum(counts) - 1
        inside = np.ones(len(ids), bool)
        inside[last] = False
        begins = np.zeros(len(ids), bool)
        begins[last - counts + 1] = True
        target[inside] = ids[~begins]
        place, counted = windows(counts, WORD_WIDTH, WORD_STRIDE)
        return ids, target, place, counted


def _chunks(counted: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """Windows in chunks of about the same length, and that length: up to the last slot that counts."""
    used = counted.shape[1] - np.argmax(counted[:, ::-1], axis=1)
    order = np.argsort(used, kind="stable")
    for k in range(0, len(order), size):
        mine = order[k : k + size]
        yield mine, int(used[mine[-1]])


def _scores(model: Model, given, target, place, counted) -> np.ndarray:
    """Log-probability of every target, each scored in the one window where it counts."""
    out = np.empty(len(target), np.float32)
    for mine, length in _chunks(counted, SCORED):
        p, c = place[mine, :length], counted[mine, :length]
        out[p[c]] = model.score(given[p], target[p], c)
    return out


def _trainer(state, parameters):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(state.value[1])
        models = reader.models()
        for model, flat in zip(models, parameters.value):
            model.load(flat)
        optimizers = [Adam(m, RATE / (1 + parameters.value[2])) for m in models]
        weight, shuffled, seen = 0, np.random.default_rng(7), np.empty(0, np.uint64)

        def steps(part) -> None:
            for optimizer, (given, target, place, counted), size in zip(optimizers, part, (BATCH, 4 * BATCH)):
                chunks = list(_chunks(counted, size))
                for k in shuffled.permutation(len(chunks)):
                    mine, length = chunks[k]
                    p = place[mine, :length]
                    _, g = optimizer.model.gradients(given[p], target[p], counted[mine, :length])
                    optimizer.step(g)

        for _, texts in (x for batch in batches for x in textkit.slices(batch.column(0), 1 << 21)):
            words = textkit.Words(texts)
            if not len(words.starts):
                continue
            mine, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
            counts, ids = reader.subwords(words, where)
            first = np.cumsum(counts) - counts
            part = reader.text_windows(reader.head_of[ids[first]][back], words.first, 1)
            at = np.searchsorted(seen, mine)
            new = np.flatnonzero(seen[np.minimum(at, len(seen) - 1)] != mine) if len(seen) else np.arange(len(mine))
            seen = np.insert(seen, at[new], mine[new]) if len(seen) < 4_000_000 else np.empty(0, np.uint64)  # bounded memory
            often = shuffled.permutation(new)
            pick = np.arange(int(counts[often].sum())) + np.repeat(first[often] - (np.cumsum(counts[often]) - counts[often]), counts[often])
            steps((part, reader.word_windows(counts[often], ids[pick])))
            weight += len(words.starts)
        if weight:
            flat = np.concatenate([m.flat() for m in models])
            parts = [x.astype("<f4").tobytes() for x in np.array_split(flat, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([float(weight)] * PARTS), pa.array(parts, pa.binary())], names=["part", "weight", "mean"])

    return train


def _averager(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for part, weight, mean in zip(*(c.to_pylist() for c in batch.columns)):
            held = sums.setdefault(part, [0.0, 0.0])
            held[0] += weight
            held[1] = held[1] + weight * np.frombuffer(mean, "<f4").astype(np.float64)
    for part, (weight, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["part", "weight", "mean"])


AVERAGED = "part int, weight double, mean binary"


def train(texts: DataFrame, state, rounds: int = ROUNDS, share: int = SHARE, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of the two models after all rounds, for the one column ``text`` of training texts; heads: see ``Reader.models``."""
    sc = texts.sparkSession.sparkContext
    flats = [m.flat() for m in Reader(state.value[1]).models(heads=heads)]
    for k in range(rounds):
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == k % share)
        made = mine.mapInArrow(_trainer(state, sc.broadcast((*flats, k))), AVERAGED)
        rows = made.repartition(PARTS, "part").mapInArrow(_averager, AVERAGED).collect()  # 16 rows
        if rows:
            flat = np.concatenate([np.frombuffer(r["mean"], "<f4") for r in sorted(rows, key=lambda r: r.part)])
            flats = [flat[: len(flats[0])], flat[len(flats[0]) :]]
    return tuple(flats)


def _counter(state):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of words by hash and first subword; a word is cut up once for the task, as far as its memory goes."""
        reader = Reader(state.value[1])
        keys, n, heads = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(heads)], names=["word", "n", "head"])

        for _, texts in (x for batch in batches for x in textkit.slices(batch.column(0), 1 << 21)):
            words = textkit.Words(texts)
            mine, where, times = np.unique(words.hashes(), return_index=True, return_counts=True)
            at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
            seen = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
            n[at[seen]] += times[seen]
            if not seen.all():
                new = ~seen
                counts, ids = reader.subwords(words, where[new])
                head = reader.head_of[ids[np.cumsum(counts) - counts]].astype(np.int32)
                place = np.searchsorted(keys, mine[new])
                keys, n, heads = (np.insert(x, place, y) for x, y in ((keys, mine[new]), (n, times[new]), (heads, head)))
            if len(keys) > 1_500_000:  # bounded memory; the sums are taken again later
                yield rows()
                keys, n, heads = keys[:0], n[:0], heads[:0]
        if len(keys):
            yield rows()

    return count


def count_words(texts: DataFrame, state) -> DataFrame:
    """word (hash), n, head (first subword) of the one column ``text``."""
    return texts.mapInArrow(_counter(state), "word long, n long, head int").groupBy("word").agg(F.sum("n").alias("n"), F.max("head").alias("head"))


class Scorer:
    """State of a worker: reader, models, and the words it has scored."""

    def __init__(self, tokens, flats, words, counts, heads, end_count, size):
        """words, counts: of frequent words, sorted; heads: training words by first subword; size: of the add-one estimate."""
        self.reader = Reader(tokens)
        self.models = [m.load(f) for m, f in zip(self.reader.models(), flats)]
        self.words, self.counts, self.heads, self.end_count, self.size = words, counts, heads, end_count, size
        self.bits = WORD_BITS
        self.clear()

    def clear(self) -> None:
        self.table = pieces.Table(self.bits)
        self.head, self.inner = np.empty(0, np.int32), np.empty(0, np.float32)

    def _new(self, words: textkit.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = self.reader.subwords(words, which)
        logs = _scores(self.models[1], *self.reader.word_windows(counts, ids)) if len(ids) else np.empty(0, np.float32)
        at = np.cumsum(counts) - counts
        return self.reader.head_of[ids[at]].astype(np.int32), np.add.reduceat(logs, at) if len(at) else logs

    def known(self, words: textkit.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First subword and log-probability of the rest, of each word."""
        keys = pieces.Keys(np.append(words.data, np.zeros(32, np.uint8)), words.starts, words.ends - words.starts)
        numbers = self.table.find(keys)
        new = np.flatnonzero((numbers < 0) & keys.short)
        if len(new):
            _, where = np.unique(hashes[new], return_index=True)
            if self.table.n + len(where) > len(self.table.slots) // 2:
                while len(where) > 1 << (self.bits - 1):  # one long text may hold more words than the table
                    self.bits += 2
                self.clear()
                return self.known(words, hashes)
            head, inner = self._new(words, new[where])
            self.head, self.inner = np.append(self.head, head), np.append(self.inner, inner)
            self.table.add(keys.take(new[where]))
            numbers[new] = self.table.find(keys.take(new))
        heads, inner = (np.zeros(len(numbers), x.dtype) for x in (self.head, self.inner))
        short = numbers >= 0
        heads[short], inner[short] = self.head[numbers[short]], self.inner[numbers[short]]
        long = np.flatnonzero(~short)
        if len(long):
            _, where, back = np.unique(hashes[long], return_index=True, return_inverse=True)
            h, i = self._new(words, long[where])
            heads[long], inner[long] = h[back], i[back]
        return heads, inner

    def score(self, texts: pa.Array):
        """Of each text: words, base part, known words, score part; then the words left for the join, hash and (a, b) of each.

        The models give a word that training has c times the probability a + b c.
        """
        words = textkit.Words(texts)
        hashes = words.hashes()
        heads, inner = self.known(words, hashes)
        logs = _scores(self.models[0], *self.reader.text_windows(heads.astype(np.int64), words.first)).astype(np.float64)
        n = np.diff(words.first)
        ends = np.cumsum(n + 1) - 1
        is_word = np.ones(len(logs), bool)
        is_word[ends] = False
        first = np.exp(logs[is_word])
        a, b = first * WITHIN * np.exp(inner.astype(np.float64)), first * (1 - WITHIN) / np.maximum(1, self.heads)[heads]
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        frequent = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        c = np.where(frequent, self.counts[at] if len(self.words) else 0, 0).astype(np.float64)
        sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(np.where(frequent, x, 0.0))])[words.first])
        base = sums(np.log10(c + 1)) + np.log10(self.end_count + 1)
        known = sums(np.ones(len(c))).astype(np.int64) + (self.end_count > 0)
        score = sums(np.log10(LAMBDA * (a + b * c) + (1 - LAMBDA) * (c + 1) / self.size))
        score += np.log10(LAMBDA * np.exp(logs[ends]) + (1 - LAMBDA) * (self.end_count + 1) / self.size)
        rest = ~frequent
        left = np.concatenate([[0], np.cumsum(rest)])[words.first]
        return n, base, known, score, left, hashes[rest], a[rest], b[rest]


_SCORERS: dict[str, Scorer] = {}


def _scorer(state, model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tokens = state.value
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(tokens, *model.value)
        for batch in batches:
            for row, texts in textkit.slices(batch.column(3), 1 << 20):
                n, base, known, score_, left, words, *ab = _SCORERS[name].score(texts)
                left = pa.array(left.astype(np.int32))
                lists = [pa.ListArray.from_arrays(left, pa.array(x)) for x in (words.view(np.int64), *ab)]
                same = [batch.column(k).slice(row, len(texts)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, (n + 1, base, known, score_)), *lists], names=["doc_id", "row", "held_out", "n_tokens", "base", "known", "score", "words", "a", "b"])

    return score


def score_documents(docs: DataFrame, tokens: list[bytes], *, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    A null or empty text is its end alone. A null id is in the training part. Rows are scored by
    themselves; repeated rows get equal scores. Extra columns are not read. With no training document the
    counts are 0 and the models are untrained. An empty table gives an empty result. Texts of any length
    are read whole.
    """
    sc = docs.sparkSession.sparkContext
    state = sc.broadcast((uuid.uuid4().hex, tokens))
    t = column(text).cast("string")
    rows = docs.select(column(doc_id).alias("doc_id"), F.xxhash64(column(doc_id), t).alias("row"), held_out(column(doc_id)).alias("held_out"), t.alias("text"))
    training = rows.where("not held_out").select("text")
    counts = cut(count_words(training, state))
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_ends = training.count()
    total, distinct = n_words + n_ends, n_distinct + (n_ends > 0)
    # How often a word occurs that is broadcast: from the numbers of words of each frequency, taken in powers of two.
    sizes = sorted(counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), reverse=True)
    held, least = 0, None
    for power, size in sizes:  # 64 rows at most
        if held + size > frequent:
            break
        held, least = held + size, 1 << power
    table = counts.where(F.col("n") >= least).toPandas() if least else None
    words = table.word.to_numpy(np.int64).view(np.uint64) if table is not None else np.empty(0, np.uint64)
    order = np.argsort(words)
    ns = table.n.to_numpy(np.int64)[order] if table is not None else np.empty(0, np.int64)
    by_head = np.zeros(len(tokens) + 1, np.int64)
    for head, n in counts.groupBy("head").agg(F.sum("n")).collect():  # as many rows as first subwords at most
        by_head[head] = n
    n_heads = Reader(tokens).n_heads
    flats = train(training, state, rounds, share, np.append(by_head[:n_heads], n_ends))
    size = float(total + distinct + 1)
    model = sc.broadcast((flats, words[order], ns, by_head, n_ends, size))
    scored = cut(rows.mapInArrow(_scorer(state, model), "doc_id long, row long, held_out boolean, n_tokens long, base double, known long, score double, words array<long>, a array<double>, b array<double>"))
    left = scored.select("row", F.posexplode(F.arrays_zip("words", "a", "b")).alias("at", "x")).select("row", "at", "x.words", "x.a", "x.b")
    c = F.coalesce("n", F.lit(0))
    p = LAMBDA * (F.col("a") + F.col("b") * c) + (1 - LAMBDA) * (c + 1) / F.lit(size)
    joined = left.join(counts, left["words"] == counts["word"], "left")
    # Equal rows have equal sums: the number of first places is how many there are.
    sums = joined.groupBy("row").agg(F.count_if(F.col("at") == 0).alias("rows"), F.sum(F.log10(c + 1)).alias("base_left"), F.count_if(c > 0).alias("known_left"), F.sum(F.log10(p)).alias("score_left"))
    sums = sums.select(F.col("row").alias("of"), *((F.col(x) / F.col("rows")).alias(x) for x in ("base_left", "known_left", "score_left")))
    out = scored.join(sums, F.col("row") == F.col("of"), "left")
    some = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.round(some("known_left")).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + some("base_left") - F.col("n_tokens") * F.lit(float(np.log10(size)))).alias("base_score"),
        (F.col("score") + some("score_left")).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    """All ``documents`` scored; learning from those that are not held out."""
    tokens = merges.read_ranks(rank_file or vocabulary("byte_bpe_50k.tiktoken"), SUBWORDS)
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens)
