"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words and one end after each text.  The probability of a token is that of its
class, given the words before it, times that of the token within its class, given those
words too.  The class is the word's last letter.  Both factors are maximum-entropy models
over a prior, the training frequencies, with weights for hashed features:

* class: the word before (n-gram), the two words before (n-gram), the second word before
  (skip) and the classes of the three words before;
* word within a class: the word before and the second word before, each with the class.
  Its outcomes are the class's ``SHORT`` most frequent words and one outcome for all others,
  which share its probability by their counts plus one; one further type stands for words
  that training did not see, as in the base score.

So all probabilities of a context sum to one over classes and words.

1. Word counts of all training texts, added up within a partition before the shuffle.
2. Training by distributed gradient updates in ``ROUNDS`` synchronous rounds, which share
   the training texts out by hash: in a round every task takes adaptive gradient steps over
   its texts of that round, from the same start, and the weights are averaged by tokens.
   All training texts are used.  Tasks see each other's updates only between rounds, so
   scores depend slightly on how the table's files are split.
3. Texts are dealt into blocks; a block asks for the counts of its distinct words, by
   joins, and is scored in sparse numpy batches.

The vocabulary grows with the corpus and is never in one place; the number of hashed
weights grows with the square root of the training tokens, up to ``MOST_HASHED``.  Only the
weights and a bounded number of rows for each class reach the driver.

Results for odd input: a null or empty text is one end token; without training texts
every count is 0, and every class is equally likely; a null doc_id is not held out;
repeated rows count and score each time; very long texts are scored in whole; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.tokens import Words, mix, text_buffers, text_windows, tidied, windows
from pixelloom.session import free, materialize

CLASSES = 32
SHORT = 15  # words of a class with an outcome of their own
LEAST_HASHED, MOST_HASHED = 1 << 12, 1 << 19  # weights of hashed features, for each outcome
ROUNDS = 2
STEP = 2048  # tokens in a gradient step
RATE = 0.15
SEEN = 0.02  # sum of squares that every feature starts with
BLOCK_BYTES = 16 << 20  # text in a block that is scored at once, about
TEXT_FOR_WEIGHTS = 8  # a training task reads as many times the bytes of the weights, at least
CHUNK = 1 << 14  # weights in a row on their way to being averaged

END = np.uint64(0x5DEECE66D5BD1E99)
_START = np.uint64(0x2545F4914F6CDD1D)
_LETTER = np.zeros(256, np.uint8)
for _k in range(26):
    _LETTER[ord("a") + _k] = _LETTER[ord("A") + _k] = _k + 1
for _k in range(0x80, 0xC0):
    _LETTER[_k] = 27 + _k % 4  # a letter of two or more bytes, by its last one


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Tokens:
    """Tokens of a window of texts, ends included: hashes, classes, bounds of each text."""

    hashes: np.ndarray
    classes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        words = Words(data, offsets)
        last = np.zeros(len(words.starts), np.uint8)
        letter = np.flatnonzero(_LETTER[data] > 0)
        if len(letter) and len(last):
            at = np.searchsorted(letter, words.ends) - 1
            inside = (at >= 0) & (letter[at] >= words.starts)
            last[inside] = _LETTER[data[letter[at[inside]]]]
        last[last == 0] = CLASSES - 1
        n = len(offsets) - 1
        first = words.first + np.arange(n + 1)
        size = len(words.hashes) + n
        hashes, classes = np.full(size, END), np.zeros(size, np.uint8)
        word = np.ones(size, bool)
        word[first[1:] - 1] = False
        hashes[word], classes[word] = words.hashes, last
        return cls(hashes, classes, first)

    def features(self, hashed: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of weights that each token's context turns on: four of the class, two of the word."""
        h, k = [], []
        for back in (1, 2, 3):
            x, c = np.full(len(self.hashes), _START), np.zeros(len(self.hashes), np.int64)
            x[back:], c[back:] = self.hashes[:-back], self.classes[:-back]
            for far in range(back):
                at = self.first[:-1] + far
                at = at[at < self.first[1:]]
                x[at], c[at] = _START, 0
            h.append(x)
            k.append(c)
        low = np.uint64(hashed - 1)
        one, two = (mix(x + np.uint64(i + 1)) for i, x in enumerate(h[:2]))
        pair = mix(h[0] * np.uint64(3) + mix(h[1]))
        kind = np.uint16 if hashed + CLASSES**3 <= 1 << 16 else np.int64  # short numbers sort faster
        of_class = np.stack([(one & low).astype(kind), (two & low).astype(kind), (pair & low).astype(kind), (hashed + (k[0] * CLASSES + k[1]) * CLASSES + k[2]).astype(kind)])
        own = _SALTS[self.classes]
        of_word = np.stack([((mix(one ^ own) & low)).astype(kind), ((mix(two + own) & low)).astype(kind)])
        return of_class, of_word


_SALTS = mix(np.arange(1000, 1000 + CLASSES, dtype=np.uint64))


def hashed_for(tokens: int) -> int:
    """A power of two near four times the square root of the training tokens."""
    return int(np.clip(1 << (int(round(np.log2(max(tokens, 1)) / 2)) + 2), LEAST_HASHED, MOST_HASHED))


def _whole(rows: np.ndarray) -> np.ndarray:
    """The rows of a contiguous array as one value each, so that they are put in place at once."""
    return rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize)))[:, 0]


class Softmax:
    """Hashed weights of one factor; ``seen`` are each feature's sums of squares of adaptive steps."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.seen = weights, None

    def odds(self, features: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Unnormalised probabilities, tokens x outcomes."""
        s = np.take(self.weights, features[0], axis=0)
        more = np.empty_like(s)
        for f in features[1:]:
            s += np.take(self.weights, f, axis=0, out=more, mode="clip")  # with "raise" it would copy once more
        np.exp(np.clip(s, -40, 40, out=s), out=s)
        s *= prior
        return s

    def learn(self, features: np.ndarray, prior: np.ndarray, outcomes: np.ndarray, rate: float) -> None:
        if self.seen is None:
            self.seen = np.full(len(self.weights), SEEN, np.float32)
        n = len(outcomes)
        gap = self.odds(features, prior)
        gap /= gap @ np.ones((gap.shape[1], 1), np.float32)  # faster than a sum over the rows
        gap[np.arange(n), outcomes] -= 1
        # a feature's gradient is the sum of its tokens' rows, which sorting brings together
        flat = features.reshape(-1)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        order %= n
        head = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        size = np.diff(np.r_[head, len(flat)])
        alone = head[size == 1]
        self._move(flat[alone], np.take(gap, order[alone], axis=0), rate)
        twice = head[size == 2]
        if len(twice):
            both = np.take(gap, order[twice], axis=0)
            both += np.take(gap, order[twice + 1], axis=0)
            self._move(flat[twice], both, rate)
        more = np.repeat(size > 2, size)
        if more.any():
            flat, order, size = flat[more], order[more], size[size > 2]
            head = np.cumsum(size) - size
            self._move(flat[head], np.add.reduceat(np.take(gap, order, axis=0), head, axis=0), rate)

    def _move(self, at: np.ndarray, step: np.ndarray, rate: float) -> None:
        seen = self.seen[at] + np.einsum("ij,ij->i", step, step) / step.shape[1]
        self.seen[at] = seen
        step *= (rate / np.sqrt(seen))[:, None]
        rows = np.take(self.weights, at, axis=0)
        rows -= step
        _whole(self.weights)[at] = _whole(rows)


class Model:
    """Both factors and what the counts say of classes and frequent words.

    n, v: tokens and distinct words of each class in training.  short: (key, class, count) of
    the most frequent words of each class.
    """

    def __init__(self, n: np.ndarray, v: np.ndarray, short: list[tuple[int, int, int]]):
        self.n, self.v = n.astype(np.int64), v.astype(np.int64)
        self.total, self.distinct = int(n.sum()), int(v.sum())
        self.hashed = hashed_for(self.total)
        self.prior = ((n + 1) / (n.sum() + CLASSES)).astype(np.float32)
        short = sorted(short, key=lambda x: (x[1], -x[2], x[0]))
        keys = np.array([k for k, _, _ in short], np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.r_[keys[order], np.uint64(2**64 - 1)]
        self.outcome = np.zeros(len(self.keys), np.int64)
        of_class = np.zeros((CLASSES, SHORT + 1))
        rank = np.zeros(CLASSES, np.int64)
        for place, (_, c, count) in zip(np.argsort(order, kind="stable"), short, strict=True):
            self.outcome[place] = rank[c]
            of_class[c, rank[c]] = count + 1
            rank[c] += 1
        taken = of_class.sum(1)
        self.tail = (self.n + self.v - taken) + 1  # counts plus one of the other words, and the unseen type
        of_class[:, SHORT] = self.tail
        self.within = (of_class / of_class.sum(1, keepdims=True)).astype(np.float32)
        self.classes = Softmax(np.zeros((self.hashed + CLASSES**3, CLASSES), np.float32))
        self.words = Softmax(np.zeros((self.hashed, SHORT + 1), np.float32))

    def flat(self) -> np.ndarray:
        """All weights, in one row."""
        return np.concatenate([self.classes.weights.reshape(-1), self.words.weights.reshape(-1)])

    def put(self, flat: np.ndarray) -> None:
        cut = self.classes.weights.size
        self.classes = Softmax(flat[:cut].reshape(self.classes.weights.shape))
        self.words = Softmax(flat[cut:].reshape(self.words.weights.shape))

    def outcomes(self, hashes: np.ndarray) -> np.ndarray:
        """Each token's place among its class's frequent words; SHORT for other words."""
        at = np.searchsorted(self.keys[:-1], hashes)
        return np.where(self.keys[at] == hashes, self.outcome[at], SHORT)

    def learn(self, t: Tokens, rate: float) -> None:
        of_class, of_word = t.features(self.hashed)
        outcomes = self.outcomes(t.hashes)
        for a in range(0, len(outcomes), STEP):
            b, c = slice(a, a + STEP), t.classes[a : a + STEP]
            self.classes.learn(of_class[:, b], self.prior, c, rate)
            self.words.learn(of_word[:, b], self.within[c], outcomes[b], rate)

    def log10(self, t: Tokens, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token; counts: theirs in training."""
        of_class, of_word = t.features(self.hashed)
        outcomes = self.outcomes(t.hashes)
        out = np.where(outcomes == SHORT, np.log10((counts + 1) / self.tail[t.classes]), 0.0)
        for a in range(0, len(out), STEP):
            b, c = slice(a, a + STEP), t.classes[a : a + STEP]
            for odds, at in ((self.classes.odds(of_class[:, b], self.prior), c), (self.words.odds(of_word[:, b], self.within[c]), outcomes[b])):
                out[b] += np.log10(odds[np.arange(len(at)), at] / odds.sum(1, dtype=np.float64))
        return out


def word_counts(training: DataFrame) -> DataFrame:
    """(key, class, n) of the distinct tokens of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded(parts: list[tuple]) -> tuple:
            keys, classes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at, spot = np.unique(keys, return_index=True, return_inverse=True)
            return keys, classes[at], np.bincount(spot, counts).astype(np.int64)

        def give(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            if parts:
                keys, classes, counts = folded(parts)
                for a in range(0, len(keys), 100_000):
                    b = a + 100_000
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b].view(np.int64)), pa.array(classes[a:b].astype(np.int8)), pa.array(counts[a:b])], names=["key", "class", "n"])

        parts: list[tuple] = []
        for batch in batches:
            for _, _, data, offsets in text_windows(batch, "text"):
                t = Tokens.of(data, offsets)
                keys, at, counts = np.unique(t.hashes, return_index=True, return_counts=True)
                parts.append((keys, t.classes[at], counts))
                if len(parts) >= 16:
                    parts = [folded(parts)]
                    if len(parts[0][0]) > 2_000_000:
                        yield from give(parts)
                        parts = []
        yield from give(parts)

    local = training.select("text").mapInArrow(tidied(run), "key bigint, class tinyint, n bigint")
    return local.groupBy("key", "class").agg(F.sum("n").alias("n"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each chunk, row by row as they come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            some = np.frombuffer(packed.as_py(), np.float32)
            sums[chunk] = sums[chunk] + some if chunk in sums else some
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "weights"])


def train(training: DataFrame, model: Model, size: int, rounds: int = ROUNDS) -> Model:
    """``model`` with weights learned from (text, turn); size: bytes of all texts."""
    sc = training.sparkSession.sparkContext
    tasks = max(1, size // (TEXT_FOR_WEIGHTS * 2 * len(model.flat())))
    rows = training.coalesce(int(tasks))
    for turn in range(rounds):
        sent, rate = sc.broadcast(model), RATE / np.sqrt(1 + turn)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            mine = copy(sent.value)
            mine.put(mine.flat())  # weights of its own
            tokens = 0
            for batch in batches:
                for _, _, data, offsets in text_windows(batch, "text"):
                    t = Tokens.of(data, offsets)
                    mine.learn(t, rate)
                    tokens += len(t.hashes)
            if tokens:
                flat = mine.flat().astype(np.float16)
                chunks = range(-(-len(flat) // CHUNK))
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([tokens] * len(chunks), pa.int64()), pa.array([flat[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in chunks], pa.binary())], names=["chunk", "tokens", "weights"])

        parts = materialize(rows.where(F.col("turn") == turn).select("text").mapInArrow(tidied(run), "chunk int, tokens bigint, weights binary"), "weights")
        tokens = parts.where("chunk = 0").agg(F.sum("tokens")).first()[0]
        if not tokens:
            continue

        def shares(batches: Iterator[pa.RecordBatch], tokens=tokens) -> Iterator[pa.RecordBatch]:
            """Each part's weights times its share of the tokens, added up before the shuffle."""

            def weighted() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    packed = [(np.frombuffer(w.as_py(), np.float16).astype(np.float32) * np.float32(n / tokens)).tobytes() for n, w in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["chunk", "weights"])

            yield from _summed(weighted())

        schema = "chunk int, weights binary"
        total = parts.mapInArrow(tidied(shares), schema).repartition("chunk").mapInArrow(tidied(_summed), schema)
        flat = np.zeros(len(model.flat()), np.float32)
        for row in total.toLocalIterator():  # as many rows as chunks of the weights
            flat[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["weights"], np.float32)
        model.put(flat)
        free(parts)
    return model


def score(docs: DataFrame, is_held_out: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    spark = docs.sparkSession
    out_of = held_out(F.col("doc_id")) if is_held_out is None else is_held_out
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), out_of.alias("held_out"))
    training = docs.where(~F.col("held_out"))
    vocabulary = materialize(word_counts(training), "vocabulary")
    per_class = np.zeros((2, CLASSES), np.int64)
    for row in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # CLASSES rows
        per_class[:, row["class"]] = row["n"], row["v"]
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "key"))
    short = vocabulary.withColumn("place", place).where(F.col("place") <= SHORT).select("key", "class", "n").collect()  # SHORT rows of each class
    model = Model(*per_class, [tuple(r) for r in short])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = training.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).alias("turn"))
    sent = spark.sparkContext.broadcast(train(rows, model, int(size), rounds))

    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition("block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("block").to_numpy()
            for block in np.unique(at):
                some = pa.RecordBatch.from_arrays([batch.column("text").filter(pa.array(at == block))], names=["text"])
                parts = [np.unique(Tokens.of(data, offsets).hashes) for _, _, data, offsets in text_windows(some, "text")]
                keys = np.unique(np.concatenate(parts)).view(np.int64)
                for a in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[a : a + 100_000]), block)), pa.array(keys[a : a + 100_000])], names=["block", "key"])

    # over all columns, so that one exchange of the texts serves this and the scoring
    asked = dealt.mapInArrow(tidied(distinct), "block bigint, key bigint")
    known = asked.join(vocabulary.select("key", "n"), "key").select("block", "key", "n")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        model = sent.value
        if len(right):
            keys, spot = np.unique(right.column("key").to_numpy().view(np.uint64), return_index=True)
            counts = right.column("n").to_numpy()[spot]
        else:
            keys, counts = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        out = [[], [], [], []]
        if len(left):
            data, offsets = text_buffers(left.column("text"))
            for lo, hi in windows(offsets):
                t = Tokens.of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.minimum(np.searchsorted(keys, t.hashes), len(keys) - 1)
                c = np.where(keys[at] == t.hashes, counts[at], 0)
                base = np.log10((c + 1) / (model.total + model.distinct + 1))
                inner = model.log10(t, c)
                cuts = t.first[:-1]
                for x, y in zip(out, (np.diff(t.first), np.add.reduceat(c > 0, cuts, dtype=np.int64), np.add.reduceat(base, cuts), np.add.reduceat(inner, cuts)), strict=True):
                    x.append(y)
        n, known, base, own = (np.concatenate(x) if x else np.zeros(0) for x in out)
        columns = [left.column("doc_id"), left.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(left), model.total, np.int64)), pa.array(base.astype(np.float64)), pa.array(own.astype(np.float64))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
