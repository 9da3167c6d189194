"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

A text's units are its words, words without what is no letter in them (``i-d-i-o-t``),
and runs of three or more single characters joined (``i d i o t``).  The kernel of two units counts common subsequences of three letters
within a span of ``SPAN`` characters, each weighed by ``DECAY`` to the span, so gaps and
inserted characters cost weight but not the match; lengths are normalised away.  The
machine is linear in the Nystrom features of ``LANDMARKS`` units, so its value on any
unit is a sum over that unit's subsequences of weights that the landmarks fix; numpy adds
them up over whole batches.  A text is as toxic as its worst units: their largest values
and number go through a logistic link to the score.

Trained on at most ``SAMPLE`` labelled documents of each class, by hash order over all
labels; the units of toxic documents have no labels of their own, so the machine is
refitted a few times on the worst unit of each toxic document against the worst ones of
the clean (multiple-instance learning), units of both sorts also with a character put in.  Every unit of every whole text is scored.

Results for odd input: a null or empty text has no units and gets the score of a text
without any sign of toxicity; words of over ``LONGEST`` bytes are scored in overlapping
parts; repeated rows score alike; labels that are null or contradict each other for one
id do not train; a null doc_id is not held out; without labels of both classes every score is 0;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.sampling import hash_sample
from pixelloom.llm.tokens import hash_words, release, text_buffers, text_windows, tidied, windows, word_bounds
from pixelloom.session import files_for, free, materialize

SAMPLE = 1_200
SAMPLE_CHARS = 200_000  # longer documents are not in the training sample
SAMPLE_TOTAL = 32_000_000  # characters of the whole sample, at most
LANDMARKS = 160
SPAN = 6
DECAY = 0.6
LONGEST = 28
CHUNK = 1 << 17  # units whose subsequences are added up at once
REJECT = 0.7

# Letters 1..26, digits that stand for letters as these, bytes of other scripts 27..31.
_CODE = np.zeros(256, np.uint8)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _k + 1
for _c, _l in zip("013457", "oieast", strict=True):
    _CODE[ord(_c)] = ord(_l) - 96
for _b in range(0x80, 0xC0):
    _CODE[_b] = 27 + _b % 5
_STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def _size_norm() -> np.ndarray:
    """Norm of a unit by its number of characters."""
    out = np.ones(LONGEST + 1)
    for n in range(3, LONGEST + 1):
        out[n] = np.sqrt(sum(DECAY ** (2 * (k + 1)) for j, k in _STEPS for _ in range(max(0, n - k))))
    return out


_NORM = _size_norm()


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends, text of each unit): codes hold the texts' letters, and after them the joined runs."""
    codes = _CODE[data]
    starts, ends = word_bounds(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    # strip what is no letter at the ends
    letter = np.flatnonzero(codes > 0)
    if not len(letter) or not len(starts):
        return codes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(letter, starts)
    last = np.searchsorted(letter, ends) - 1
    good = last >= first
    single = good & (last - first <= 1) & (ends - starts <= 4)
    starts2, ends2 = letter[np.minimum(first, len(letter) - 1)], letter[last] + 1
    wide = ends2 - starts2
    # characters, not bytes, make a single one: one letter, or one of two bytes
    one = single & ((wide == 1) | ((wide <= 2) & (data[starts2] >= 0x80)))
    extra, spots = [], []
    if one.any():
        edge = np.flatnonzero(one & ~(np.r_[False, one[:-1]] & np.r_[False, row[1:] == row[:-1]]))
        for a in edge:
            b = a
            while b < len(one) and one[b] and row[b] == row[a]:
                b += 1
            if b - a >= 3:
                joined = np.concatenate([codes[starts2[k] : ends2[k]] for k in range(a, b)])
                extra.append(joined)
                spots.append(row[a])
    keep = good & (wide >= 3)
    s, e, r = starts2[keep], ends2[keep], row[keep]
    blank = np.r_[0, np.cumsum(codes == 0)]
    for k in np.flatnonzero(blank[e] > blank[s]):
        joined = codes[s[k] : e[k]]
        joined = joined[joined > 0]
        if len(joined) >= 3:
            extra.append(joined)
            spots.append(r[k])
    if extra:
        at = len(codes) + np.cumsum([0, *(len(x) for x in extra)])
        codes = np.concatenate([codes, *extra])
        s, e, r = np.r_[s, at[:-1]], np.r_[e, at[1:]], np.r_[r, np.array(spots, np.int64)]
    long = np.flatnonzero(e - s > LONGEST)
    if len(long):
        more = [(a, min(a + LONGEST, e[k]), r[k]) for k in long for a in range(int(s[k]), int(e[k]) - LONGEST // 2, LONGEST // 2)]
        keep = np.ones(len(s), bool)
        keep[long] = False
        more = np.array(more, np.int64)
        s, e, r = np.r_[s[keep], more[:, 0]], np.r_[e[keep], more[:, 1]], np.r_[r[keep], more[:, 2]]
    order = np.argsort(r, kind="stable")
    return codes, s[order], e[order], r[order]


def _triples(unit: np.ndarray) -> dict[int, float]:
    """A unit's normalised features: weight of each subsequence of three letters."""
    u = unit.astype(np.int64)
    out: dict[int, float] = {}
    for j, k in _STEPS:
        for i in range(len(u) - k):
            if u[i] and u[i + j] and u[i + k]:
                key = int(u[i] << 10 | u[i + j] << 5 | u[i + k])
                out[key] = out.get(key, 0.0) + DECAY ** (k + 1)
    return {key: v / _NORM[min(len(u), LONGEST)] for key, v in out.items()}


def unit_values(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of ``weights`` over the units' subsequences, normalised by length."""
    if not len(starts):
        return np.zeros(0)
    if len(starts) > CHUNK:
        return np.concatenate([unit_values(codes, starts[a : a + CHUNK], ends[a : a + CHUNK], weights) for a in range(0, len(starts), CHUNK)])
    size = ends - starts
    at = np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    left = np.repeat(ends, size) - at
    c = codes[at].astype(np.int32)
    total = np.zeros(len(c), np.float32)
    for j, k in _STEPS:
        n = len(c) - k
        if n <= 0:
            continue
        value = weights[(c[:n] << 10) | (c[j : n + j] << 5) | c[k : n + k]]
        total[:n] += np.where(left[:n] > k, value, 0) * np.float32(DECAY ** (k + 1))
    return np.add.reduceat(total, np.r_[0, np.cumsum(size)[:-1]]) / _NORM[np.minimum(size, LONGEST)]


@dataclass
class Model:
    """Weights of the subsequences, the machine's offset, and the link from units to a text's score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << 15, np.float32))
    offset: float = 0.0
    link: np.ndarray | None = None

    def text_facts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple]:
        """For each text: largest and second largest unit value, and the number of positive ones."""
        codes, s, e, r = units = units_of(data, offsets)
        v = unit_values(codes, s, e, self.weights) + self.offset
        n = len(offsets) - 1
        out = np.zeros((n, 3))
        out[:, :2] = -2.0
        if len(r):
            order = np.lexsort((-v, r))
            head = np.flatnonzero(np.r_[True, r[order][1:] != r[order][:-1]])
            rows = r[order][head]
            out[rows, 0] = v[order][head]
            two = head + 1
            ok = (two < len(order)) & (r[order][np.minimum(two, len(order) - 1)] == rows)
            out[rows[ok], 1] = v[order][two[ok]]
            out[:, 2] = np.log1p(np.bincount(r, v > 0, n)[:n])
        return np.clip(out, -2.0, 3.0), (*units, v)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.link is None:
            return np.zeros(len(offsets) - 1)
        facts, _ = self.text_facts(data, offsets)
        return 1 / (1 + np.exp(-(facts @ self.link[:3] + self.link[3])))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps on the primal."""
    a = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    w = np.zeros(a.shape[1])
    hold = ridge * np.eye(a.shape[1])
    hold[-1, -1] = 1e-9
    for _ in range(25):
        near = y * (a @ w) < 1
        some = a[near]
        new = np.linalg.solve(hold + (some * weight[near, None]).T @ some, (some * (weight * y)[near, None]).sum(0))
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients and intercept of a ridge logistic regression, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(a.shape[1])
        w = w + np.linalg.solve(h, a.T @ (y - p) - 0.05 * w)
    return w


def _all_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """units_of() over many texts, a window at a time, and a hash of each unit."""
    parts, at = [], 0
    for lo, hi in windows(offsets):
        some = data[offsets[lo] : offsets[hi]]
        codes, s, e, r = units_of(some, offsets[lo : hi + 1] - offsets[lo])
        letters = np.r_[some, codes[len(some) :] + np.uint8(96)]
        order = np.argsort(s, kind="stable")
        marks = np.empty(len(s), np.uint64)
        marks[order] = hash_words(letters, s[order], np.maximum.accumulate(e[order]) if len(s) else e)
        parts.append((codes, (s + at).astype(np.int32), (e + at).astype(np.int32), (r + lo).astype(np.int32), marks))
        at += len(codes)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint8), *(np.zeros(0, np.int32) for _ in range(3)), np.zeros(0, np.uint64))


def train(texts: list[str], toxic: np.ndarray, rounds: int = 4) -> Model:
    """A model from labelled texts."""
    toxic = np.asarray(toxic, np.int64)
    if not (toxic == 1).any() or not (toxic == 0).any():
        return Model()
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    codes, s, e, r, marks = _all_units(data, offsets)
    if not len(s):
        return Model()
    kinds, first, kind = np.unique(marks, return_index=True, return_inverse=True)
    unit, text = np.divmod(np.unique(kind.astype(np.int64) * len(toxic) + r), len(toxic))
    bad = np.bincount(unit, toxic[text], len(kinds))
    fine = np.bincount(unit, 1 - toxic[text], len(kinds))
    del unit, text, kind, marks
    # how surely a unit goes with toxic texts: the likelihood ratio of its two rates against one
    n_bad, n_fine = toxic.sum(), (1 - toxic).sum()
    rate, both = (bad + fine) / (n_bad + n_fine), bad + fine
    more = bad * np.log(np.maximum(bad, 1e-9) / (n_bad * rate)) + fine * np.log(np.maximum(fine, 1e-9) / (n_fine * rate))
    worth = np.where((bad >= 2) & (bad * n_fine > 4 * fine * n_bad), more, 0)
    suspects = np.argsort(-worth, kind="stable")[: LANDMARKS * 3 // 4]
    suspects = suspects[worth[suspects] > max(4.0, 0.1 * worth.max())]
    rng = np.random.default_rng(9)
    common = np.argsort(-fine, kind="stable")[:4000]
    common = common[fine[common] > 0]
    others = rng.choice(common, min(len(common), LANDMARKS - len(suspects)), replace=False)
    if not len(suspects) or not len(others):
        return Model()
    marks = np.r_[suspects, others]

    def letters(rows: np.ndarray) -> list[np.ndarray]:
        return [codes[s[k] : e[k]] for k in rows]

    def with_one_more(units: list[np.ndarray]) -> list[np.ndarray]:
        """The units, each with a character put in somewhere inside."""
        return [np.insert(u, rng.integers(1, len(u)), rng.integers(1, 27)) for u in units if len(u) < LONGEST]

    def features(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each unit's subsequences side by side: unit, subsequence, weight."""
        found = [_triples(u) for u in units]
        size = [len(f) for f in found]
        keys = np.fromiter((k for f in found for k in f), np.int64, sum(size))
        values = np.fromiter((v for f in found for v in f.values()), np.float64, sum(size))
        return np.repeat(np.arange(len(units)), size), keys, values

    ground = np.zeros((len(marks), 1 << 15))
    unit, key, value = features(letters(first[marks]))
    ground[unit, key] = value
    values, vectors = np.linalg.eigh(ground @ ground.T)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    basis = ground.T @ root  # subsequences x Nystrom features

    def mapped(units: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(units), basis.shape[1]))
        for a in range(0, len(units), 256):
            unit, key, value = features(units[a : a + 256])
            np.add.at(out[a : a + 256], unit, basis[key] * value[:, None])
        return out

    sure = first[suspects]
    positive = sure
    negative = np.r_[first[rng.choice(common, min(len(common), 2000), replace=False)], first[rng.choice(len(kinds), min(len(kinds), 2000), replace=False)]]
    negative = negative[toxic[r[negative]] == 0]
    hard = np.zeros(0, np.int64)
    model = Model()
    for _ in range(rounds):
        negative = np.unique(np.r_[negative, hard])
        yes, no = letters(positive), letters(negative)
        yes += with_one_more(letters(sure) * 3)
        no += with_one_more(no)
        y = np.r_[np.ones(len(yes)), -np.ones(len(no))]
        weight = np.where(y > 0, 0.5 / len(yes), 1 / len(no))
        w, b = _machine(mapped(yes + no), y, weight)
        model = Model((basis @ w).astype(np.float32), b)
        v = unit_values(codes, s, e, model.weights) + b
        order = np.lexsort((-v, r))
        head = order[np.flatnonzero(np.r_[True, r[order][1:] != r[order][:-1]])]
        clean = head[toxic[r[head]] == 0]
        worst = head[toxic[r[head]] == 1]
        positive = np.r_[sure, worst[v[worst] > max(0.0, float(np.quantile(v[clean], 0.9)) if len(clean) else 0.0)]]
        hard = clean
    facts = [model.text_facts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0] for lo, hi in windows(offsets)]
    model.link = _logistic(np.concatenate(facts), toxic)
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from the labelled documents that are not held out, at most ``sample`` of each
    class, none with more than ``chars`` characters and ``SAMPLE_TOTAL`` in all, taken by hash
    order, so what the driver gathers is bounded."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    one, two = (hash_sample(known.where(F.col("toxic") == y), ["doc_id"], sample, totals.get(y, 0)) for y in (1, 0))
    chosen = one.unionByName(two)
    rows = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id")
    once = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled", files_for(2 * sample, 100))  # repeated rows count once
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # 2 * sample rows
    fits = once.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= SAMPLE_TOTAL).select("doc_id")
    table = once.join(F.broadcast(fits), "doc_id", "left_semi").select("text", "toxic").toArrow()
    free(once)
    seen: dict[str, int] = {}
    for text, toxic in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        seen.setdefault(text, toxic)  # copies of one text train once
    texts = sorted(seen)
    del table, rows
    model = train(texts, np.array([seen[t] for t in texts], np.int64))
    release()
    return model


def score(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_windows(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sent.value.scores(data, offsets), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, every column kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [sent.value.scores(data, offsets) < reject for _, _, data, offsets in text_windows(batch, "text")]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(tidied(run), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
