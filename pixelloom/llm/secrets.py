r"""Secret scan: base patterns, and a linear-chain conditional random field.

Base spans are the leftmost non-overlapping matches of three patterns that pass their
length test.  The field tags tokens (runs of letters, digits, ``+/_.-`` and non-ASCII)
as begin, inside or outside of a secret from their own shape, the neighbours' words and
shapes, what stands between them, and features of the file; Viterbi decodes the best
tags.  Its spans are added where they touch no base span.

The field learns by likelihood (forward-backward) on at most ``SAMPLE`` documents that
may hold a secret and as many others, taken by hash order over the whole table, labelled
by the base patterns; in every other one a secret is replaced by a generated one of another
shape and others are put in.  Of a document at most ``WINDOWS`` stretches train, those
round secrets first, drawn from all of it.  Decoding covers every token of every whole text.  A token whose outside score
leads by more than all transitions could return is outside on the best path, so texts
fall into short chains and the decoding stays exact.

Results for odd input: a null or empty text has no spans; very long texts are read in
whole; repeated rows get the same spans; other columns (doc_id aside) are ignored; an
empty table gives no rows.  Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.sampling import hash_sample
from pixelloom.llm.tokens import hash_words, release, text_buffers, text_windows, tidied

SAMPLE = 1_000  # documents of either sort that the field is trained on, at most
SAMPLE_CHARS = 20_000  # longer documents are not in that sample
WINDOWS = (6, 4, 2)  # training windows of a document, at most: round secrets, other odd tokens, places drawn at random
PLANTED = 2  # generated secrets that are put into every other document of the sample, besides those replaced

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

# What a byte is to a token: one bit each, 0 for separators.
_BIT = np.zeros(256, np.uint8)
for _chars, _bit in (("abcdef", 1), ("ghijklmnopqrstuvwxyz", 2), (string.ascii_uppercase, 4), (string.digits, 8), ("+/_-", 16), (".", 32)):
    for _c in _chars:
        _BIT[ord(_c)] = _bit
_BIT[128:] = 64
# What stands between tokens: one bit each.
_GAP = np.full(256, 32, np.uint8)
for _chars, _bit in ((" \t", 1), ("\r\n", 2), ("=", 4), (":", 8), ("\"'`", 16)):
    for _c in _chars:
        _GAP[ord(_c)] = _bit
_HEXBYTE = np.zeros(256, bool)
for _c in "0123456789abcdef":
    _HEXBYTE[ord(_c)] = True

_LENGTHS = np.array([3, 5, 8, 12, 16, 20, 24, 32, 48])  # bucket bounds
_NL, _SHAPES, _WORDS = len(_LENGTHS) + 1, 128 * (len(_LENGTHS) + 1), 2048
_OFFSETS = np.cumsum([0, _SHAPES, 8 * _NL, 65 * _NL, _WORDS + 1, _WORDS + 1, _WORDS, _SHAPES + 1, _SHAPES + 1, 16])
FEATURES = int(_OFFSETS[-1])
OUT, BEGIN, IN = 0, 1, 2


class Tokens:
    """Tokens and features of a window of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        bits = _BIT[data]
        inside = bits > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.r_[True, ~inside[:-1]] | edge[:-1] if len(data) else np.zeros(0, bool)
        after = np.r_[~inside[1:], True] | edge[1:] if len(data) else np.zeros(0, bool)
        self.starts, self.ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        n = len(self.starts)
        self.first = np.searchsorted(self.starts, offsets)
        self.first[-1] = n
        if not n:
            self.features = np.zeros((9, 0), np.int32)
            return
        size = np.searchsorted(_LENGTHS, self.ends - self.starts, "left")
        cuts = np.empty(2 * n, np.int64)
        cuts[::2], cuts[1::2] = self.starts, self.ends
        tail = cuts[-1] == len(data)
        kind = np.bitwise_or.reduceat(bits, cuts[:-1] if tail else cuts)[::2]
        shape = kind.astype(np.int32) * _NL + size
        letter = (bits & 7) > 0
        digit = bits == 8
        turn = np.zeros(len(data), np.uint8)
        turn[1:] = (letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])
        turns = np.add.reduceat(turn, self.starts, dtype=np.int64)
        turns = np.minimum(turns, 7)
        gaps = np.zeros(n, np.int32)
        if n > 1:
            inner = cuts[1:-1]
            joined = np.bitwise_or.reduceat(_GAP[data], inner)[::2]
            joined = np.where(inner[::2] == inner[1::2], 0, joined)
            gaps[1:] = joined
        words = (hash_words(data, self.starts, self.ends) & np.uint64(_WORDS - 1)).astype(np.int32)
        heads = np.unique(self.first[:-1][self.first[:-1] < n])
        tails = np.unique(self.first[1:][self.first[1:] > 0]) - 1
        gaps[heads] = 64
        prev_word, next_word = np.r_[0, words[:-1]], np.r_[words[1:], 0]
        prev_shape, next_shape = np.r_[0, shape[:-1]], np.r_[shape[1:], 0]
        prev_word[heads], prev_shape[heads] = _WORDS, _SHAPES
        next_word[tails], next_shape[tails] = _WORDS, _SHAPES
        row = np.searchsorted(self.first, np.arange(n), "right") - 1
        counts = np.maximum(np.diff(self.first), 1)
        with_digit = np.bincount(row, (kind & 8) > 0, len(counts))[: len(counts)] / counts
        spread = np.diff(offsets) / counts  # bytes for each token
        file = np.searchsorted([0.005, 0.05, 0.2], with_digit) * 4 + np.searchsorted([5.5, 7.0, 9.0], spread)
        self.features = np.stack([shape, turns * _NL + size, gaps * _NL + size, prev_word, next_word, words, prev_shape, next_shape, file[row]]).astype(np.int32) + _OFFSETS[:-1, None].astype(np.int32)


class Field:
    """A linear-chain conditional random field over the three tags."""

    def __init__(self):
        self.weights = np.zeros((FEATURES, 3), np.float32)
        self.moves = np.zeros((3, 3), np.float32)

    def legal(self) -> np.ndarray:
        moves = self.moves.astype(np.float64)
        moves[OUT, IN] = -1e9
        return moves

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3), np.float32)
        for f in features:
            out += self.weights[f]
        return out

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.5) -> None:
        """Adaptive gradient ascent on the likelihood of (features, tags) chains of one length."""
        feats = np.stack([f for f, _ in chains], 1)  # 9, chains, length
        tags = np.stack([t for _, t in chains])
        c, n = tags.shape
        gold = np.eye(3)[tags]
        gold_moves = sum(gold[:, k, :, None] * gold[:, k + 1, None, :] for k in range(n - 1)).sum(0)
        seen_w, seen_m = np.full(self.weights.shape, 1e-6), np.full((3, 3), 1e-6)
        for _ in range(rounds):
            s = sum(self.weights[f] for f in feats).astype(np.float64)
            moves = self.legal()
            ahead = np.empty((n, c, 3))
            ahead[0] = s[:, 0] + np.array([0, 0, -1e9])
            for k in range(1, n):
                ahead[k] = s[:, k] + np.logaddexp.reduce(ahead[k - 1][:, :, None] + moves, 1)
            back = np.zeros((n, c, 3))
            for k in range(n - 2, -1, -1):
                back[k] = np.logaddexp.reduce(moves + (s[:, k + 1] + back[k + 1])[:, None, :], 2)
            total = np.logaddexp.reduce(ahead[-1], 1)
            p = np.exp(ahead + back - total[None, :, None]).transpose(1, 0, 2)
            pair = np.zeros((3, 3))
            for k in range(n - 1):
                pair += np.exp(ahead[k][:, :, None] + moves + (s[:, k + 1] + back[k + 1])[:, None, :] - total[:, None, None]).sum(0)
            gap = (gold - p).reshape(-1, 3)
            step = np.zeros(self.weights.shape)
            for f in feats:
                for y in range(3):
                    step[:, y] += np.bincount(f.reshape(-1), gap[:, y], FEATURES)
            step -= 0.02 * self.weights
            seen_w += step**2
            self.weights += (rate * step / np.sqrt(seen_w)).astype(np.float32)
            turn = gold_moves - pair
            seen_m += turn**2
            self.moves = np.clip(self.moves + rate * turn / np.sqrt(seen_m), -2, 2).astype(np.float32)

    def tags(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of all texts of a window; ``first`` bounds the texts' tokens."""
        s = self.scores(features)
        n = len(s)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        swing = 8 * float(np.abs(self.moves).max()) + max(0.0, float((s[:, IN] - s[:, BEGIN]).max()))
        loose = s[:, OUT] - s[:, 1:].max(1) <= swing
        head = np.zeros(n + 1, bool)
        head[first] = True
        start = np.flatnonzero(loose & (np.r_[True, ~loose[:-1]] | head[:-1]))
        end = np.flatnonzero(loose & (np.r_[~loose[1:], True] | head[1:])) + 1
        order = np.argsort(end - start, kind="stable")
        for a in range(0, len(order), 2048):
            some = order[a : a + 2048]
            self._decode(s, start[some], end[some], out)
        return out

    def _decode(self, s: np.ndarray, start: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        """Viterbi over chains between outside tokens, side by side."""
        size = end - start
        longest = int(size.max())
        moves = self.legal()
        best = s[start] + moves[OUT]
        links = np.zeros((longest, len(start), 3), np.int8)
        final = best.copy()
        for k in range(1, longest):
            live = size > k
            options = best[:, :, None] + moves
            links[k] = options.argmax(1)
            best = np.where(live[:, None], options.max(1) + s[np.minimum(start + k, len(s) - 1)], best)
            final = best
        tag = (final + moves[:, OUT]).argmax(1)
        rows = np.arange(len(start))
        for k in range(longest - 1, -1, -1):
            live = size > k
            out[(start + k)[live]] = tag[live]
            if k:
                tag = np.where(live, links[k][rows, tag], tag)


def base_spans(text: str, low: bytes | None = None, hexes: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns.  low: the text's bytes with A-Z as a-z; hexes: hex runs found already."""
    low = text.encode("utf-8", "surrogatepass").lower() if low is None else low
    spans = []
    if any(k in low for k in _KEYS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes is None:
        hexes = [m.span() for m in HEX.finditer(text)]
    spans += [(a, b, 2) for a, b in hexes if b - a >= 24]
    return sorted(spans, key=lambda x: (x[0], x[2]))


def _hex_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of runs of 24 or more of ``[0-9a-f]``."""
    mark = np.zeros(len(data) + 2, np.int8)
    mark[1:-1] = _HEXBYTE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    step = np.diff(mark)
    # a run that crosses into the next text is cut there
    cross = inner[(mark[inner] == 1) & (mark[inner + 1] == 1)]
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    start, end = np.sort(np.r_[start, cross]), np.sort(np.r_[end, cross])
    keep = end - start >= 24
    return start[keep], end[keep]


class Positions:
    """Code points of byte positions in one text."""

    def __init__(self, raw: np.ndarray):
        lead = (raw & 0xC0) != 0x80
        self.map = None if lead.all() else np.r_[0, np.cumsum(lead)]

    def __call__(self, at: int) -> int:
        return int(at) if self.map is None else int(self.map[at])


def scan_texts(data: np.ndarray, offsets: np.ndarray, field: Field) -> Iterator[list[tuple[int, int, int]]]:
    """All spans of each text of a window."""
    tokens = Tokens(data, offsets)
    tags = field.tags(tokens.features, tokens.first)
    hex_start, hex_end = _hex_runs(data, offsets)
    hex_of = np.searchsorted(hex_start, offsets)
    begin = np.flatnonzero(tags == BEGIN)
    begin_of = np.searchsorted(begin, tokens.first)
    low_all = data.tobytes().lower()
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        low = low_all[a:b]
        some_hex = range(hex_of[i], hex_of[i + 1])
        some_crf = begin[begin_of[i] : begin_of[i + 1]]
        keyed = any(k in low for k in _KEYS) or b"akia" in low
        if not keyed and not some_hex and not len(some_crf):
            yield []
            continue
        raw = data[a:b]
        at = Positions(raw)
        hexes = [(at(hex_start[k] - a), at(hex_end[k] - a)) for k in some_hex]
        spans = base_spans(raw.tobytes().decode("utf-8", "replace"), low, hexes)
        added = []
        for t in some_crf:
            last = int(t)
            while last + 1 < tokens.first[i + 1] and tags[last + 1] == IN:
                last += 1
            s, e = int(tokens.starts[t]), int(tokens.ends[last])
            while e > s and data[e - 1] in b".-":
                e -= 1
            while e < b and e - int(tokens.ends[last]) < 2 and data[e] == 0x3D:
                e += 1
            if e <= s:
                continue
            s, e = at(s - a), at(e - a)
            if not any(x < e and s < y for x, y, _ in spans):
                added.append((s, e, 3))
        yield sorted(spans + added, key=lambda x: (x[0], x[2]))


#: What stands before a generated secret; short secrets always have one of the first sort.
_LEADS = (
    "password=", "pwd=", "pwd: ", "passphrase ", "passphrase: ", "token: ", "secret = \"", "api_key=", "key ", "key=", "auth ", "auth=", "bearer ", "Authorization: Bearer ",
    "credential ", "credentials: ", "login admin:", "user:", "https://user:", "private_key=", "access key ", "client_secret: ", "pass ", "PWD=",
)
_HEADS = ("", "", "", "", "sk_", "key-", "gh_", "xox-", "pk_test_", "eyJ", "AIza")


def _generated(rng: np.random.Generator) -> tuple[str, str]:
    """(lead, made-up secret) of a shape drawn at random."""
    kinds = (string.ascii_letters + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    chars = list(kinds[rng.integers(len(kinds))])
    body = "".join(rng.choice(chars, int(rng.integers(10, 48))))
    if len(body) > 28 and rng.random() < 0.3:
        body = body[:12] + str(rng.choice(list(".-_"))) + body[13:]
    lead = str(rng.choice(_LEADS)) if len(body) < 13 or rng.random() < 0.5 else ""
    return lead, str(rng.choice(_HEADS)) + body if len(body) >= 16 else body


def _inner(text: str) -> list[tuple[int, int]]:
    """The secrets of the base patterns, without the key words of assignments."""
    spans = set()
    for a, b, kind in base_spans(text):
        inner = ASSIGN.match(text, a) if kind == 0 else None
        spans.add((inner.start(2), inner.end(2)) if inner else (a, b))
    return sorted(spans)


def _planted(text: str, rng: np.random.Generator, more: int) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with one of its secrets replaced by a generated one, and ``more`` put in; all secrets."""
    spans, spaces = _inner(text), [m.end() for m in re.finditer(r"\s", text)] or [0]
    cuts = [(int(spaces[k]),) * 2 for k in np.unique(rng.integers(0, len(spaces), more))]
    cuts = [c for c in cuts if not any(a <= c[0] <= b for a, b in spans)]
    if spans:
        cuts.append(spans[rng.integers(len(spans))])
    out, at, own = [], 0, []
    for a, b in sorted(cuts):
        lead, new = _generated(rng)
        if a == b:
            out += [text[at:a], lead]
            new_at = sum(map(len, out))
            out += [new, " "]
        else:
            out.append(text[at:a])
            new_at = sum(map(len, out))
            out.append(new)
        own.append((new_at, new_at + len(new)))
        at = b
    whole = "".join([*out, text[at:]])
    return whole, own + [s for s in _inner(whole) if not any(s[0] < b and a < s[1] for a, b in own)]


def train(texts: list[str], seed: int = 3, length: int = 24) -> Field:
    """A field from texts that the base patterns label, every other one with generated secrets."""
    rng = np.random.default_rng(seed)
    chains = []
    for number, text in enumerate(texts):
        text, spans = _planted(text, rng, PLANTED) if number % 2 else (text, _inner(text))
        data, offsets = text_buffers(pa.array([text]))
        tokens = Tokens(data, offsets)
        n = len(tokens.starts)
        if not n:
            continue
        at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        s, e = at[tokens.starts], at[tokens.ends]
        tag = np.zeros(n, np.int64)
        for a, b in spans:
            hit = np.flatnonzero((s < b) & (e > a))
            tag[hit[tag[hit] == OUT]] = IN
            if len(hit):
                tag[hit[0]] = BEGIN
        kind = tokens.features[0] // _NL
        odd = np.flatnonzero((tag == OUT) & ((kind & 8 > 0) | (tokens.ends - tokens.starts >= 12)))
        picks: set[int] = set()
        for some, most in zip((np.flatnonzero(tag == BEGIN), odd), WINDOWS, strict=False):
            some = rng.choice(some, most, replace=False) if len(some) > most else some
            picks |= {max(0, min(int(k) - int(rng.integers(4, length - 4)), n - length)) for k in some}
        picks |= {int(k) for k in rng.integers(0, max(1, n - length + 1), WINDOWS[2])}
        for k in sorted(picks):
            f, t = tokens.features[:, k : k + length], tag[k : k + length].copy()
            if f.shape[1] < length:
                more = length - f.shape[1]
                f, t = np.hstack([f, np.tile(f[:, -1:], (1, more))]), np.r_[t, np.full(more, t[-1] if t[-1] != BEGIN else IN)]
            if t[0] == IN:
                t[0] = BEGIN
            chains.append((f, t))
    field = Field()
    if chains:
        field.fit(chains)
    else:
        field.weights[:, OUT] = 1
    return field


def fit_field(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on bounded samples of ``docs``."""
    short = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    text = F.col("text")
    may = text.contains("password") | text.contains("passwd") | text.contains("secret") | text.contains("token") | text.contains("AKIA") | text.contains("api")
    marked = short.withColumn("may", may)
    totals = {r["may"]: r["n"] for r in marked.groupBy("may").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = []
    for kind in (True, False):
        some = hash_sample(marked.where(F.col("may") == kind), ["doc_id", "text"], sample, totals.get(kind, 0))
        texts += some.select("text").toArrow().column(0).to_pylist()
    field = train(texts)
    release()
    return field


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans) for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_windows(batch, "text"):
                all_spans = list(scan_texts(data, offsets, sent.value))
                counts = [pa.array([sum(k == kind for _, _, k in s) for s in all_spans], pa.int64()) for kind in range(4)]
                base = [hashlib.sha256(_named([x for x in s if x[2] < 3]).encode()).hexdigest() for s in all_spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *counts, pa.array(base, pa.string()), pa.array([_named(s) for s in all_spans], pa.string())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars, if there, set anew."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lo, hi, data, offsets in text_windows(batch, "text"):
                column = batch.column("text").slice(lo, hi - lo)
                for x, spans in zip(column, scan_texts(data, offsets, sent.value), strict=True):
                    text = x.as_py()
                    if spans:
                        parts, at = [], 0
                        for a, b, _ in spans:
                            if a >= at:
                                parts += [text[at:a], mark]
                            at = max(at, b)
                        text = "".join([*parts, text[at:]])
                    texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    out = docs.mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs, fit_field(docs))
