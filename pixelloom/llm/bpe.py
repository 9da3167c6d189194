"""Byte-level BPE encoding and decoding with the tokenizers library.

A text is cut into pieces by a pattern; each piece's UTF-8 bytes become characters by
the byte table, and the library's BPE model merges them.  Pieces repeat, so a worker
keeps the ids of short ones, in a table of bounded size.  Decoding reverses the byte table: ids to
bytes, and bytes to text only when joined, so characters that two tokens split are whole
again; bytes that are no UTF-8 become U+FFFD.

Results for odd input: a null or empty text has no ids, and its digests are those of no
bytes; repeated rows are encoded alike; very long pieces are merged but not kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from pixelloom.llm.tokens import tidied

KEPT_PIECES = 250_000  # pieces whose ids a worker keeps
KEPT_LENGTH = 40

#: Fixed value: the pattern that the standard library's faster engine can stand in for.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# On characters below U+0250, these few aside, both engines know the same letters, numbers and white space.
_PLAIN_PATTERN = re.compile(r""" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


@lru_cache(maxsize=1)
def byte_table() -> dict[int, str]:
    """The character of each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def to_chars(piece: bytes) -> str:
    return piece.decode("latin-1").translate(byte_table())


@lru_cache(maxsize=4)
def _model_of_ranks(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges from a rank file.

    The rank file joins any two neighbours whose bytes together are a token, lowest rank
    first; so every split of a token into two tokens is a merge, in order of the ranks.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    names = {token: to_chars(token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        whole = names[token]
        for k in range(1, len(token)):
            if token[:k] in ranks and token[k:] in ranks:
                merges.append((whole[:k], whole[k:]))
    return {names[t]: r for t, r in ranks.items()}, merges


@lru_cache(maxsize=4)
def model_json(path: str) -> str:
    """The BPE model of a rank file or a tokenizers file, as text to send to the workers."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        return json.dumps({"vocab": model["vocab"], "merges": merges, "whole": bool(model.get("ignore_merges"))})
    vocab, merges = _model_of_ranks(path)
    return json.dumps({"vocab": vocab, "merges": [" ".join(m) for m in merges], "whole": True})


class Encoder:
    """Ids of texts under one model and pattern."""

    def __init__(self, model: str, pattern: str):
        parts = json.loads(model)
        self.vocab = parts["vocab"]
        bpe = BPE(vocab=self.vocab, merges=[tuple(m.split(" ")) for m in parts["merges"]], ignore_merges=parts["whole"], cache_capacity=0)
        self.tokenizer = Tokenizer(bpe)
        self.pattern = regex.compile(pattern)
        self.common = pattern == COMMON_PATTERN
        back = {c: b for b, c in byte_table().items()}
        size = max(self.vocab.values()) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for name, i in self.vocab.items():
            self.token_bytes[i] = bytes(back[c] if c in back else 0x3F for c in name) if all(c in back for c in name) else name.encode()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.kept = _Kept(self)

    def piece_ids(self, piece: str) -> list[int]:
        """The library's ids of one piece."""
        return [t.id for t in self.tokenizer.model.tokenize(to_chars(piece.encode("utf-8", "surrogatepass")))]

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, in order."""
        if self.common and (text.isascii() and text.isprintable() or not _NOT_PLAIN.search(text)):
            return _PLAIN_PATTERN.findall(text)
        return self.pattern.findall(text)

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, self.pieces(text)))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's first character and the end past its last one; a token that holds
        a part of a character spans that whole character."""
        lengths = np.fromiter((len(self.token_bytes[i]) for i in ids.tolist()), np.int64, len(ids))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        if not len(ids):
            return ends, ends
        return char[ends - lengths], char[ends - 1] + 1


_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class _Kept(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.encoder.piece_ids(piece)).tobytes() if _LITTLE else np.array(self.encoder.piece_ids(piece), "<u4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            self[piece] = out
        return out


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder_of(model: str, pattern: str) -> Encoder:
    """This worker's encoder for a model; made once."""
    key = (hash(model), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, pattern)
    return _encoders[key]


def _names(docs: DataFrame, extra: list[str]) -> list[str]:
    return [c for c in docs.columns if c not in extra]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, starts and ends (character offsets) of its texts.

    Columns of ``docs`` with these three names give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model_json(path))
    out = [pa.field("ids", pa.list_(pa.int32())), pa.field("starts", pa.list_(pa.int32())), pa.field("ends", pa.list_(pa.int32()))]
    kept = docs.select(_names(docs, ["ids", "starts", "ends"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", ids array<int>, starts array<int>, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(sent.value, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            ids = [coder.ids(x) for x in texts]
            spans = [coder.offsets(x, i) for x, i in zip(texts, ids, strict=True)]
            new = [ids, [s for s, _ in spans], [e for _, e in spans]]
            columns = [*batch.columns, *(pa.array([np.asarray(x, np.int32) for x in c], f.type) for c, f in zip(new, out, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*batch.schema, *out]))

    return kept.mapInArrow(tidied(run), schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with a column ``decoded`` for its arrays of ids; a null array decodes to an empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(model_json(path))
    kept = tokens.select(_names(tokens, ["decoded"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(sent.value, pattern)
        for batch in batches:
            texts = [coder.decode(np.asarray(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=pa.schema([*batch.schema, pa.field("decoded", pa.string())]))

    return kept.mapInArrow(tidied(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(sent.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                counts, ids_sha, text_sha = [], [], []
                for x in part.column(1):
                    packed = coder.packed(x.as_py() or "")
                    ids = np.frombuffer(packed, "<u4")
                    counts.append(len(ids))
                    ids_sha.append(sha(packed).hexdigest())
                    text_sha.append(sha(coder.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
