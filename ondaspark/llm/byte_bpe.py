"""Byte-level BPE by a sentencepiece model that is serialised straight from the rank file; nothing is trained.

Each vocabulary entry becomes a piece: its bytes mapped one by one to
printable characters, its score the negative rank, the normaliser identity.
Merging the best-scored neighbouring pair, leftmost first, is then merging by
rank. Texts are cut into pre-tokens by the public pattern and each pre-token
is encoded on its own; decoding maps ids to their bytes.

Defined cases: null and empty texts have no ids and decode to nothing;
repeated rows are encoded alike; other columns are ignored by ``encode`` and
kept by nothing else; a text of any length is encoded whole, one row at a
time, so memory follows the longest text.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, bounded_batches, documents, keeps
from .pretokens import PieceCache

#: Pre-tokens and pieces whose ids a worker remembers.
CACHE_TOKENS, CACHE_PIECES = 100_000, 100_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself if printable Latin-1 and no space, else the next free one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: the pieces in rank order, then an unknown piece that byte-mapped text never needs."""
    letters = byte_alphabet()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for rank, token in enumerate(by_rank):
        text = "".join(letters[b] for b in token).encode()
        out += _message(1, _message(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))  # normal
    out += _message(1, _message(1, "<unk>".encode()) + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))  # unknown
    none = (1 << 64) - 1
    # trainer: model type BPE, vocabulary size, ids of unk, bos, eos, pad
    out += _message(2, _number(3, 2) + _number(4, len(by_rank) + 1) + _number(40, len(by_rank)) + _number(41, none) + _number(42, none) + _number(43, none))
    # normaliser: identity, no dummy prefix, no removed or escaped spaces
    out += _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.letters = dict(zip((chr(b) for b in range(256)), byte_alphabet(), strict=True))
        self.table = str.maketrans(self.letters)
        self.known = {t: struct.pack("<I", i) for t, i in ranks.items()}
        self.seen: dict[str, bytes] = {}
        self.cache = PieceCache(self._pieces, CACHE_PIECES)

    def _learn(self, tokens: set[str]) -> None:
        """Ids of pre-tokens not seen lately. An entry of the vocabulary stands for itself; the model merges the rest."""
        rest = []
        for token in tokens:
            whole = self.known.get(token.encode())
            if whole is None:
                rest.append(token)
            else:
                self.seen[token] = whole
        mapped = [t.encode().decode("latin-1").translate(self.table) for t in rest]
        for token, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
            self.seen[token] = array("I", ids).tobytes()

    def _pieces(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        tokens = set().union(*found)
        if len(self.seen) > CACHE_TOKENS:
            self.seen.clear()
        missing = tokens.difference(self.seen)
        if missing:
            self._learn(missing)
        get = self.seen.__getitem__
        return [get(f[0]) if len(f) == 1 else b"".join(map(get, f)) for f in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.cache.many(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_models: dict[str, ByteBPE] = {}


def model(path: str) -> ByteBPE:
    """One per worker process and vocabulary file, kept until another operator begins there."""
    if path not in _models:
        keeps("byte_bpe", _models.clear)
        _models[path] = ByteBPE(read_ranks(path), pattern())
    return _models[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), a row per document."""
    path = path or vocabulary_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe")
        bpe = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (binary)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe")
        bpe = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [bpe.decode(x.as_py() or b"") for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (binary): decode(encode(docs)) with one Python worker a task, and so one model, for both."""
    path = path or vocabulary_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe")
        bpe = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                out = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode, and the digests of both. Encoding and decoding are one Python stage: nothing is shuffled."""
    both = round_trip(docs, path)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
