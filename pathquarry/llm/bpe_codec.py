"""Byte-level BPE encoding and decoding.

Method: bytes become Latin-1 characters for pyahocorasick; the encoder takes
longest matches and backtracks on incompatible neighbours (see _bpe), which
reproduces the merges exactly in linear time.

Null text counts as empty: no tokens, and the digests of nothing.  Repeated
rows give repeated rows; a null doc_id stays null; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._bpe import Memo, PairBpe, byte_vocabulary
from ._common import frugal, small_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_AWKWARD = re.compile(r" \s|\s |[\x1c-\x1f\x85]")
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    def __init__(self, path: str, pattern: str):
        self.bytes_of = byte_vocabulary(path)
        self.bpe = PairBpe([t.decode("latin-1") for t in self.bytes_of])
        self.pieces = regex.compile(pattern)
        self.piece = Memo(self._piece)
        self.first, self.spaced = Memo(self._several), Memo(lambda s: self._several(" " + s))

    def _piece(self, piece: str) -> bytes:
        ids = self.bpe.encode(piece.encode().decode("latin-1"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _several(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No match of the pattern joins a space with what stands before it, so a
        text without runs of white space around its spaces is encoded space by
        space, and each such part is memoised.
        """
        if _AWKWARD.search(text):
            return self._several(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary, from the ids)."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    small_batches(docs.sparkSession)

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            ids = [own.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Round trip of every document, as digests; ids and decoded bytes stay in the worker."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    small_batches(docs.sparkSession)

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for t in b.column("text").to_pylist():
                ids = own.encode(t or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                out_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), SCHEMA)
