"""Encoding a corpus with a public byte-level BPE, and decoding it again.

The vocabulary is a local rank file read once per Python worker. Texts are cut
before encoding only where the pre-splitting pattern must cut anyway (between a
character that is no white space and one that is), so a cut never changes an id.

Defined cases: a null or empty text has the empty list; every other text,
however long, is encoded whole; texts are never normalised; rows keep their
other columns out of the result, so clashing names cannot occur.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Longest run of characters handed to the encoder at once.
PIECE_CHARS = 200_000
_CUT = re.compile(r"(?<=\S)(?=\s)")


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where this machine keeps a public rank file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """The encoder of a rank file; one per worker process."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(path or rank_file(), "rb") as file:
        for line in file:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a long text at boundaries every encoding of it has."""
    pieces, start = [], 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        pieces.append(text[start : found.start()])
        start = found.start()
    pieces.append(text[start:])
    return pieces


def encode_text(text: str | None, path: str | None = None) -> list[int]:
    if not text:
        return []
    encode = encoder(path).encode_ordinary
    if len(text) <= PIECE_CHARS:
        return encode(text)
    return [i for piece in safe_pieces(text) for i in encode(piece)]


def decode_ids(ids, path: str | None = None) -> bytes:
    """The raw bytes of a list of ids."""
    return encoder(path).decode_bytes(list(ids)) if ids is not None else b""


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: the key and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(t, path) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    source = spread(df.select(F.col(key), F.col(text).alias("text")))
    schema = T.StructType([source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: the key and ``n_tokens``; the ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(encode_text(t, path)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    source = spread(df.select(F.col(key), F.col(text).alias("text")))
    schema = T.StructType([source.schema[key], T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(run, schema)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """The key, ``raw`` (bytes) and ``text``, undecodable bytes as U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [decode_ids(x, path) for x in batch.column(1).to_pylist()]
            text = [x.decode("utf-8", errors="replace") for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array(text, pa.string())], [key, "raw", "text"]
            )

    source = df.select(F.col(key), F.col(ids).alias("ids"))
    schema = T.StructType([source.schema[key], T.StructField("raw", T.BinaryType()), T.StructField("text", T.StringType())])
    return source.mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and compare: the key, ``n_tokens``, ``n_bytes`` and ``same``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [encode_text(t) for t in texts]
            raw = [decode_ids(x) for x in ids]
            same = [r == (t or "").encode() for r, t in zip(raw, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array(same, pa.bool_()),
                ],
                [key, "n_tokens", "n_bytes", "same"],
            )

    source = spread(df.select(F.col(key), F.col(text).alias("text")))
    schema = T.StructType(
        [
            source.schema[key],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("same", T.BooleanType()),
        ]
    )
    return source.mapInArrow(run, schema)
