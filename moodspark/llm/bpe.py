"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text without white space has no safe boundary for cutting and meets the pattern whole:
memory follows the text's length, as it does for the text itself.

Null and empty texts have no ids. Rows are independent: repeated rows give
repeated results, an empty table an empty one. Other columns are carried along;
one that is named like a result column is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark.llm.common import cached, field, map_column, table

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DEFAULT_PATTERN = public_tokenizers.PATTERN
#: Code points from which a text is cut before it meets the splitting pattern.
CHUNK_CHARS = 1 << 16
#: No match of the pattern goes on from another character to white space, so a
#: text may be cut before white space that follows something else.
SAFE_CUT = re.compile(r"(?<=\S)(?=\s)")


def read_ranks(rank_path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens."""
    with open(rank_path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def load_encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """An encoding without special tokens."""
    ranks = read_ranks(rank_path)
    digest = hashlib.sha256(pattern.encode()).hexdigest()[:8]
    return tiktoken.Encoding(f"local-{len(ranks)}-{digest}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK_CHARS):
    """Cut a long text at safe boundaries into parts of about ``size`` code points."""
    start, n = 0, len(text)
    while n - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None or cut.start() >= n:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, dtype="<u4")
    if len(text) <= CHUNK_CHARS:
        return np.asarray(encoding.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.asarray(encoding.encode_ordinary(part), dtype="<u4") for part in chunks(text)])


def packed_ids(values: list, rank_path: str, pattern: str) -> pa.Array:
    encoding = cached(("bpe", rank_path, pattern), lambda: load_encoding(rank_path, pattern))
    return pa.array([encode_text(encoding, v).tobytes() for v in values], pa.binary())


def joined_tokens(values: list, rank_path: str) -> pa.Array:
    tokens = cached(("bpe tokens", rank_path), lambda: {rank: token for token, rank in read_ranks(rank_path).items()})
    return pa.array([None if v is None else b"".join([tokens[i] for i in np.frombuffer(v, dtype="<u4").tolist()]) for v in values], pa.binary())


def encode(
    df: DataFrame,
    text: str = "text",
    ids: str = "token_ids",
    rank_path: str = DEFAULT_RANKS,
    pattern: str = DEFAULT_PATTERN,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the packed token ids of ``text`` (binary, 4 bytes an id, little endian)."""
    return map_column(df, text, lambda values: [packed_ids(values, rank_path, pattern)], [field(ids, T.BinaryType())], keep)


def decode(
    df: DataFrame,
    ids: str = "token_ids",
    raw: str = "raw_bytes",
    rank_path: str = DEFAULT_RANKS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the bytes that packed ids stand for; ids may end inside a character. Null ids give null."""
    return map_column(df, ids, lambda values: [joined_tokens(values, rank_path)], [field(raw, T.BinaryType())], keep)


def round_trip(
    df: DataFrame,
    text: str = "text",
    ids: str = "token_ids",
    raw: str = "raw_bytes",
    rank_path: str = DEFAULT_RANKS,
    pattern: str = DEFAULT_PATTERN,
    keep: list[str] | None = None,
) -> DataFrame:
    """``encode`` and then ``decode`` in one Python worker a task; two maps in a row hold two, which an executor keeps for later stages."""

    def run(values: list) -> list[pa.Array]:
        packed = packed_ids(values, rank_path, pattern)
        return [packed, joined_tokens(packed.to_pylist(), rank_path)]

    return map_column(df, text, run, [field(ids, T.BinaryType()), field(raw, T.BinaryType())], keep)


def unpack(df: DataFrame, ids: str = "token_ids", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add packed ids as an array of integers, for callers that want one. Null ids give null."""

    def run(values: list) -> list[pa.Array]:
        return [pa.array([None if v is None else np.frombuffer(v, dtype="<u4") for v in values], pa.list_(pa.int64()))]

    return map_column(df, ids, run, [field(out, T.ArrayType(T.LongType()))], keep)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, keep=["doc_id"])
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("token_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("raw_bytes"), 256).alias("decoded_sha256"),
    )
