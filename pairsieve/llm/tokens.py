"""Encoding a whole corpus with a public tokenizer.

Encoding is a monoid: texts join, and so do their ids, if the join repairs the tokens at the
boundary. A long text is encoded by halves, recursively. Two neighbours are joined by re-encoding a
window around the boundary. The window ends at certain cuts: places between a letter or digit and a
space that a letter or digit follows. No pre-token of the vocabulary's pattern spans such a place,
whatever stands around it, and merges never leave a pre-token; so the tokens outside the window are
those of the joined text. A window without a certain cut on a side grows, at last to the whole side.
Decoding concatenates up the same tree: the bytes of two lists of ids, joined, are those of the joined list.

The vocabulary file is sent to the executors once by the session (SparkContext.addFile), so only the
driver needs its path. Empty and null texts have an empty list, and empty and null lists an empty text. Duplicate ids give a row each. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.plans.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 512
WINDOW = 64


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a file of ranks; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship(spark: SparkSession, path: str) -> str:
    """Send the vocabulary to all executors; the name under which `shipped` finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str):
    """The encoder of a shipped vocabulary, in a task."""
    return encoder(SparkFiles.get(name))


def _certain_cut(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1].isalnum() and text[at - 1].isascii() and text[at + 1].isascii() and text[at + 1].isalnum()


def join(enc, text: str, start: int, mid: int, end: int, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
    """ids of text[start:end] from those of its two sides."""
    w = window
    while True:
        p = next((i for i in range(mid - 1, max(start, mid - w), -1) if _certain_cut(text, i)), start if mid - w <= start else None)
        if p is not None:
            break
        w *= 2
    w = window
    while True:
        q = next((i for i in range(mid + 1, min(end - 1, mid + w)) if _certain_cut(text, i)), end if mid + w >= end else None)
        if q is not None:
            break
        w *= 2
    keep = len(left) - len(enc.encode_ordinary(text[p:mid]))
    skip = len(enc.encode_ordinary(text[mid:q]))
    return left[:keep] + enc.encode_ordinary(text[p:q]) + right[skip:]


def encode(enc, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """ids of a text by tree reduction over leaves of at most `leaf` characters."""

    def part(start: int, end: int) -> list[int]:
        if end - start <= leaf:
            return enc.encode_ordinary(text[start:end])
        mid = (start + end) // 2
        return join(enc, text, start, mid, end, part(start, mid), part(mid, end), window)

    return part(0, len(text))


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """key, ids array<int> for every row."""
    kind = df.schema[key].dataType.simpleString()
    name = ship(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shipped(name)
        for b in batches:
            rows = [encode(enc, t, leaf) if t else [] for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """`df` without its text and with the number of tokens of the text; 0 for empty and null texts."""
    rest = [c for c in df.columns if c != text]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    name = ship(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shipped(name)
        for b in batches:
            n = [len(encode(enc, t, leaf)) if t else 0 for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n, pa.int64())], names=[*rest, out])

    return spread(df.select(*rest, text)).mapInArrow(run, f"{kinds}, {out} bigint")


def decode(enc, ids: list[int], leaf: int = LEAF) -> str:
    """The text of a list of ids, by tree reduction over leaves of at most `leaf` ids. A character may
    spread over the ids of two leaves, so bytes are joined and read as text at the root."""

    def part(start: int, end: int) -> bytes:
        if end - start <= leaf:
            return enc.decode_bytes(ids[start:end])
        mid = (start + end) // 2
        return part(start, mid) + part(mid, end)

    return part(0, len(ids)).decode("utf-8", errors="replace")


def decode_column(df: DataFrame, key: str, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """key and the text of the ids of every row."""
    kind = df.schema[key].dataType.simpleString()
    name = ship(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shipped(name)
        for b in batches:
            texts = pa.array([decode(enc, i, leaf) if i else "" for i in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[key, out])

    return df.select(key, ids).mapInArrow(run, f"{key} {kind}, {out} string")


def corpus_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every document."""
    return encode_column(documents.where(F.col("doc_id").isNotNull()), "doc_id", "text", vocabulary)
