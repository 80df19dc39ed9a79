"""Byte-level BPE with a public vocabulary.

A text is cut into words by the vocabulary's public pattern; each word's bytes are a doubly linked list of
symbols, and a priority queue holds the merges that are possible, lowest rank first, leftmost first among
equals. An entry whose symbols have changed since it was pushed is stale and skipped, so a word of n bytes takes
n log n steps however long it is. Decoding concatenates the vocabulary's strings.

The vocabulary file, whose path on the driver is a parameter, is shipped with the job and read once in each Python worker.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the published pattern of this vocabulary.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHED_WORDS, _CACHED_BYTES = 200_000, 64


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the file: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        self.single = [vocab[letters[b]] for b in range(256)]
        self.strings = {i: bytes(bytes_of[c] for c in s) for s, i in vocab.items() if all(c in bytes_of for c in s)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # (left, right) -> rank and merged symbol; the last 2**20 values hold the symbol
        self.merges = {(vocab[a] << 20) | vocab[b]: (rank << 20) | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.words = regex.compile(WORDS)
        self._seen: dict[str, list[int]] = {}

    def _merge(self, data: bytes) -> list[int]:
        symbols = [self.single[b] for b in data]
        n, merges = len(symbols), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get((symbols[i] << 20) | symbols[i + 1])
            if m is not None:
                queue.append((m, i))
        heapq.heapify(queue)
        while queue:
            m, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n or merges.get((symbols[i] << 20) | symbols[j]) != m:
                continue  # stale
            symbols[i], symbols[j] = m & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = merges.get((symbols[i] << 20) | symbols[k])
                if new is not None:
                    heapq.heappush(queue, (new, i))
            h = before[i]
            if h >= 0:
                new = merges.get((symbols[h] << 20) | symbols[i])
                if new is not None:
                    heapq.heappush(queue, (new, h))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, special tokens' strings taken as plain text; an empty list for null or empty text."""
        out: list[int] = []
        if not text:
            return out
        seen = self._seen
        for word in self.words.findall(text):
            ids = seen.get(word)
            if ids is None:
                data = word.encode("utf-8", "surrogatepass")
                ids = self._merge(data)
                if len(data) <= _CACHED_BYTES:
                    if len(seen) >= _CACHED_WORDS:
                        seen.clear()
                    seen[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids that :meth:`encode` gave."""
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Bpe:
    return Bpe(path)


def _shipped(df: DataFrame, path: str) -> None:
    """Sends the vocabulary file to the executors; sending it again changes nothing."""
    df.sparkSession.sparkContext.addFile(path)


def _at_hand(path: str) -> Bpe:
    """The vocabulary in a worker: the shipped file."""
    return vocabulary(SparkFiles.get(os.path.basename(path)))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key, ids`` (array of int) for every row, in one pass without a shuffle.

    Null and empty texts have an empty list; repeated rows come out repeated; a null key is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _at_hand(path).encode
        for batch in batches:
            keys, ids, size, first = batch[0], [], 0, 0
            for k, value in enumerate(batch[1]):
                ids.append(encode(value.as_py()))
                size += len(ids[-1])
                if size > 1_000_000:  # very long texts: several smaller batches
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(ids)), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
                    ids, size, first = [], 0, k + 1
            yield pa.RecordBatch.from_arrays([keys.slice(first, len(ids)), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    _shipped(df, path)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return rows.select(F.col("id").alias(key), "ids")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``tokens``, the number of ids of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _at_hand(path).encode
        for batch in batches:
            sizes = pa.array([len(encode(v.as_py())) for v in batch[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes], names=[*batch.schema.names[1:], "tokens"])

    _shipped(df, path)
    kinds = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    rows = df.select(F.col(text).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).mapInArrow(run, f"{kinds}, tokens bigint")
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "tokens")
