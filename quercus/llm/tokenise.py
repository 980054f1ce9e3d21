"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.session import spread

#: Fixed values of the public vocabulary: where it lies here, and its splitting pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per Python worker; beyond it the memory starts afresh (speed only, never results).
REMEMBERED = 400_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their merge ranks, which are the ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Merges by a priority queue of ranks over a doubly linked list of symbols."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece. Queue entries are ``(rank, left position, pair)``; an entry
        whose two symbols have changed since it was pushed is stale and skipped."""
        ranks = self.ranks
        n = len(data)
        symbol: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            pair = data[i : i + 2]
            if pair in ranks:
                queue.append((ranks[pair], i, pair))
        heapify(queue)
        while queue:
            _, left, pair = heappop(queue)
            right = after[left]
            if symbol[left] is None or right >= n or symbol[left] + symbol[right] != pair:
                continue
            symbol[left], symbol[right] = pair, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                wider = pair + symbol[after[left]]
                if wider in ranks:
                    heappush(queue, (ranks[wider], left, wider))
            if before[left] >= 0:
                wider = symbol[before[left]] + pair
                if wider in ranks:
                    heappush(queue, (ranks[wider], before[left], wider))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; ``[]`` for the empty text and for null."""
        if not text:
            return []
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their vocabulary strings, one after the other."""
        if not hasattr(self, "strings"):
            self.strings = {i: token for token, i in self.ranks.items()}
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[int, BytePairEncoder] = {}


def _encoder(ranks: dict[bytes, int]) -> BytePairEncoder:
    """One encoder per Python worker and vocabulary (the broadcast's value lives as long as the worker)."""
    return _encoders.setdefault(id(ranks), BytePairEncoder(ranks))


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary as a broadcast; its size is that of the file, whatever the corpus."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: the token ids of every text, one row per row of ``df``.

    Defined cases: null, and a text of length nought, give an empty list; blank texts
    are encoded like any other; texts of any length are encoded whole (a piece without
    a break costs n log n); repeated rows stay repeated; special-token strings are
    ordinary text; an empty table gives no rows; other columns are ignored.
    """
    shared = _vocabulary(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], ["k", "ids"])

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str, into: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in column ``into`` instead of the text.

    Null and empty texts have 0 tokens.
    """
    shared = _vocabulary(df.sparkSession, vocabulary)
    kept = [c for c in df.columns if c != text]
    rows = spread(df.select(*[F.col(c) for c in kept], F.col(text).alias("_text")))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*kept, into])

    return rows.mapInArrow(run, f"{kinds}, `{into}` bigint" if kinds else f"`{into}` bigint")
