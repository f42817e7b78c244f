"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus of a replay is the distinct pieces of a step of texts. All their bytes are
symbols in linked lists; an inverted index maps each mergeable pair (by its
rank) to the positions where it stands in any piece. Ranks are replayed from a heap:
the lowest rank's positions are merged from left to right, and only the two
neighbours of each merge enter the index anew. If a merge creates a pair of a lower rank in
the same piece, what remains of that piece waits until the lower rank is done,
as it would when the piece was encoded alone. Encoded pieces are kept in a bounded
dictionary, so a piece is replayed once for many texts.

Rows are encoded where they are read, with no shuffle. The vocabulary (its
size is fixed by its file) is broadcast.

Defined cases: null and empty texts have no ids and decode to nothing; repeated
rows are encoded each; an empty table gives an empty result; extra columns are kept,
but for one that has the name of a result column: the result takes its place.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches, string_parts
from .pretokens import Dictionary, encode_rows

RANKS = "byte_bpe_50k.tiktoken"
_SHIFT = 21


class Merges:
    """Ranks of tokens and of mergeable pairs."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << _SHIFT | b] = rank
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, raw: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in raw]
        hard = []
        for i, x in enumerate(raw):
            whole = self.ranks.get(x)
            if whole is None:
                hard.append(i)
            else:
                out[i] = [whole]
        for i, ids in zip(hard, self.replay([raw[i] for i in hard]), strict=True):
            out[i] = ids
        return out

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: all merges of all pieces in rank order."""
        single, pair = self.single, self.pairs.get
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        piece: list[int] = []
        index: dict[int, list[int]] = {}
        for number, x in enumerate(pieces):
            base, n = len(symbol), len(x)
            symbol += [single[b] for b in x]
            after += range(base + 1, base + n)
            after.append(-1)
            before.append(-1)
            before += range(base, base + n - 1)
            piece += [number] * n
            for i in range(base, base + n - 1):
                rank = pair(symbol[i] << _SHIFT | symbol[i + 1])
                if rank is not None:
                    index.setdefault(rank, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            if len(places) > 1:
                places.sort()
            waiting: set[int] = set()
            later = []
            for i in places:
                left = symbol[i]
                j = after[i]
                if left < 0 or j < 0 or pair(left << _SHIFT | symbol[j]) != rank:
                    continue
                if waiting and piece[i] in waiting:
                    later.append(i)
                    continue
                symbol[i], symbol[j] = rank, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    new = pair(rank << _SHIFT | symbol[k])
                    if new is not None:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(heap, new)
                        if new < rank:
                            waiting.add(piece[i])
                k = before[i]
                if k >= 0:
                    new = pair(symbol[k] << _SHIFT | rank)
                    if new is not None:
                        if new in index:
                            index[new].append(k)
                        else:
                            index[new] = [k]
                            heapq.heappush(heap, new)
                        if new < rank:
                            waiting.add(piece[i])
            if later:
                index[rank] = later
                heapq.heappush(heap, rank)
        out: list[list[int]] = [[] for _ in pieces]
        for s, p in zip(symbol, piece, strict=True):
            if s >= 0:
                out[p].append(s)
        return out


@lru_cache(maxsize=2)
def _merges(raw: bytes) -> Merges:
    return Merges(raw)


@lru_cache(maxsize=2)
def _dictionary(raw: bytes) -> Dictionary:
    return Dictionary(_merges(raw).encode)


def read_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes, for the executors."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _encode(ranks: Broadcast, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _dictionary(ranks.value)
        for batch in batches:
            data, offsets = string_parts(batch.column(0))
            for i, j, ids, ends in encode_rows(data, offsets, words):
                column = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))
                yield pa.record_batch([*[batch.column(1 + c).slice(i, j - i) for c in range(carry)], column], names=[*[f"c{c}" for c in range(carry)], "ids"])

    return run


def encode(spark: SparkSession, docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all, if not given) and the ids of each text."""
    small_batches(spark)
    carry = [c for c in (docs.columns if carry is None else carry) if c != ids_col]
    ranks = read_ranks(spark, path or public_tokenizers.path(RANKS))
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    given = docs.select(F.col(text_col), *[F.col(c) for c in carry]).toDF("text", *[f"c{i}" for i in range(len(carry))])
    return given.mapInArrow(_encode(ranks, len(carry)), schema).toDF(*carry, ids_col)


def _decode(ranks: Broadcast, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _merges(ranks.value).tokens
        for batch in batches:
            texts, raws = [], []
            for ids in batch.column(place):
                ids = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                texts.append(b"".join(map(tokens.__getitem__, ids.tolist())))
                raws.append(ids.astype("<u4").tobytes())
            yield pa.record_batch([*batch.columns[:place], pa.array(raws, pa.binary()), pa.array(texts, pa.binary())], names=[*batch.schema.names[:place], "raw", "decoded"])

    return run


def decode(spark: SparkSession, encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The other columns with ``ids_le`` (little-endian unsigned 32-bit ids) and ``decoded`` (bytes)."""
    ranks = read_ranks(spark, path or public_tokenizers.path(RANKS))
    carry = [c for c in encoded.columns if c not in (ids_col, "ids_le", "decoded")]
    fields = [T.StructField(f"c{i}", encoded.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType([*fields, T.StructField("raw", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    given = encoded.select(*carry, ids_col).toDF(*[f"c{i}" for i in range(len(carry))], "ids")
    return given.mapInArrow(_decode(ranks, len(carry)), schema).toDF(*carry, "ids_le", "decoded")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(spark, documents(spark, sf_dir), carry=["doc_id"])
    out = decode(spark, ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
