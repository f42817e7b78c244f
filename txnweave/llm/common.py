"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles.
STEP_BYTES = 1 << 20

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Where that
    is unset and driver and executors are one process (tests), a temporary folder stands in.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _local_dir


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# --- vectorised words -------------------------------------------------------

#: Bytes of words [^\x20\x09-\x0D]+.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Lower-cases A-Z, and only those.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Spans beyond so many bytes are hashed and compared one by one.
LONG_SPAN = 256
_SEED = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes with eight more behind them, so that eight bytes can be read from each."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _eights(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that starts at each byte of padded data (a view)."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[start:end], eight bytes a step, mixed after each.

    They find candidates; who needs identity compares the bytes (``distinct_spans``, ``WordTable``).
    """
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) + _SEED)
    eights = _eights(padded(data))
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    at, left = starts[live], sizes[live]
    while len(live):
        h[live] = mix((h[live] + _SEED) ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_SPAN):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a[a_at:a_at + size] equals b[b_at:b_at + size], byte for byte. a, b: padded."""
    same = np.ones(len(sizes), bool)
    ea, eb = _eights(a), _eights(b)
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    x, y, left = a_at[live], b_at[live], sizes[live]
    while len(live):
        equal = ((ea[x] ^ eb[y]) & _MASKS[np.minimum(left, 8)]) == 0
        same[live[~equal]] = False
        more = equal & (left > 8)
        live, x, y, left = live[more], x[more] + 8, y[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_SPAN):
        same[i] = np.array_equal(a[a_at[i] : a_at[i] + sizes[i]], b[b_at[i] : b_at[i] + sizes[i]])
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct span, a place of it, number of each span's distinct one); distinct by content."""
    h = span_hashes(data, starts, ends)
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    lead, sizes = first[inverse], ends - starts
    again = np.flatnonzero(lead != np.arange(len(lead)))
    same = sizes[again] == sizes[lead[again]]
    some, room = again[same], padded(data)
    same[same] = same_spans(room, starts[some], room, starts[lead[some]], sizes[some])
    odd = again[~same]
    if len(odd):  # other spans of one hash
        numbers: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            x = data[starts[i] : ends[i]].tobytes()
            if x not in numbers:
                numbers[x] = len(first) + len(more)
                more.append(i)
            inverse[i] = numbers[x]
        keys, first = np.concatenate([keys, h[more]]), np.concatenate([first, more])
    return keys, first, inverse


class WordTable:
    """Numbers of known words: found by hash, then compared byte by byte."""

    def __init__(self, words: list[bytes]):
        self.cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]).astype(np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        hashes = span_hashes(data, self.cuts[:-1], self.cuts[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.keys = hashes[self.order]
        self.data = padded(data)
        twin = np.flatnonzero(self.keys[1:] == self.keys[:-1]) + 1
        self.twins = {words[i]: int(i) for i in self.order[twin].tolist()}

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's word, -1 where it is not known."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys) or not len(starts):
            return out
        h = span_hashes(data, starts, ends)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == h)
        number, sizes = self.order[at[hit]], (ends - starts)[hit]
        same = self.cuts[number + 1] - self.cuts[number] == sizes
        same[same] = same_spans(padded(data), starts[hit[same]], self.data, self.cuts[number[same]], sizes[same])
        out[hit[same]] = number[same]
        if self.twins:
            for i in hit[~same].tolist():
                out[i] = self.twins.get(data[starts[i] : ends[i]].tobytes(), -1)
        return out


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first : int(offsets[-1])] if len(offsets) else data, offsets - first


def row_steps(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``step`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) of the maximal runs of bytes that are not blank."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~blank[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = word.copy()
    starts[1:] &= blank[data[:-1]] | cut[1:n]
    ends = word.copy()
    ends[:-1] &= blank[data[1:]] | cut[1:n]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets, "left")


def hashed_words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = span_hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, or what ``of`` gives, of each word, words before each row) of lower-cased rows.

    A row longer than a step is taken in pieces that end at blanks, so memory
    follows the number of words, not some bytes for each byte of a long text.
    """
    if len(data) <= 4 * STEP_BYTES:
        s, e, at = word_spans(data, offsets, blank)
        return of(data, s, e), at
    found, at, n = [of(data[:0], offsets[:0], offsets[:0])], [0], 0
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        a, b = int(a), int(b)
        while a < b:
            c = min(b, a + STEP_BYTES)
            while c < b and not blank[data[c]]:
                ahead = np.flatnonzero(blank[data[c : c + STEP_BYTES]])
                c = c + int(ahead[0]) if len(ahead) else min(b, c + STEP_BYTES)
            part = data[a:c]
            s, e, _ = word_spans(part, np.array([0, len(part)]), blank)
            found.append(of(part, s, e))
            n += len(s)
            a = c
        at.append(n)
    return np.concatenate(found), np.array(at)
