"""Byte-level BPE encoding and decoding in numpy.

Texts are cut by the tokenizer's pattern. Pieces not met before are encoded together: they are dealt into
buckets by length, each bucket is a padded matrix of token ids, and in every round every row merges its leftmost
pair of minimum rank, found through an open-addressing hash table of pairs. Rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged

NONE = np.int32(2**31 - 1)
#: Pieces longer than this are merged one at a time with a heap: a padded row costs the square of its length.
LONGEST_ROW = 256
#: Pieces that a worker remembers; beyond it the memory is emptied.
REMEMBERED = 300_000


class Vocabulary:
    """Tokens, and the hash table of mergeable pairs, of a rank file's content."""

    def __init__(self, ranks_file: bytes):
        pairs = (line.split() for line in ranks_file.splitlines() if line.strip())
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.byte_id = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.length = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        left, right, made = [], [], []
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
        self._index(np.array(left, np.uint64), np.array(right, np.uint64), np.array(made, np.int32))
        self.known: dict[str, int] = {}
        self._forget()

    # --- hashed pair lookup -------------------------------------------------------------------------

    def _index(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        bits = int(np.ceil(np.log2(max(16, 3 * len(made)))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        key = ((left << np.uint64(32)) | right).astype(np.int64)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]  # of several for one slot the last stays
            placed = self.keys[at] == key[todo]
            self.values[at[placed]] = made[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE where there is none. Ids below 0 are padding."""
        out = np.full(left.shape, NONE, np.int32)
        where = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left.ravel()[where].astype(np.int64) << 32) | right.ravel()[where]
        slot, flat = self._slot(key), out.ravel()
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == key
            flat[where[hit]] = self.values[slot[hit]]
            rest = ~hit & (held != -1)
            if not rest.any():
                break
            where, key, slot = where[rest], key[rest], (slot[rest] + 1) & self.mask
        return flat.reshape(left.shape)

    # --- merging ------------------------------------------------------------------------------------

    def merge_matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of a padded (-1) matrix of byte ids."""
        out: list[np.ndarray] = [None] * len(rows)
        number = np.arange(len(rows))
        ranks = self.pair_rank(rows[:, :-1], rows[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)  # the first minimum: the leftmost pair
            line = np.arange(len(rows))
            best = ranks[line, at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[number[i]] = rows[i][rows[i] >= 0]
                keep = ~done
                rows, ranks, number, at, best = rows[keep], ranks[keep], number[keep], at[keep], best[keep]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            width = rows.shape[1]
            column = np.arange(width)
            source = np.minimum(column + (column > at[:, None]), width - 1)
            rows = np.take_along_axis(rows, source, axis=1)
            rows[:, -1] = -1
            rows[line, at] = best
            source = np.minimum(column[:-1] + (column[:-1] > at[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ranks[:, -1] = NONE
            right = np.minimum(at + 1, width - 1)
            ranks[line, np.minimum(at, width - 2)] = self.pair_rank(rows[line, at], np.where(at + 1 < width, rows[line, right], -1))
            before = at > 0
            ranks[line[before], at[before] - 1] = self.pair_rank(rows[line[before], at[before] - 1], rows[line[before], at[before]])
            used = int((rows >= 0).sum(axis=1).max())
            if used < width and used >= 2:  # compaction: drop columns that no row uses
                rows, ranks = rows[:, :used], ranks[:, : used - 1]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece by a heap of (rank, position); the same result."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        rank = [*first.tolist(), int(NONE)]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def pair(a: int, b: int) -> int:
            key = (a << 32) | b
            slot = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[slot] != -1:
                if self.keys[slot] == key:
                    return int(self.values[slot])
                slot = (slot + 1) & self.mask
            return int(NONE)

        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank[i] != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            rank[j] = int(NONE)
            for k in (i, before[i]):
                if k >= 0:
                    rank[k] = pair(ids[k], ids[after[k]]) if after[k] < n else int(NONE)
                    if rank[k] != NONE:
                        heapq.heappush(heap, (rank[k], k))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONGEST_ROW:
                out[i] = self.merge_long(p)
            else:
                buckets.setdefault((len(p) + 3) // 4 * 4, []).append(i)
        for width, members in buckets.items():
            for lo in range(0, len(members), 8192):
                some = members[lo : lo + 8192]
                lens = np.array([len(pieces[i]) for i in some])
                rows = np.full((len(some), width), -1, np.int32)
                rows[np.arange(width) < lens[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)]
                for i, ids in zip(some, self.merge_matrix(rows), strict=True):
                    out[i] = ids
        return out

    # --- texts --------------------------------------------------------------------------------------

    def _forget(self) -> None:
        self.known.clear()
        self.piece_start, self.piece_length, self.piece_ids = (np.zeros(0, np.int64) for _ in range(3))
        self.piece_ids = self.piece_ids.astype(np.int32)

    def _learn(self, pieces: list[str]) -> None:
        encoded = self.encode_pieces([p.encode() for p in pieces])
        lengths = np.array([len(x) for x in encoded], np.int64)
        starts = len(self.piece_ids) + np.cumsum(lengths) - lengths
        for i, p in enumerate(pieces, len(self.known)):
            self.known[p] = i
        self.piece_ids = np.concatenate([self.piece_ids, *encoded])
        self.piece_start = np.concatenate([self.piece_start, starts])
        self.piece_length = np.concatenate([self.piece_length, lengths])

    def encode_texts(self, texts: list[str], pattern) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        pieces = [pattern.findall(t) for t in texts]
        fresh = {p for some in pieces for p in some if p not in self.known}
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self._forget()
                fresh = {p for some in pieces for p in some}
            self._learn(sorted(fresh))
        counts = np.array([len(x) for x in pieces], np.int64)
        look = self.known.__getitem__
        index = np.fromiter((look(p) for some in pieces for p in some), np.int64, int(counts.sum()))
        lengths = self.piece_length[index]
        ids = self.piece_ids[ragged(self.piece_start[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)

    def decode_ids(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id lists, one after the other, and the number of bytes of each."""
        lengths = self.length[ids]
        out = self.bytes[ragged(self.start[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return out, np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def _vocabulary(ranks_file: bytes) -> Vocabulary:
    return Vocabulary(ranks_file)


def _rank_file(spark: SparkSession, path: str) -> bytes:
    """A rank file's content: local to the driver, or any path that Spark reads. Its size is that of a vocabulary."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters together."""
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + 4096]), most)))
        yield lo, min(hi, len(sizes))
        lo = hi


def bpe_encode(docs: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """Adds ``out_col``, array<int>: the ids of each whole text; a null or empty text has none.

    Every other column is kept (a column named ``out_col`` is replaced). Rows stay where they are: no shuffle.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(_rank_file(spark, vocab_path))
    docs = docs.drop(out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        vocab, cut = _vocabulary(held.value), regex.compile(pattern)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _slices(sizes + 1, 1 << 20):
                part = batch.slice(lo, hi - lo)
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                ids, counts = vocab.encode_texts(texts, cut)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out_col])

    return docs.mapInArrow(encode, schema)


def bpe_decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, binary: the bytes of each row's ids; null ids give no bytes."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(_rank_file(spark, vocab_path))
    df = df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType(), False)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(held.value)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _slices(sizes + 1, 1 << 18):
                part = batch.slice(lo, hi - lo)
                ids = part.column(ids_col).flatten().to_numpy(zero_copy_only=False)
                data, counts = vocab.decode_ids(ids, sizes[lo:hi].astype(np.int64))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out_col])

    return df.mapInArrow(decode, schema)


def ids_digest(ids) -> "F.Column":
    """sha256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
