"""Byte-level BPE encoding and decoding over padded numpy matrices.

Each match of the split pattern is encoded separately.  The distinct pieces of a
slice of rows are put in matrices by length bucket (one row a piece, padded); in
each round every row merges its leftmost pair of minimum rank, looked up in an
open-addressing hash table of all pairs, and finished rows are compacted away.
Pieces longer than LONGEST bytes, which would need as many rounds as bytes, are
merged in the same order with a heap.  Special tokens aren't recognised.

Defined cases: a null text counts as empty (no ids, empty bytes); ids that the
vocabulary lacks decode to nothing; other columns are carried, those named like a
requested output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, free_name, lean, shipped

#: bytes of a piece that a matrix row holds at most
LONGEST = 512
#: characters of text whose distinct pieces a task holds at once
SLICE_CHARS = 1_000_000
NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
TABLE_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
FIELDS = {
    "ids": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    "decoded": (pa.binary(), T.BinaryType()),
    "n_tokens": (pa.int64(), T.LongType()),
    "ids_sha256": (pa.string(), T.StringType()),
    "decoded_sha256": (pa.string(), T.StringType()),
}


class Vocabulary:
    """Ranks of a tiktoken file, its pair table and its bytes for decoding."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.lens = np.fromiter(map(len, tokens), np.int64, size)
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.fromiter((self.ranks[bytes([b])] for b in range(256)), np.int32, 256)
        get = self.ranks.get
        pairs = [(left, right, r) for t, r in self.ranks.items() for i in range(1, len(t))
                 if (left := get(t[:i])) is not None and (right := get(t[i:])) is not None]
        left, right, rank = np.array(pairs, np.int64).T
        self.keys, self.values = self._table((left << 32 | right).astype(np.uint64), rank.astype(np.int32))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * MIX >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _table(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = (1 << TABLE_BITS) - 1
        tk, tv = np.full(mask + 1, EMPTY), np.full(mask + 1, NONE, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            pos = (self._slot(keys[left]) + step) & mask
            free = tk[pos] == EMPTY
            tk[pos[free]] = keys[left[free]]
            won = tk[pos] == keys[left]
            tv[pos[won]] = values[left[won]]
            left, step = left[~won], step + 1
        return tk, tv

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge (or one side is padding, -1)."""
        mask = (1 << TABLE_BITS) - 1
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32)
        pos = self._slot(key)
        seen = self.keys[pos]
        out = np.where(seen == key, self.values[pos], NONE)
        more = np.flatnonzero((seen != key) & (seen != EMPTY))
        step = 1
        while len(more):
            p = (pos[more] + step) & mask
            seen = self.keys[p]
            hit = seen == key[more]
            out[more[hit]] = self.values[p[hit]]
            more, step = more[~hit & (seen != EMPTY)], step + 1
        out[(left < 0) | (right < 0)] = NONE
        return out

    def _matrix(self, mat: np.ndarray) -> list[np.ndarray]:
        """Merged ids of each row of a padded matrix of byte ids."""
        out: list[np.ndarray] = [None] * len(mat)  # type: ignore[list-item]
        row = np.arange(len(mat))
        width = mat.shape[1]
        ranks = self.pair_rank(mat[:, :-1].ravel(), mat[:, 1:].ravel()).reshape(len(mat), width - 1)
        cols = np.arange(width)
        while len(mat):
            j = ranks.argmin(1)
            best = ranks[np.arange(len(mat)), j]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    ids = mat[k]
                    out[row[k]] = ids[ids >= 0].copy()
                live = ~done
                mat, ranks, row, j, best = mat[live], ranks[live], row[live], j[live], best[live]
                if not len(mat):
                    break
            at = np.arange(len(mat))
            after = cols[None, :] > j[:, None]
            mat = np.where(after, np.pad(mat[:, 1:], ((0, 0), (0, 1)), constant_values=-1), mat)
            ranks = np.where(after[:, :-1], np.pad(ranks[:, 1:], ((0, 0), (0, 1)), constant_values=NONE), ranks)
            mat[at, j] = best
            # the pairs on both sides of the merged token are new
            right = np.where(j + 1 < width, mat[at, np.minimum(j + 1, width - 1)], -1)
            in_right = j < width - 1
            ranks[at[in_right], j[in_right]] = self.pair_rank(mat[at, j], right)[in_right]
            has_left = j > 0
            ranks[at[has_left], j[has_left] - 1] = self.pair_rank(mat[at, j - 1], mat[at, j])[has_left]
            longest = int((mat >= 0).sum(1).max())
            if longest < width:
                width = max(longest, 2)
                mat, ranks, cols = mat[:, :width], ranks[:, : width - 1], cols[:width]
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        text = {r: t for t, r in self.ranks.items()} if not hasattr(self, "_text") else self._text
        self._text = text
        rank = lambda a, b: self.ranks.get(text[a] + text[b])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (s := rank(r, ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[nxt[i]]))
            if (p := prv[i]) >= 0 and (s := rank(ids[p], r)) is not None:
                heapq.heappush(heap, (s, p, ids[p], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = defaultdict(list)
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(p) > LONGEST:
                out[k] = self._long(p)
            else:
                buckets[1 << (len(p) - 1).bit_length()].append(k)
        for width, rows in buckets.items():
            for first in range(0, len(rows), step := max(1, 2_000_000 // width)):
                some = rows[first : first + step]
                mat = np.full((len(some), width), -1, np.int32)
                lens = np.fromiter((len(pieces[k]) for k in some), np.int64, len(some))
                flat = np.frombuffer(b"".join(pieces[k] for k in some), np.uint8)
                mat[np.arange(width)[None, :] < lens[:, None]] = self.byte_id[flat]
                for k, ids in zip(some, self._matrix(mat), strict=True):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; pieces that occur again are encoded once."""
        index: dict[str, int] = defaultdict()
        index.default_factory = index.__len__
        rows = [np.fromiter(map(index.__getitem__, p), np.int64, len(p)) for p in map(self.pattern.findall, texts)]
        ids = self.encode_pieces([p.encode() for p in index])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        offsets = np.cumsum(lens) - lens
        for r in rows:
            yield flat[ragged(offsets[r], lens[r])]

    def decode(self, ids: np.ndarray) -> bytes:
        known = ids[(ids >= 0) & (ids < len(self.lens))]
        return self.flat[ragged(self.offsets[known], self.lens[known])].tobytes()


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start .. start + len - 1 of each pair, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once a worker."""
    return Vocabulary(path, pattern)


def _schema(df: DataFrame, outputs: tuple[str, ...]) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c not in outputs]
    return kept, T.StructType([*(df.schema[c] for c in kept), *(T.StructField(o, FIELDS[o][1]) for o in outputs)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text",
           outputs: tuple[str, ...] = ("ids", "n_tokens"), keep_text: bool = True) -> DataFrame:
    """The rows with the outputs asked for: ids, n_tokens, ids_sha256, decoded, decoded_sha256.

    The decoded ones come from the ids, not from the text; digests are made in the
    task, so the ids of a whole corpus need not be shipped to check them.  Without
    keep_text the text isn't among the columns that come back.
    """
    kept, schema = _schema(df if keep_text else df.drop(text), outputs)
    rows, at = shipped(df, kept, text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for part in chunks(batch, at, SLICE_CHARS):
                cols: dict[str, list] = {o: [] for o in outputs}
                for ids in v.encode([t or "" for t in part.column(at).to_pylist()]):
                    back = v.decode(ids) if {"decoded", "decoded_sha256"} & set(outputs) else b""
                    for o in outputs:
                        cols[o].append({
                            "ids": lambda: ids, "n_tokens": lambda: len(ids), "decoded": lambda: back,
                            "ids_sha256": lambda: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                            "decoded_sha256": lambda: hashlib.sha256(back).hexdigest(),
                        }[o]())
                arrays = [part.column(i) for i in range(len(kept))]
                arrays += [pa.array(cols[o], FIELDS[o][0]) for o in outputs]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *outputs])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with the bytes of their ids as column decoded; null ids decode to no bytes."""
    kept, schema = _schema(df, ("decoded",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            out = [v.decode(np.array([x for x in r or [] if x is not None], np.int64)) for r in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return df.select(*kept, df[ids].alias(free_name(df, "_ids"))).mapInArrow(run, schema)
