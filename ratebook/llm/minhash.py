"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document's features are its 5-word shingles (all its words if it has fewer), with
weight (1 + ln tf) * ln(1 + N / df): of N documents df hold the shingle.  Every df is
counted exactly, copies included.  The distinct shingles of each block of documents are
dealt to cells by their hash and added up there; what a cell returns to a block are the
df of 2 and more.  So no task or broadcast holds a table of all shingles.  Both ways
the sorted hashes go as gaps of two halves, of which the upper is mostly 0; those of a
document are written and shuffled sorted too, in 3 bytes and a bit or so each.  The
functions take a bound `rare` of N / df too, at which the idf becomes flat: with 3 a
group of near copies of a third of all texts keeps full weights.  The queries set none.

Under the whole idf what a group of copies shares weighs less the larger the group is,
and the edits of each most of all: copies that differ in a few words fall below the
similarity.  With `plain` the pairs that reach it without the idf are links too.  They
are found and proved first, in the same way by samples of their own, for which no df
is counted; then the idf's links are added to their classes.

Each document gets BANDS x ROWS consistent weighted samples.  Draws (r, c, beta) come
from tables indexed by a hash of the shingle, the sample is the shingle of least
a = c / (y e^r) with its y, so two documents agree on one with the probability of
their weighted Jaccard similarity.  A band of ROWS samples is a bucket.  Two documents
of similarity 0.8 miss each other in all bands with probability 0.0002.

Equal word sequences are one node from the start.  Only candidates whose total weights
allow the similarity are compared.  Buckets of at most SMALL nodes give all their
pairs.  In larger ones each node's private weight is counted, that of the shingles that
no other node of such buckets holds.  It bounds the similarity to every other node, so
nodes of over 0.2 private go, and pairs whose bound is too low aren't compared; no link
is lost by it.  The rest is a star around the least private node.
PIVOTS of the nodes that aren't in the component of that node are then drawn a round
as centres of further stars, while that halves what is left.  What remains is proved:
nodes of different components that share a bucket are compared in blocks, once for all
buckets that two blocks share, unless the bounds of two blocks allow no link.  No link
between two texts of a bucket that would unite two classes is lost, groups of near
copies cost stars, and none is capped.  Each pair is verified by its weighted Jaccard
similarity (0.8 or more), and links are united to classes.

Defined cases: null and empty texts are equal texts (one class); texts without words
are one class if equal after lower-casing; repeated rows are copies; a null doc_id
takes part, and a class's id is its smallest doc_id that isn't null; an empty table
gives an empty result; other columns are carried by drop_copies().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, checkpoint, checkpoint_tidy, freed, lean, shielded
from .decontaminate import WORD, _joined
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: bound of N / df that the functions use unless told otherwise, and one that makes every idf the same
RARE, PLAIN = 3.0, 1.0
#: documents of a block whose shingles are counted together, and shingles of a cell, on average
ROWS_TOGETHER, CELL = 512, 500_000
#: entries of each table of draws, and df whose samples at tf 1 are tabled
DRAWS, TABLED = 1 << 14, 4
#: shingles that one numpy round handles, one document at least; those dealt at once, for gaps of 16 bits
SLICE, DEALT = 150_000, 600_000
SMALL = 32
#: nodes of a block that is compared with another at once, and their shingles, on average
BLOCK, BLOCK_SHINGLES = 32, 4096
#: nodes drawn from a bucket a round as further centres of stars
PIVOTS = 16
#: step of the (natural) logarithm of the total weight, and of the shared share, within a block
LIKE = 0.02
#: candidate documents whose keys are broadcast to fetch their shingles; more are joined by shuffle
BROADCAST_KEYS = 200_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def shingled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, shingles): 128 bits for the word sequence, and the 32-bit hashes of its shingles, repeats included.

    Of 400 shingles on either side two unlike ones share a hash once in 30,000 pairs.
    """
    df = docs.select("doc_id", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"), _words(F.col(text)).alias("_words"))
    few = F.size("_words") < SHINGLE
    df = df.withColumn("_p1", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_p2", _joined(F.col("_p1"), F.col("_p1"), 1)).withColumn("_p4", _joined(F.col("_p2"), F.col("_p2"), 2))
    whole = F.when(F.size("_words") > 0, F.array(F.hash("_words"))).otherwise(F.array().cast("array<int>"))
    key = F.unhex(F.md5(F.when(F.size("_words") > 0, F.concat_ws(" ", "_words")).otherwise(F.concat(F.lit("\n"), "_low")).cast("binary")))
    return df.select("doc_id", key.alias("key"), F.when(few, whole).otherwise(_joined(F.col("_p4"), F.col("_p1"), 4, F.hash)).alias("shingles"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash spread over 64 bits) of all entries of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    h = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
    h = (h ^ h >> np.uint64(15)) * np.uint64(0xD1B54A32D192ED03)  # no two become one
    return np.repeat(np.arange(len(column)), lens), h ^ h >> np.uint64(32)


def _slices(batch: pa.RecordBatch | pa.Table, column: str | int) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE entries of a list column, of one row at least."""
    for one in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        ends = np.asarray(one.column(column).offsets.to_numpy(), np.int64)[1:]
        ends = ends - (ends[0] - len(one.column(column)[0]) if len(ends) else 0)
        cuts = np.flatnonzero(np.diff(ends // SLICE)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), one.num_rows], strict=True):
            if last > first:
                yield one.slice(first, last - first)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value ends, 0 first) of a binary column."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8), ends - ends[0]


def _sorted(h: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Ascending 32-bit hashes, n of each row, in 3 bytes and a bit or so each: the lower bytes, and a bit set at (upper byte + place in the row)."""
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    sizes = np.where(n > 0, (n + 255 + 7) // 8, 0)
    bits = np.zeros(8 * int(sizes.sum()), np.uint8)
    bits[8 * (np.cumsum(sizes) - sizes)[row] + (h >> np.uint64(24)).astype(np.int64) + place] = 1
    return _binary(h.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3], 3 * n), _binary(np.packbits(bits), sizes)


def _unsorted(low: pa.Array, high: pa.Array) -> pa.Array:
    """The hashes of _sorted() as lists of int."""
    data, ends = _bytes(low)
    ends = ends // 3
    n = np.diff(ends)
    h = np.zeros((len(data) // 3, 4), np.uint8)
    h[:, :3] = data.reshape(-1, 3)
    data, starts = _bytes(high)
    place = np.arange(len(h)) - np.repeat(ends[:-1], n)
    h[:, 3] = np.flatnonzero(np.unpackbits(data)) - np.repeat(8 * starts[:-1], n) - place
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view("<u4").ravel().view(np.int32)))


def _read(batch: pa.RecordBatch | pa.Table, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of rows of stored() of about `most` shingles, of one row at least, with their lists behind the other columns."""
    for one in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        cuts = np.flatnonzero(np.diff(_bytes(one.column("low"))[1][1:] // (3 * most))) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), one.num_rows], strict=True):
            if last > first:
                part = one.slice(first, last - first)
                names = [c for c in part.schema.names if c not in ("low", "high")]
                lists = _unsorted(part.column("low"), part.column("high"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, "shingles"])


def listed(rows: DataFrame) -> DataFrame:
    """(key, most, shingles): of rows (key, most, low, high), with the hashes as lists."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _read(batch)

    return rows.select("key", "most", "low", "high").mapInArrow(run, "key binary, most long, shingles array<int>")


def _gaps(h: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Lists that end at `ends`, each of ascending 32-bit hashes, as lists of the lower and upper halves of what each adds to the one before."""
    h = h.astype(np.int64)
    gap = np.diff(h, prepend=0)
    first = ends[:-1][np.diff(ends) > 0]
    gap[first] = h[first]
    at = pa.array(ends.astype(np.int32))
    return tuple(pa.ListArray.from_arrays(at, pa.array(x.astype(np.uint16).view(np.int16))) for x in (gap & 0xFFFF, gap >> 16))


def _from_gaps(low: pa.Array, high: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, where each list ends) of _gaps()."""
    ends = np.append(0, np.cumsum(np.diff(low.offsets.to_numpy()), dtype=np.int64))
    low, high = (x.flatten().to_numpy(zero_copy_only=False).view(np.uint16).astype(np.int64) for x in (low, high))
    total = np.append(0, np.cumsum(high << 16 | low))
    return (total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))).astype(np.uint32), ends


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, key, block, n, low, high): shingled(), written with the n hashes _sorted(), and the block whose shingles are counted together."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 3):
                lists = part.column(3)
                n = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                h = np.sort(row << np.uint64(32) | lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n.astype(np.int32)), *_sorted(h & np.uint64(0xFFFFFFFF), n)],
                                                 names=["doc_id", "key", "block", "n", "low", "high"])

    sh = shingled(docs).withColumn("block", F.floor(F.monotonically_increasing_id() / ROWS_TOGETHER))
    kind = sh.schema["doc_id"].dataType.simpleString()
    return checkpoint(sh.select("doc_id", "key", "block", "shingles").mapInArrow(run, f"doc_id {kind}, key binary, block long, n int, low binary, high binary"))


def frequent(sh: DataFrame, cells: int) -> DataFrame:
    """(block, hs, dfs): for each block of stored() the shingles it shares with other documents or holds twice, with their df (2 or more)."""
    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ends = _from_gaps(batch.column(1), batch.column(2))
            hs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), hs, batch.column(3)], names=["block", "hs", "dfs"])

    return _frequent(sh, cells).mapInArrow(read, "block long, hs array<int>, dfs array<int>")


def _frequent(sh: DataFrame, cells: int) -> DataFrame:
    """(block, low, high, dfs): frequent(), with the shingles as _gaps()."""
    @lean
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _read(batch, DEALT):
                column = part.column(1)
                row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())).astype(np.uint64)
                h = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
                once = np.sort(row << np.uint64(32) | h)
                once = once[np.append(True, once[1:] != once[:-1])[: len(once)]]  # a shingle counts once a document
                block = part.column(0).to_numpy()
                names, at = np.unique(block, return_inverse=True)
                key, n = np.unique(at.astype(np.uint64)[(once >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | once & np.uint64(0xFFFFFFFF), return_counts=True)
                h = key & np.uint64(0xFFFFFFFF)
                cell = (h * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
                which = (key >> np.uint64(32)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (cell[1:] != cell[:-1]))) if len(key) else np.empty(0, np.int64)
                ends = np.append(starts, len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[starts].astype(np.int32)), pa.array(names[which[starts]]), *_gaps(h, ends),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(n.astype(np.int32)))],
                    names=["cell", "block", "low", "high", "ns"])

    def count(table: pa.Table) -> pa.Table:
        low, high, ns = (table.column(c).combine_chunks() for c in ("low", "high", "ns"))
        h, ends = _from_gaps(low, high)
        row = np.repeat(np.arange(len(ns)), np.diff(ends))
        _, at = np.unique(h, return_inverse=True)
        df = np.bincount(at, ns.flatten().to_numpy(zero_copy_only=False)).astype(np.int32)[at]
        some = df > 1
        ends = np.append(0, np.cumsum(np.bincount(row[some], minlength=len(ns))))
        dfs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(df[some]))
        out = pa.table([table.column("block").combine_chunks(), *_gaps(h[some], ends), dfs], names=["block", "low", "high", "dfs"])
        return out.filter(pa.array(np.diff(ends) > 0))

    rows = sh.select("block", "low", "high").mapInArrow(dealt, "cell int, block long, low array<smallint>, high array<smallint>, ns array<int>")
    return rows.groupBy("cell").applyInArrow(count, "block long, low array<smallint>, high array<smallint>, dfs array<int>")


class Weights(NamedTuple):
    """What makes weights of tf and df: the number of documents, and the bound of N / df."""

    n: int
    rare: float

    def idf(self, df: np.ndarray | int) -> np.ndarray:
        return np.log1p(np.minimum(self.n / df, self.rare))

    def counted(self, row: np.ndarray, h: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, shingle, weight, df, or 0 where tf is over 1) of the distinct shingles of each row, by row."""
        order = np.lexsort((h, row))
        row, h, df = row[order], h[order], df[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        row, h, df = row[at], h[at], df[at]
        return row, h, self.idf(df) * (1 + np.log(tf)), np.where(tf > 1, 0, df)

    def of(self, lists: pa.Array, dfs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shingle, weight) of the distinct shingles of a list column whose df are packed()."""
        each = [np.frombuffer(zlib.decompress(x), np.int32) for x in dfs.to_pylist()]
        return self.counted(*_flat(lists), np.concatenate(each) if each else np.empty(0, np.int32))[:3]


def packed(df: np.ndarray) -> bytes:
    return zlib.compress(df.astype(np.int32).tobytes(), 1)  # most are 1


def _draws(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1_000_003 + k)
    return rng.standard_gamma(2.0, DRAWS), rng.standard_gamma(2.0, DRAWS), rng.random(DRAWS)


def _least(w: np.ndarray | float, r: np.ndarray, c: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """a of a weight under the draws: ICWS takes the feature of least a."""
    y = np.exp(r * (np.floor(np.log(w) / r + beta) - beta))
    return (c / (y * np.exp(r))).astype(np.float32)


@lru_cache(maxsize=1)
def _tables(weights: Weights) -> tuple[list, list[np.ndarray]]:
    """The draws of each sample, and a of the df 1 .. TABLED at tf 1, one behind the other."""
    draws = [_draws(k) for k in range(BANDS * ROWS)]
    return draws, [np.concatenate([_least(weights.idf(df), *d) for df in range(1, TABLED + 1)]) for d in draws]


def bands(sh: DataFrame, weights: Weights, cells: int) -> DataFrame:
    """(key, df, bands, w): df of the shingles in their order, packed, BANDS hashes of ROWS samples each, and the total weight.

    One row for each document of stored() that has words.
    """
    odd = np.random.default_rng(17).integers(0, 2**62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = np.uint64(64 - (DRAWS - 1).bit_length())
    kind = "key binary, df binary, bands array<long>, w double"
    schema = pa.schema([("key", pa.binary()), ("df", pa.binary()), ("bands", pa.list_(pa.int64())), ("w", pa.float64())])

    def sampled(parts: Iterator[pa.RecordBatch], known: np.ndarray, dfs: np.ndarray) -> Iterator[pa.RecordBatch]:
        draws, base = _tables(weights)
        for part in parts:
            lists = part.column("shingles")
            raw = lists.flatten().to_numpy(zero_copy_only=False)
            df = np.ones(len(raw), np.int32)
            if len(known):
                i = np.minimum(np.searchsorted(known, raw), len(known) - 1)
                df = np.where(known[i] == raw, dfs[i], df)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row, h, w, d = weights.counted(*_flat(lists), df)
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
            tabled = (d > 0) & (d <= TABLED)
            other = np.flatnonzero(~tabled)
            low = h ^ h >> np.uint64(32)
            place = np.where(tabled, (d - 1).astype(np.int64) * DRAWS, 0)
            hashes = np.zeros((len(starts), BANDS), np.uint64)
            for k in range(BANDS * ROWS if len(starts) else 0):
                i = (h * odd[k] >> shift).astype(np.int64)
                a = base[k][place + i]
                if len(other):
                    j = i[other]
                    a[other] = _least(w[other], *(x[j] for x in draws[k]))
                # positive floats are ordered as their bits are; the shingle makes the sample's name
                name = a.view(np.uint32).astype(np.uint64) << np.uint64(32) | low & np.uint64(0xFFFFFFFF)
                b = k // ROWS
                x = (hashes[:, b] ^ np.minimum.reduceat(name, starts)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(b + 1)
                hashes[:, b] = x ^ x >> np.uint64(29)
            some = row[starts]
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(some)), pa.array([packed(df[ends[r] : ends[r + 1]]) for r in some], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(starts) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(hashes.ravel().view(np.int64))),
                 pa.array(np.add.reduceat(w, starts) if len(starts) else np.empty(0))], schema=schema)

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        known = _from_gaps(*(shared.column(c).combine_chunks() for c in ("low", "high")))[0].view(np.int32) if shared.num_rows else np.empty(0, np.int32)
        known, at = np.unique(known, return_index=True)
        dfs = shared.column("dfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)[at] if shared.num_rows else known
        return pa.Table.from_batches(list(sampled(_read(docs), known, dfs)), schema)

    @lean
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sampled(_read(batch), np.empty(0, np.int32), np.empty(0, np.int32))

    rows = sh.where("n > 0").select("block", "key", "low", "high")
    if weights.rare <= PLAIN:  # no weight depends on a df
        return rows.select("key", "low", "high").mapInArrow(alike, kind)
    return rows.groupBy("block").cogroup(_frequent(rows, cells).groupBy("block")).applyInArrow(run, kind)


def verified(pairs: DataFrame, shingles: DataFrame, weights: Weights, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least `least`, with it as sim."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                sides = [weights.of(part.column(c), part.column(c + 1)) for c in (2, 4)]
                row, h, w = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((h, row))
                row, h, w = row[order], h[order], w[order]
                pair = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1])) if len(row) else np.empty(0, np.int64)
                both = np.bincount(row[pair], np.minimum(w[pair], w[pair + 1]), part.num_rows)
                total = np.bincount(row, w, part.num_rows) if len(row) else np.zeros(part.num_rows)
                sim = both / np.maximum(total - both, 1e-300)
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], names=["a", "b", "sim"])
                yield out.filter(pa.array(sim >= least - 1e-12))

    one = shingles.select(F.col("key").alias("a"), F.col("shingles").alias("x"), F.col("df").alias("x_df"))
    two = shingles.select(F.col("key").alias("b"), F.col("shingles").alias("y"), F.col("df").alias("y_df"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "x_df", "y", "y_df").mapInArrow(run, "a binary, b binary, sim double")


def linked_in_blocks(nodes: DataFrame, shingles: DataFrame, weights: Weights) -> DataFrame:
    """Links (a, b) between nodes of different classes that share a bucket; nodes (bucket, key, w, s, c, n), c the class so far.

    Nodes of like total weight and like shared weight that have the same fullest
    bucket form blocks of about BLOCK nodes, or BLOCK_SHINGLES shingles if that is
    less; classes of BLOCK nodes or more have blocks of their own.  Pairs of blocks
    are joined, once in whichever buckets they share: not those of one class, nor
    those whose least weights and greatest shared weights allow no link.  So a row
    stands for about BLOCK * BLOCK pairs, and no task needs a bucket or group whole.
    """
    one = nodes.groupBy("key").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home"), F.first("w").alias("w"), F.first("s").alias("s"), F.first("c").alias("c"))
    one = one.join(shingles.select("key", "shingles", "df"), "key").withColumn("like", F.floor(F.log("w") / LIKE)).withColumn("open", F.floor(F.col("s") / F.col("w") / LIKE))
    own = one.groupBy("home", "c").agg(F.count("*").alias("same")).where(F.col("same") >= BLOCK).select("home", "c", F.col("c").alias("whole"))
    one = one.join(own, ["home", "c"], "left").withColumn("whole", F.coalesce("whole", F.lit(b""))).drop("c")
    kind = ["home", "whole", "like", "open"]
    sizes = one.groupBy(kind).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("shingles")) / BLOCK_SHINGLES)).alias("parts"))
    block = F.xxhash64(*kind, F.pmod(F.xxhash64("key", F.lit(7)), "parts"))
    one = checkpoint(one.join(sizes, kind).select(block.alias("block"), "key", "w", "s", "whole", "shingles", "df"))
    blocks = one.groupBy("block").agg(F.collect_list("key").alias("keys"), F.collect_list("shingles").alias("lists"), F.collect_list("df").alias("dfs"))
    bounds = one.groupBy("block").agg(F.min("w").alias("w"), F.max("s").alias("s"), F.first("whole").alias("whole"))
    met = nodes.select("bucket", "key").join(one.select("key", "block"), "key").select("bucket", "block").distinct()
    met = checkpoint(met.join(bounds, "block"))
    x, y = (met.select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in ("block", "w", "s", "whole"))) for side in "xy")
    apart = (F.col("x_whole") != F.col("y_whole")) | (F.length("x_whole") == 0)
    work = x.join(y, "bucket").where((F.col("x_block") <= F.col("y_block")) & apart & _near("x_w", "x_s", "y_w", "y_s")).select("x_block", "y_block").distinct()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, lists, dfs, other_keys, others, other_dfs = (batch.column(c).slice(i, 1).flatten() for c in range(6))
                node, h, w = weights.of(lists, dfs)
                held, at = np.unique(h, return_inverse=True)
                of_node = np.zeros((len(keys), len(held)))
                of_node[node, at] = w
                row, h, w = weights.of(others, other_dfs)
                total = np.bincount(row, w, len(other_keys))
                at = np.minimum(np.searchsorted(held, h), len(held) - 1)
                hit = held[at] == h
                row, w, at = row[hit], w[hit], at[hit]
                both = np.stack([np.bincount(row, np.minimum(w, mine[at]), len(other_keys)) for mine in of_node])
                a, b = np.nonzero(both >= (of_node.sum(1)[:, None] + total - both) * (SIMILARITY - 1e-12))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(a)), other_keys.take(pa.array(b))], names=["a", "b"])

    sides = [blocks.select(F.col("block").alias(f"{side}_block"), F.col("keys").alias(f"{side}_keys"), F.col("lists").alias(f"{side}_lists"), F.col("dfs").alias(f"{side}_dfs")) for side in "xy"]
    rows = work.join(sides[0], "x_block").join(sides[1], "y_block").select("x_keys", "x_lists", "x_dfs", "y_keys", "y_lists", "y_dfs")
    return rows.mapInArrow(run, "a binary, b binary").where("a <> b")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def private(sh: DataFrame, weights: Weights) -> DataFrame:
    """(node, own): of each document of sh (node is xxhash64 of its key) the weight of the shingles that no other one of sh holds, if any."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                row, h, w = weights.of(part.column(1), part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(w)], names=["node", "h", "w"])

    held = sh.select(F.xxhash64("key").alias("node"), "shingles", "df").mapInArrow(run, "node long, h long, w double")
    once = held.groupBy("h").agg(F.count("*").alias("n"), F.max("node").alias("node"), F.max("w").alias("w")).where("n = 1")
    return once.groupBy("node").agg(F.sum("w").alias("own"))


def still_apart(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs (a, b) that components (id, component) don't unite."""
    few = by_size(at, at.count(), BROADCAST_KEYS)
    for side in "ab":
        own = few.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return pairs.where("of_a <> of_b").select("a", "b")


def united(sh: DataFrame, rare: float = RARE, known: DataFrame | None = None) -> DataFrame:
    """(id, component): each key of stored() that is linked to one of another word sequence, with the smallest key that it reaches.

    The components `known` are united already: what is found is added to them.
    """
    n, total = sh.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = Weights(n, rare)
    if known is not None:
        freed(sh.sparkSession)  # what the links before this took
    sh = sh.select("block", "key", "n", "low", "high")
    # written, since the buckets are counted and then joined: the samples are drawn once
    sketches = checkpoint_tidy(bands(sh, weights, 1 + total // CELL).groupBy("key").agg(F.first("bands").alias("bands"), F.first("w").alias("w"), F.first("df").alias("df")))
    rows = sketches.select("key", "w", F.posexplode("bands").alias("band", "h")).select("key", "w", F.xxhash64("band", "h").alias("bucket"))
    members = checkpoint(rows.join(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"))
    wanted = members.groupBy("key").agg(F.max("n").alias("most"))
    # one row of shingles for each candidate; they alone are shuffled
    shingles = sh.join(by_size(wanted, wanted.count(), BROADCAST_KEYS), "key").groupBy("key").agg(*(F.first(c).alias(c) for c in ("low", "high", "most")))
    shingles = checkpoint(listed(shingles).join(sketches.select("key", "df"), "key"))
    own = private(shingles.where(F.col("most") > SMALL), weights)
    big = members.where(F.col("n") > SMALL).withColumn("node", F.xxhash64("key")).join(own, "node", "left")
    big = big.select("bucket", "key", "w", F.coalesce(F.col("w") - F.col("own"), "w").alias("s"))
    # the other nodes can be like none; what is left of a bucket has its least private node in the middle
    big = big.where(F.col("s") >= F.col("w") * (SIMILARITY - 1e-9))
    middle = F.min(F.struct((-F.col("s") / F.col("w")).alias("o"), F.xxhash64("key").alias("t"), "key", "w", "s"))
    middles = big.groupBy("bucket").agg(middle.alias("r")).select("bucket", F.col("r.key").alias("rep"), F.col("r.w").alias("rep_w"), F.col("r.s").alias("rep_s"))
    big = checkpoint(big.join(middles, "bucket"))
    small = members.where(F.col("n") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") < F.col("y.key")) & _close("x.w", "y.w"))
    pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    pairs = pairs.unionByName(big.where(_near("w", "s", "rep_w", "rep_s")).select(F.col("rep").alias("a"), F.col("key").alias("b")))
    pairs = _pairs(pairs)
    found = verified(pairs if known is None else still_apart(pairs, known), shingles, weights).select("a", "b")
    if known is not None:
        found = found.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b")))
    before = None
    while True:
        at = components(found)
        few = by_size(at, at.count(), BROADCAST_KEYS)
        placed = (big.join(few.select(F.col("id").alias("key"), "component"), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
                  .join(few.select(F.col("id").alias("rep"), F.col("component").alias("of_rep")), "rep", "left").withColumn("of_rep", F.coalesce("of_rep", "rep")))
        left = checkpoint(placed.where("c <> of_rep").select("bucket", "key", "w", "s", "c"))
        now = left.count()
        if now == 0:
            return at
        # the classes so far are stars, to which the new links are added
        found = at.select(F.col("id").alias("a"), F.col("component").alias("b"))
        if before is not None and now > before / 2:
            break
        before = now
        counts = left.groupBy("bucket").agg(F.count("*").alias("m"))
        # by key alone: a node is drawn in all its buckets, so the bands' buckets of one group give the same pairs
        drawn = left.join(counts, "bucket").where(F.pmod(F.xxhash64("key", F.lit(now)), F.lit(1 << 20)) * F.col("m") < F.lit(PIVOTS << 20).cast("long"))
        drawn = drawn.select("bucket", F.col("key").alias("pivot"), F.col("w").alias("pivot_w"), F.col("s").alias("pivot_s"), F.col("c").alias("pivot_c"))
        pairs = left.join(drawn, "bucket").where((F.col("c") != F.col("pivot_c")) & _near("w", "s", "pivot_w", "pivot_s"))
        pairs = pairs.select(F.col("pivot").alias("a"), F.col("key").alias("b"))
        found = found.unionByName(verified(_pairs(pairs), shingles, weights).select("a", "b"))
    sizes = big.groupBy("bucket").agg(F.count("*").alias("n")).join(left.select("bucket").distinct(), "bucket")
    nodes = placed.select("bucket", "key", "w", "s", "c").join(sizes, "bucket")
    return components(found.unionByName(linked_in_blocks(nodes, shingles, weights)))


def _close(a: str, b: str) -> Column:
    """Whether two total weights allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * (SIMILARITY - 1e-9)


def _near(w: str, s: str, other_w: str, other_s: str) -> Column:
    """Whether total weights w, and s of them that other documents hold too, allow the similarity: at most the lesser s is common."""
    common = F.least(s, other_s)
    return common >= (F.col(w) + F.col(other_w) - common) * (SIMILARITY - 1e-9)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: float = RARE, plain: bool = False) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), n_class (documents in it), kept (doc_id = class_id) of every document.

    plain: texts that are similar without the idf are linked too.
    """
    sh = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return sh.select("doc_id", "key").join(class_table(sh, rare, plain), "key").select(
        "doc_id", "class_id", "n_class", (F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False))).alias("kept"))


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    w = _words(F.col(text))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn("key", F.unhex(F.md5(F.when(F.size(w) > 0, F.concat_ws(" ", w)).otherwise(F.concat(F.lit("\n"), low)).cast("binary"))))


def class_table(sh: DataFrame, rare: float = RARE, plain: bool = False) -> DataFrame:
    """(key, class_id, n_class, class_key): one row for each word sequence of stored()."""
    keys = sh.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    comp = united(sh, rare, united(sh, PLAIN) if plain else None).withColumnRenamed("id", "key")
    keys = keys.join(comp, "key", "left").withColumn("component", F.coalesce("component", "key"))
    # of equal least ids (null ones too) the smallest key stands for the class
    whole = keys.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_class"),
                                          F.min(F.struct(F.col("least").isNull(), "least", "key"))["key"].alias("class_key"))
    return keys.select("key", "component").join(whole, "component").drop("component")


def drop_copies(docs: DataFrame, rare: float = RARE) -> DataFrame:
    """One document of each class with its own columns: the one of smallest doc_id."""
    table = class_table(stored(docs.select("doc_id", "text")), rare).where("key = class_key").select(F.col("key").alias("_key"), F.col("class_id").alias("_class"))
    rows, back = shielded(docs, ["doc_id", "text"])
    keyed = _keyed(rows).withColumnRenamed("key", "_key")
    return back(keyed.join(table, "_key").where(F.col("doc_id").eqNullSafe(F.col("_class"))).dropDuplicates(["_key"]).drop("_key", "_class"))
