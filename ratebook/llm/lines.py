"""Line dedup by a deletion-neighbourhood join; the earliest line stays.

A line's letters are its words (split at white space, lower-cased).  Lines of equal
words are duplicates.  Lines of LEAST words or more are also duplicates if one word
replaced, left out or put in turns one into the other (edit distance 1 over words):
every line emits the hash of each variant with one word deleted, and its own.  Equal
variants join: two lines that lost the word at the same place differ in one word, and
a line equal to another's variant lacks one word.  A line goes if such a join with an
earlier line, verified over the words, holds.  Earlier means a smaller doc_id, then
the smaller text hash, then the line number.

For each shared variant only its earliest line matters, so each line joins a minimum
and groups never give their pairs.  All hashes of a line come from one running sum
(a polynomial modulo 2**64, twice for line keys).  Before variants are emitted, lines
without a partner leave: two lines at distance 1 have equal left or right halves, so
a line whose four half keys no other line has can't match.

Defined cases: null and empty texts have one empty line; lines without words are never
duplicates and stay; rows equal in doc_id and text count as one document and get the
same result; a null doc_id comes before all others; a document of which nothing is
left keeps an empty text (dedup) or goes (drop_lines); an empty table gives an empty
result; other columns are carried, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, checkpoint, lean, shielded

#: words of a line at least, for a near match
LEAST = 8
#: rows of a key table that are broadcast; more are joined by shuffle
BROADCAST_KEYS = 300_000
#: words that one numpy round handles, of one document at least
SLICE = 300_000
ONE, TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd bases of the running sums


class Sums:
    """Running sums of all words of an Arrow batch of lists (documents) of lists (lines) of word hashes."""

    def __init__(self, column: pa.Array, base: int, mix: int = 0) -> None:
        docs = np.asarray(column.offsets.to_numpy(), np.int64)
        inner = column.flatten()
        self.ends = np.asarray(inner.offsets.to_numpy(), np.int64)
        words = inner.values.to_numpy(zero_copy_only=False).view(np.uint64)[self.ends[0] : self.ends[-1]]
        if mix:
            words = (words ^ words >> np.uint64(31)) * np.uint64(mix)
            words = words ^ words >> np.uint64(29)
        self.ends = self.ends - self.ends[0]
        self.doc = np.repeat(np.arange(len(column)), np.diff(docs))
        self.line = np.arange(len(self.doc)) - np.repeat(docs[:-1] - docs[0], np.diff(docs))
        self.start, self.n = self.ends[:-1], np.diff(self.ends)
        longest = int(self.n.max()) if len(self.n) else 0
        self.power = _powers(base, longest + 1)
        self.inverse = _powers(pow(base, -1, 1 << 64), longest + 1)
        place = np.arange(len(words)) - np.repeat(self.start, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.power[place], dtype=np.uint64)])

    def part(self, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of words first .. last - 1 of the lines that begin at start, as if they were a line."""
        return (self.sums[start + last] - self.sums[start + first]) * self.inverse[first]


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])


def _mixed(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    x = (h ^ salt.astype(np.uint64) * np.uint64(ONE)) * np.uint64(TWO)
    return x ^ x >> np.uint64(32)


def hashed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dk, lines): dk stands for the text, lines holds the word hashes of each line."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = lambda line: F.transform(F.filter(F.split(F.lower(line), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("dk"), F.transform(F.split(t, "\n"), words).alias("lines"))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices with about SLICE words of a column of lists (documents) of lists (lines), one row at least."""
    docs = np.asarray(batch.column(column).offsets.to_numpy(), np.int64)
    ends = np.asarray(batch.column(column).flatten().offsets.to_numpy(), np.int64)[docs - docs[0]]
    first = 0
    while first < batch.num_rows:
        last = max(int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1, first + 1)
        yield batch.slice(first, last - first)
        first = last


def _line_keys(rows: DataFrame) -> DataFrame:
    """(doc_id, dk, line, h1, h2, halves) of each line with words."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _slices(batch, 2)):
            s, t = Sums(part.column(2), ONE), Sums(part.column(2), TWO, ONE)
            zero = np.zeros(len(s.n), np.int64)
            h1, h2 = _mixed(s.part(s.start, zero, s.n), s.n), _mixed(t.part(t.start, zero, t.n), s.n)
            halves = np.zeros((len(s.n), 4), np.uint64)
            # as one of two lines of n words, and as the longer one of n - 1 and n
            for k, c in ((0, s.n), (2, s.n - 1)):
                m = np.maximum(c // 2, 0)
                halves[:, k] = _mixed(s.part(s.start, zero, m), 4 * c)
                halves[:, k + 1] = _mixed(s.part(s.start, s.n - np.maximum(c - m, 0), s.n), 4 * c + 1)
            count = np.where(s.n >= LEAST, np.where(s.n > LEAST, 4, 2), 0)
            some = s.n > 0
            flat = halves[np.arange(4)[None, :] < count[:, None]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(flat.view(np.int64)))
            out = pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(s.doc)), part.column(1).take(pa.array(s.doc)), pa.array(s.line.astype(np.int32)),
                 pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=["doc_id", "dk", "line", "h1", "h2", "halves"])
            yield out.filter(pa.array(some))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, dk long, line int, h1 long, h2 long, halves array<long>")


def _variants(lines: DataFrame) -> DataFrame:
    """(core, place, doc_id, dk, line, h1): the line without the word at place, and the whole line at place -1."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                words = part.column(4)
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32)), pa.concat_arrays([words]))
                s = Sums(one, ONE)
                row = np.repeat(np.arange(len(s.n)), s.n + 1)
                place = np.arange(len(row)) - np.repeat(np.cumsum(s.n + 1) - (s.n + 1), s.n + 1)
                n, start = s.n[row], s.start[row]
                whole = place == n
                cut = np.where(whole, n, place)
                left = s.sums[start + cut] - s.sums[start]
                right = (s.sums[start + n] - s.sums[start + np.minimum(cut + 1, n)]) * s.inverse[1]
                core = _mixed(left + np.where(whole, np.uint64(0), right), np.where(whole, n, n - 1))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(np.where(whole, -1, place).astype(np.int32)), *(part.column(i).take(at) for i in range(4))],
                    names=["core", "place", "doc_id", "dk", "line", "h1"])

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.select("doc_id", "dk", "line", "h1", "words").mapInArrow(run, f"core long, place int, doc_id {kind}, dk long, line int, h1 long")


def _candidates(firsts: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """(doc_id, dk, line, h1, words): the first line of each key that shares a half with another."""
    halves = firsts.select("h1", "h2", F.explode("halves").alias("half"))
    shared = checkpoint(halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half"))
    wanted = halves.join(by_size(shared, shared.count(), limit), "half").select("h1", "h2").distinct()
    wanted = checkpoint(firsts.join(wanted, ["h1", "h2"], "left_semi").select("doc_id", "dk", "line", "h1"))
    lines = rows.select("doc_id", "dk", F.posexplode("lines").alias("line", "words")).where(F.size("words") >= LEAST)
    pick = by_size(wanted.select(F.col("doc_id").alias("_d"), F.col("dk").alias("_k"), F.col("line").alias("_l"), "h1"), wanted.count(), limit)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("dk") == F.col("_k")) & (F.col("line") == F.col("_l"))
    # rows that are equal in doc_id and text give the line more than once
    return checkpoint(lines.join(pick, same).select("doc_id", "dk", "line", "h1", "words").dropDuplicates(["doc_id", "dk", "line"]))


def near(lines: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, dk, line) of the lines at edit distance 1 of an earlier line, of (doc_id, dk, line, h1, words)."""
    v = _variants(lines)
    shared = checkpoint(v.groupBy("core").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("core"))
    at = F.struct("doc_id", "dk", "line")
    v = checkpoint(v.join(by_size(shared, shared.count(), limit), "core").select("core", "place", at.alias("at")))
    first = v.groupBy("core", "place").agg(F.min("at").alias("first"))
    replaced = v.where("place >= 0").join(first, ["core", "place"])
    # the shorter line stands at place -1
    longer = v.where("place >= 0").join(first.where("place < 0").drop("place"), "core")
    shorter = v.where("place < 0").join(first.where("place >= 0").groupBy("core").agg(F.min(F.struct("first", "place")).alias("m"))
                                        .select("core", F.col("m.first").alias("first"), F.col("m.place").alias("cut")), "core")
    pairs = (replaced.select("at", "first", "place", F.lit("r").alias("kind"))
             .unionByName(longer.select("at", "first", "place", F.lit("l").alias("kind")))
             .unionByName(shorter.select("at", "first", F.col("cut").alias("place"), F.lit("s").alias("kind")))
             .where(F.col("first") < F.col("at")).distinct())
    # verified over the words themselves
    one = lines.select(F.struct("doc_id", "dk", "line").alias("at"), F.col("words").alias("x"))
    two = lines.select(F.struct("doc_id", "dk", "line").alias("first"), F.col("words").alias("y"))
    without = lambda w: F.concat(F.slice(w, F.lit(1), F.col("place")), F.slice(w, F.col("place") + 2, F.size(w)))
    x, y = F.col("x"), F.col("y")
    ok = (F.when(F.col("kind") == "r", (F.size(x) == F.size(y)) & (without(x) == without(y)))
          .when(F.col("kind") == "l", without(x) == y).otherwise(x == without(y)))
    return pairs.join(one, "at").join(two, "first").where(ok).select("at.*").distinct()


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, dk, kept): the numbers of the lines with words that stay, for documents that have such."""
    rows = hashed(docs, doc_id, text)
    at = F.struct("doc_id", "dk", "line")
    firsts = checkpoint(_line_keys(rows).groupBy("h1", "h2").agg(F.min(at).alias("at"), F.max("halves").alias("halves"))
                        .select("at.*", "h1", "h2", "halves"))
    gone = near(_candidates(firsts, rows, limit), limit).select(at.alias("_gone"))
    left = firsts.select("doc_id", "dk", "line").withColumn("_at", at).join(gone, F.col("_at") == F.col("_gone"), "left_anti")
    return left.groupBy("doc_id", "dk").agg(F.array_sort(F.collect_list("line")).alias("kept"))


def _marked(docs: DataFrame, doc_id: str, text: str, limit: int) -> DataFrame:
    kept = kept_lines(docs, doc_id, text, limit).select(F.col("doc_id").alias("_d"), F.col("dk").alias("_k"), F.col("kept").alias("_kept"))
    t = F.coalesce(F.col(text), F.lit(""))
    same = F.col(doc_id).eqNullSafe(F.col("_d")) & (F.col("_dk") == F.col("_k"))
    return (docs.withColumn("_dk", F.xxhash64(t)).join(kept, same, "left")
            .withColumn("_kept", F.coalesce("_kept", F.array().cast("array<int>"))).drop("_d", "_k", "_dk"))


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BROADCAST_KEYS) -> DataFrame:
    """Per document: doc_id, n_lines, n_kept, dropped (numbers of the lines that go, from 0); texts aren't shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("_dk"), F.size(lines).cast("long").alias("n_lines"), worded.alias("_worded"))
    kept = kept_lines(docs, doc_id, text, limit).select(F.col("doc_id").alias("_d"), F.col("dk").alias("_k"), F.col("kept").alias("_kept"))
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_dk") == F.col("_k")), "left")
    dropped = F.array_except("_worded", F.coalesce("_kept", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BROADCAST_KEYS) -> DataFrame:
    """The documents with the duplicate lines cut out of their text (null stays null)."""
    docs, back = shielded(docs, [doc_id, text])
    keep = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~x.rlike(r"\S") | F.array_contains("_kept", i))
    return back(_marked(docs, doc_id, text, limit).withColumn(text, F.array_join(keep, "\n")).drop("_kept"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BROADCAST_KEYS) -> DataFrame:
    """Like dedup(), without the documents that had words and have none left."""
    docs, back = shielded(docs, [doc_id, text])
    marked = _marked(docs, doc_id, text, limit).where((F.size("_kept") > 0) | ~F.coalesce(F.col(text), F.lit("")).rlike(r"\S"))
    keep = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~x.rlike(r"\S") | F.array_contains("_kept", i))
    return back(marked.withColumn(text, F.array_join(keep, "\n")).drop("_kept"))
