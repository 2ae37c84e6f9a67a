"""BPE encoding and decoding of a tokenizer file, by a contiguous array of ranks a word.

The text is cut at the added tokens of the file and then into words by the byte-level
pattern.  A word holds its part boundaries and, for each two adjacent parts, the rank
of their merge.  The least rank is looked for from the left, the boundary between its
two parts is deleted, and the ranks on both sides are looked up anew, until no two
parts merge.  The boundaries and ranks of all different words of a slice of texts lie
in one contiguous array, so each scan, deletion and refreshing is done for all of them
at once; words that are done leave it.  The scan is quadratic in a word's length, so
words of over LONGEST bytes take the same merges in the same order from a heap.

Decoding joins the bytes of the tokens and replaces what isn't UTF-8 by U+FFFD.

Defined cases: a null text counts as empty (no ids, empty text); null ids and ids that
the file lacks decode to nothing; other columns are carried, one that is named like
the result is replaced; an empty table gives an empty result.  A file with a
normalizer, another split than the byte-level one, or added tokens with options is
refused with a ValueError.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import ragged

#: bytes of a word that is merged by scanning, at most; bytes of text encoded and ids decoded at a time
LONGEST, CHARS, IDS = 128, 2_000_000, 1_000_000
#: the rank of two adjacent parts that don't merge, and above all pairs of ids
NEVER = (1 << 63) - 1

# The split of byte-level vocabularies, and the letters and digits that are
# newer than version 16 of Unicode, which such files treat as other characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|\s+(?!\S)|\s+"
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Splitter:
    """Cuts a text into words as the byte-level split does."""

    def __init__(self) -> None:
        import regex

        newer = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split())
        self.plain = regex.compile(SPLIT.format(letter=r"\p{L}", digit=r"\p{N}", other=r"[^\s\p{L}\p{N}]"))
        exact = SPLIT.format(letter=rf"[\p{{L}}--[{newer}]]", digit=rf"[\p{{N}}--[{newer}]]", other=rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
        self.exact = regex.compile(exact, regex.V1)
        ends = [[int(x, 16) for x in r.split("-")] for r in NEWER.split()]
        self.newer = {chr(c) for r in ends for c in range(r[0], r[-1] + 1)}

    def __call__(self, text: str) -> list[str]:
        odd = not text.isascii() and not self.newer.isdisjoint(text)
        return (self.exact if odd else self.plain).findall(text)


class Merges:
    """Merges, ids and bytes of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, decoder, added = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}, spec["added_tokens"]
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        split = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), decoder.get("type"))
        if model["type"] != "BPE" or any(model.get(k) for k in options) or spec["normalizer"] or split != ("ByteLevel", False, True, "ByteLevel"):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer is supported")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens with options are not supported")
        import regex

        vocab, letters = model["vocab"], byte_letters()
        byte = {c: b for b, c in letters.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # place in the list of merges by (left id, right id), and the id that each merge makes
        self.rank = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.keys, self.places = np.append(keys[order], NEVER), np.append(order, NEVER)
        self.first = self.lookup(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, longest))})") if longest else None
        self.bytes = {k: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, k in (vocab | self.added).items()}
        self.split = Splitter()

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, NEVER if there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.places[at], NEVER)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each).

        `part` holds the id at each boundary of the words, `rank` that of its merge with the part after it.
        """
        n = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        part, rank = self.of_byte[data], np.full(len(data), NEVER)
        rank[:-1] = self.first[data[:-1] << 8 | data[1:]]
        ends = np.cumsum(n)
        rank[ends - 1] = NEVER
        start, word, counts = ends - n, np.arange(len(n)), n.copy()
        out, into = np.empty(len(data), np.int64), ends - n
        while len(word):
            least = np.minimum.reduceat(rank, start)
            done = least == NEVER
            if done.any():
                whole = np.repeat(done, n)
                counts[word[done]] = n[done]
                out[ragged(into[word[done]], n[done])] = part[whole]
                part, rank, word, n, least = part[~whole], rank[~whole], word[~done], n[~done], least[~done]
                start = np.cumsum(n) - n
                continue
            # the leftmost least rank of each word; the boundary after it goes
            at = np.flatnonzero(rank == np.repeat(least, n))
            owner = np.repeat(np.arange(len(n)), n)[at]
            at = at[np.append(True, owner[1:] != owner[:-1])]
            part[at] = self.made[least]
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # NEVER where the deleted part was the last one
            part, rank, n, at = part[keep], rank[keep], n - 1, at - np.arange(len(n))
            start = np.cumsum(n) - n
            i = at[at + 1 < start + n]
            rank[i] = self.lookup(part[i], part[i + 1])
            i = at[at > start]
            rank[i - 1] = self.lookup(part[i - 1], part[i])
        return out[ragged(into, counts)], counts

    def merged_long(self, word: bytes) -> list[int]:
        """Ids of one long word: boundaries as a linked list, ranks in a heap by (rank, place)."""
        part = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, heap = len(part), []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := self.rank.get(part[i] << 32 | part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the parts has gone or grown meanwhile
            part[i], part[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x in part if x >= 0]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each); added tokens are ids of their own."""
        data = [w.encode() for w in words]
        short = [k for k, w in enumerate(words) if w not in self.added and len(data[k]) <= LONGEST]
        flat, n = self.merged([data[k] for k in short]) if short else (np.empty(0, np.int64), np.empty(0, np.int64))
        if len(short) == len(words):
            return flat, n
        lists: list = [None] * len(words)
        for k, ids in zip(short, np.split(flat, np.cumsum(n)[:-1]), strict=True) if short else ():
            lists[k] = ids
        for k, w in enumerate(words):
            if lists[k] is None:
                lists[k] = np.array([self.added[w]] if w in self.added else self.merged_long(data[k]), np.int64)
        return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))

    def cut_words(self, text: str) -> list[str]:
        """Added tokens and, between them, the words of the split."""
        if not self.cut or not any(t in text for t in self.added):
            return self.split(text)
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self.split(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); words that occur again are merged once."""
        index: dict[str, int] = defaultdict()
        index.default_factory = index.__len__
        rows = [np.fromiter(map(index.__getitem__, w), np.int64, len(w)) for w in map(self.cut_words, texts)]
        if not index:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        flat, n = self.words(list(index))
        start, every = np.cumsum(n) - n, np.concatenate(rows)
        sums = np.concatenate([[0], np.cumsum(n[every])])
        ends = np.cumsum([len(r) for r in rows])
        return flat.astype(np.int32)[ragged(start[every], n[every])], np.diff(sums[np.concatenate([[0], ends])])

    def decode(self, ids: list[int | None]) -> str:
        known = self.bytes
        return b"".join([known.get(k, b"") for k in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """Read once a worker."""
    return Merges(path)


def _carried(df: DataFrame, made: dict[str, T.DataType]) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c not in made]
    return kept, T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, kind) for c, kind in made.items())])


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices with about CHARS bytes of text in the last column each (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    for rows in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // CHARS)) + 1):
        if len(rows):
            yield batch.slice(rows[0], len(rows))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The rows with the ids of their text (array of int); added tokens are recognised, none is put around the text.

    decoded: name of a further column, the text that the ids stand for, made in the same pass.
    """
    made = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    kept, schema = _carried(df, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = merges(path)
        for batch in batches:
            for part in sliced(batch):
                flat, n = v.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    new.append(pa.array([v.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=schema.names)

    return df.select(*(df[c] for c in kept), df[text]).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for; special tokens are written out."""
    kept, schema = _carried(df, {decoded: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = merges(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lens = np.diff(column.offsets.to_numpy())
            for rows in np.split(np.arange(len(lens)), np.flatnonzero(np.diff(np.cumsum(lens) // IDS)) + 1):
                if len(rows):
                    some = batch.slice(rows[0], len(rows))
                    texts = [v.decode(x or ()) for x in some.column(some.num_columns - 1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return df.select(*(df[c] for c in kept), df[ids]).mapInArrow(run, schema)
