"""Spelling variants: words one inserted, deleted or replaced character apart, by pairs of trie nodes.

Words are counted on Spark.  Those that are long and frequent enough are sorted, once as
they are and once reversed, and each order numbers the nodes of its trie: a word that
shares p characters with the word before it makes a new node for each further one, and
the numbers go on from partition to partition.  No prefix is written out.  A word of n
characters then has n + 1 nodes from the front and n + 1 from the back.

A word gives the pair (prefix node, suffix node) of the text around each of its
characters, and around each place between two.  Equal pairs are joined: two words that
skip a character between the same nodes differ by a replaced character; a word that
skips one where another has none differs from it by an inserted or deleted one.  In a
run of equal characters only the first is skipped for that, so each two near words meet
exactly once, and a group has one word for each character of the alphabet and one
without at most.  Groups are reduced to counts and best words; no pairs are listed.

A word's form is its near word of largest count (ties: smallest in code-point order) if
that is `ratio` times its own at least.  Counts grow along forms, so the last form is
reached by doubling in a few rounds.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one
in the checksum; other columns are ignored; repeated rows count again; an empty table
gives an empty result; very long words are words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: code points and occurrences of a word, times that a form must occur as often
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: every so many checksums a character is lost
LOST = 199
#: characters of words whose nodes are numbered at a time
CHARS = 1_000_000


def _low(word: Column) -> Column:
    """A-Z in lower case; most words have none, and then only lower() looks at them."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all texts, one character less where LOST divides crc32('<doc_id>:<run>')."""
    # a shorter run can't become a word
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{RUN}{{{length},}}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":")).alias("head"), F.explode(runs).alias("run"))
    rows = rows.select("head", _low(F.col("run")).alias("run")).withColumn("h", F.crc32(F.concat("head", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % LOST == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _common(a: str, b: str) -> int:
    """Number of leading characters that two words share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], and the first difference is before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def _sorted_words(df: DataFrame, order: str) -> DataFrame:
    """The rows sorted by a column of different words over all partitions, and written: the partitions stay as they are."""
    return checkpoint(df.sort(order))


def _edges(df: DataFrame, order: str) -> list[tuple]:
    """Per partition that has rows, in order: (partition, rows, nodes it makes if nothing came before, first and last word,
    nodes of the last word counted from its first node on, the root being 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, made, first, last, nodes = 0, 0, None, "", np.zeros(1, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                p = _common(last, word) if rows else 0
                nodes = np.append(nodes[: p + 1], np.arange(made + 1, made + 1 + len(word) - p))
                made += len(word) - p
                first, last, rows = word if first is None else first, word, rows + 1
        if rows:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "rows": [rows], "made": [made], "first": [first], "last": [last], "nodes": [nodes]})

    found = df.select(order).mapInArrow(run, "part int, rows long, made long, first string, last string, nodes array<long>").collect()
    return sorted(map(tuple, found))


def numbered(df: DataFrame, word: str, nodes: str, rank: str | None = None) -> DataFrame:
    """The rows with the numbers of their word's trie nodes (root first, it is 0) and, if asked for, their place in sorted order.

    A row for each partition goes through the driver: its first and last word and the latter's nodes.
    """
    df = _sorted_words(df, word)
    before, last, held, base, row = {}, "", np.zeros(1, np.int64), 0, 0
    for part, rows, made, first, end, own in _edges(df, word):
        p = _common(last, first) if row else 0
        # what the partition starts with: rows and nodes so far, and the nodes that its first word has already
        before[part] = (row, base, held[: p + 1], first)
        own = np.array(own, np.int64)
        shared = min(p, _common(first, end))
        own = np.where(own > 0, own + base - p, 0)
        own[: shared + 1] = held[: shared + 1]
        last, held, base, row = end, own, base + made - p, row + rows
    kept = [c for c in df.columns if c != word]
    kinds = [f"`{word}` string", *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)]
    names = [word, *kept, nodes, *([rank] if rank else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, made, has, first = before.get(TaskContext.get().partitionId(), (0, 0, np.zeros(1, np.int64), ""))
        last = first[: len(has) - 1]
        for batch in batches:
            begin, chars, lists = 0, 0, []
            for i, w in enumerate(batch.column(0).to_pylist()):
                p = _common(last, w)
                has = np.append(has[: p + 1], np.arange(made + 1, made + 1 + len(w) - p))
                made, last, chars = made + len(w) - p, w, chars + len(w)
                lists.append(has)
                if chars >= CHARS or i + 1 == batch.num_rows:
                    some = batch.slice(begin, len(lists))
                    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                    out = [*some.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))]
                    if rank:
                        out.append(pa.array(np.arange(place, place + len(lists))))
                    yield pa.RecordBatch.from_arrays(out, names=names)
                    begin, chars, place, lists = i + 1, 0, place + len(lists), []

    schema = ", ".join([*kinds, f"`{nodes}` array<long>", *([f"`{rank}` long"] if rank else [])])
    return df.select(word, *kept).mapInArrow(run, schema)


def _best(rows: Column) -> Column:
    """The most frequent of (n, -id) structs, the one of smallest id among equals; null if there is none."""
    return F.array_max(rows)


def near(vocabulary: DataFrame) -> DataFrame:
    """(id, word, n, n_near, best_n, best) of each word of (word, n): ids follow code-point order, best is the id of the most frequent near word."""
    front = checkpoint(numbered(vocabulary, "word", "f", "id"))
    back = numbered(front.select("id", F.reverse("word").alias("drow")), "drow", "b").select("id", "b")
    both = checkpoint(front.join(back, "id"))
    size = F.length("word")
    # b counted from the end: the suffix that starts at place i has n - i characters
    skip = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("f", i).alias("f"), F.get("b", size - 1 - i).alias("b"),
        ((i == 0) | (F.get("letters", i - 1) != F.get("letters", i))).alias("lead"), F.lit(False).alias("gap")))
    gap = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        F.get("f", i).alias("f"), F.get("b", size - i).alias("b"), F.lit(False).alias("lead"), F.lit(True).alias("gap")))
    rows = both.withColumn("letters", F.split("word", "")).select("id", "n", F.explode(F.concat(skip, gap)).alias("r")).select("id", "n", "r.*")
    # a group holds a word for each character at its place, and one without any, at most
    member = F.struct("n", (-F.col("id")).alias("o"), "lead", "gap")
    groups = rows.groupBy("f", "b").agg(F.collect_list(member).alias("g")).where(F.size("g") > 1)
    skipping = F.filter("g", lambda x: ~x.gap)
    leading = F.filter("g", lambda x: x.lead)
    groups = groups.select("g", skipping.alias("s"), leading.alias("l"), F.get(F.filter("g", lambda x: x.gap), F.lit(0)).alias("u"))
    pair = lambda x: F.struct(x.n.alias("n"), x.o.alias("o"))
    groups = groups.withColumn("s2", F.slice(F.sort_array(F.transform("s", pair), False), 1, 2)).withColumn("l1", _best(F.transform("l", pair)))
    none = F.lit(None).cast("struct<n:bigint,o:bigint>")
    one = groups.select(F.explode("g").alias("x"), F.size("s").alias("n_s"), F.size("l").alias("n_l"), "u", "s2", "l1")
    other = F.when(F.get("s2", F.lit(0)).o == F.col("x.o"), F.get("s2", F.lit(1))).otherwise(F.get("s2", F.lit(0)))
    longer = F.when(F.col("x.lead") & F.col("u").isNotNull(), F.struct(F.col("u.n").alias("n"), F.col("u.o").alias("o"))).otherwise(none)
    count = F.when(F.col("x.gap"), F.col("n_l")).otherwise(F.col("n_s") - 1 + longer.isNotNull().cast("int"))
    best = F.when(F.col("x.gap"), F.col("l1")).otherwise(F.array_max(F.array(other, longer)))
    found = one.select((-F.col("x.o")).alias("id"), count.alias("c"), best.alias("best")).where("c > 0")
    found = found.groupBy("id").agg(F.sum("c").alias("n_near"), F.max("best").alias("best"))
    return both.select("id", "word", "n").join(found, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.n").alias("best_n"), (-F.col("best.o")).alias("best"))


def forms(known: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the rows of near()."""
    known = known.withColumn("form_id", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")))
    known = checkpoint(known)
    step = known.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("root"))
    while True:
        # each word jumps to what its target points at, so the way left halves
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        ahead = checkpoint(step.join(jump, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = ahead.select("id", "root")
        if ahead.where("moved").isEmpty():
            break
    names = lambda a, b: known.select(F.col("id").alias(a), F.col("word").alias(b))
    targets = step.join(known.select("id", "form_id", F.col("best_n").alias("form_n")), "id")
    targets = targets.join(names("form_id", "form"), "form_id").join(names("root", "root_word"), "root").select("id", "form", F.col("root_word").alias("root"), "form_n")
    return known.select("id", "word", "n", "n_near").join(targets, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    return forms(near(words(docs, doc_id, text, length, least)), ratio)
