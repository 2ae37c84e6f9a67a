"""Benchmark decontamination with DataFrame functions only.

A text's words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased.  Every 10 consecutive words of a benchmark item are a window; an item
of fewer words (but not none) is one window.  Each document's window hashes are
built in one pass by doubling (1, 2, 4, 8 words, combined for other lengths),
looked up in the broadcast hash set of the benchmark's windows, and every lookup
hit is verified word by word before it counts.

Results depend on the text alone, so they are keyed by it: copies (also a third of
all rows) collapse in the map-side aggregation, and nothing is grouped by doc_id.

Defined cases: a null or empty text has no words and no hits; repeated rows and
repeated or null doc_ids get the same result on each row; equal item_ids count
once, a null item_id marks words but isn't listed; an empty benchmark hits nothing;
columns of the input other than the text are carried, those named like a result
column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, text_key

# fixed values: the word class and the letters that are lower-cased
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# the same classes before A-Z are lower-cased
RAW_WORD, RAW_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: windows of a benchmark that are broadcast at most (about 300 bytes each); more are joined by shuffle
BROADCAST_WINDOWS = 500_000
OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), 1)


def _joined(a: Column, b: Column, shift: int, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Hash of a[i] and b[i + shift] for each i that has both."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), lambda x, y: hashed(x, y))


def _with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds columns _w{L}: the hashes of all windows of L words, in order of their first word."""
    df = df.withColumn("_p1", F.transform("_words", lambda w: F.xxhash64(w)))
    p = 1
    while 2 * p <= max(lengths):
        df = df.withColumn(f"_p{2 * p}", _joined(F.col(f"_p{p}"), F.col(f"_p{p}"), p))
        p *= 2
    for n in lengths:
        bits = [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]
        col, done = F.col(f"_p{bits[0]}"), bits[0]
        for b in bits[1:]:
            col, done = _joined(col, F.col(f"_p{b}"), done), done + b
        df = df.withColumn(f"_w{n}", col)
    return df


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, len, win): every window of every item, as an array of words."""
    n = F.size("_words")
    return (
        benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("_words"))
        .where(n > 0)
        .withColumn("len", F.least(n, F.lit(WINDOW)))
        .select("item", "len", F.explode(F.transform(
            F.sequence(F.lit(1), n - F.col("len") + 1), lambda i: F.slice("_words", i, F.col("len")))).alias("win"))
        .distinct()
    )


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
         item_text: str = "text", limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """(key, start, end, item): verified occurrences of windows in each distinct text, by word position."""
    wins = benchmark_windows(benchmark, item, item_text)
    counts = {r["len"]: r["n"] for r in wins.groupBy("len").agg(F.count("*").alias("n")).collect()}  # 10 rows at most
    lengths = sorted(counts) or [WINDOW]
    wins = _with_hashes(wins.withColumnRenamed("win", "_words"), lengths)
    # never null: else a null filter with the whole expression would go below the windows
    own = F.coalesce(*[F.when(F.col("len") == n, F.col(f"_w{n}")[0]) for n in lengths], F.lit(0))
    wins = wins.select("item", "len", F.col("_words").alias("win"), own.alias("hash"))

    keyed = docs.select(text_key(F.col(text)).alias("key"), words(F.col(text)).alias("_words"))
    # one list of hashes: the windows of the shortest length first, so the index tells the first word
    listed = _with_hashes(keyed, lengths).select(
        "key", "_words", F.concat(*[F.col(f"_w{n}") for n in lengths]).alias("_all"))
    at = listed.select("key", "_words", F.posexplode_outer("_all").alias("_pos", "hash"))
    before, offset = F.lit(0), []
    for n in lengths:
        offset.append(F.when(F.col("len") == n, before))
        before = before + F.greatest(F.size("_words") - (n - 1), F.lit(0))
    start = F.col("_pos") - F.coalesce(*offset)
    same = F.slice(F.col("_words"), start + 1, F.col("len")) == F.col("win")
    inside = (start >= 0) & (start + F.col("len") <= F.size("_words"))
    if sum(counts.values()) <= limit:
        found = at.join(F.broadcast(wins), "hash").where(inside)
    else:  # too many for a broadcast: the positions travel without their words, which are joined for verification
        narrow = at.select("key", "_pos", "hash").join(wins, "hash").select("key", "_pos", "item", "len", "win")
        found = narrow.distinct().join(keyed.dropDuplicates(["key"]), "key").where(inside)
    return found.where(same).select("key", start.alias("start"), (start + F.col("len")).alias("end"), "item")


def _covered(spans: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"),
        F.greatest(a["reach"], s["end"]).alias("reach"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items_sha256, contaminated and spans (word start, end)."""
    found = hits(docs, benchmark, text, limit=limit).groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("_items"))
    found = found.select(F.col("key").alias("_key"), "spans", "_items")
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows, back = shielded(docs, [text])
    out = rows.withColumns({"_key": text_key(F.col(text)), "n_words": F.size(words(F.col(text))).cast("long")})
    out = out.join(found, "_key", "left").withColumn("spans", F.coalesce("spans", none))
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return back(out.withColumns({
        "n_hit": _covered(F.col("spans")),
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", items), 256),
        "contaminated": F.size("spans") > 0,
    }).drop("_key", "_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a benchmark window, with their own columns."""
    bad = hits(docs, benchmark, text).select(F.col("key").alias("_key")).distinct()
    rows, back = shielded(docs, [text])
    return back(rows.withColumn("_key", text_key(F.col(text))).join(bad, "_key", "left_anti").drop("_key"))


def remove_spans(marked: DataFrame, text: str = "text") -> DataFrame:
    """The result of decontaminate() with the hit words (and what separates them) cut out of the text."""
    parts = F.regexp_extract_all(F.col(text), F.lit(f"({RAW_WORD}|{RAW_GAP})"), 1)
    first = F.when(F.col("_parts")[0].rlike(f"^{RAW_WORD}$"), 0).otherwise(1)
    word = lambda j: F.floor((j - F.col("_first")) / 2)
    kept = F.filter("_parts", lambda p, j: ~F.exists("spans", lambda s: (word(j) >= s["start"]) & (word(j) < s["end"])))
    cut = F.when(F.size("spans") > 0, F.concat_ws("", kept)).otherwise(F.col(text))
    marked, back = shielded(marked, [text, "spans"])
    return back(marked.withColumn("_parts", F.filter(parts, lambda p: F.length(p) > 0))
            .withColumn("_first", F.when(F.size("_parts") > 0, first).otherwise(0))
            .withColumn(text, cut).drop("_parts", "_first"))
