"""Shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups.

Rows with equal texts form a group that stays together.  Groups larger than a
bundle (total bytes / (shards x BUNDLES)) are items of their own, at most
shards x BUNDLES of them; the others are hashed into shards x BUNDLES bundles.  So
the differencing sees at most twice that many items at any data size, each with
its exact bytes, and the assignment is a table of proven size to broadcast.

Rows are numbered within cells (a bundle's rows salted into cells of about
CELL_ROWS), and cells are offset within their shard, so neither a shard nor a
group of copies is ever sorted in one task.

Defined cases: a null text has no bytes and is grouped with empty texts; null or
repeated doc_ids and repeated rows each get a slot; an empty table gives an empty
result; fewer groups than shards leaves shards without rows.  Other columns of the
input are not part of the assignment; shard_rows() carries them all.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shielded, text_key

SHARDS = 24
#: bundles a shard; items of the differencing are at most 2 x SHARDS x BUNDLES
BUNDLES = 200
CELL_ROWS = 20_000


def differencing(sizes: list[int], n: int) -> list[int]:
    """The bin of each item: the two partial partitions of largest spread are combined, oppositely ordered."""
    heap = [(-s, i, [s] + [0] * (n - 1), [[i]] + [[] for _ in range(n - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    seq = len(heap)
    while len(heap) > 1:
        _, _, loads_a, items_a = heapq.heappop(heap)
        _, _, loads_b, items_b = heapq.heappop(heap)
        merged = []
        for x, ia, y, ib in zip(loads_a, items_a, reversed(loads_b), reversed(items_b), strict=True):
            if len(ia) < len(ib):
                ia, ib = ib, ia
            ia.extend(ib)
            merged.append((x + y, ia))
        merged.sort(key=lambda m: -m[0])
        least = merged[-1][0]
        heapq.heappush(heap, (least - merged[0][0], seq, [m[0] - least for m in merged], [m[1] for m in merged]))
        seq += 1
    out = [0] * len(sizes)
    for b, items in enumerate(heap[0][3] if heap else []):
        for i in items:
            out[i] = b
    return out


def _measured(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": F.octet_length(t).cast("long") + 8, "text_crc32": F.crc32(t.cast("binary")),
                             "_key": text_key(F.col(text))})


def plan(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(large: _key of the groups that are items of their own; bundles: _bundle, shard, _rows). Both are bounded."""
    spark, n = docs.sparkSession, shards * BUNDLES
    groups = checkpoint(_measured(docs, text).groupBy("_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    is_large = F.col("bytes") * n > total
    small = F.concat(F.lit("h"), F.pmod(F.xxhash64("_key"), F.lit(n)).cast("string"))
    items = (
        groups.withColumn("_bundle", F.when(is_large, F.col("_key")).otherwise(small))
        .groupBy("_bundle").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max(is_large).alias("large"))
        .collect()  # 2 x n rows at most: n bundles, and n groups that each hold over 1 / n of the bytes
    )
    items.sort(key=lambda r: (-r["bytes"], r["_bundle"]))
    bins = differencing([r["bytes"] for r in items], shards)
    bundles = spark.createDataFrame([(r["_bundle"], b, r["rows"]) for r, b in zip(items, bins, strict=True)],
                                    "_bundle string, shard int, _rows long")
    large = spark.createDataFrame([(r["_bundle"], r["_bundle"]) for r in items if r["large"]], "_key string, _own string")
    return large, bundles


def _placed(docs: DataFrame, shards: int, text: str) -> DataFrame:
    large, bundles = plan(docs, shards, text)
    small = F.concat(F.lit("h"), F.pmod(F.xxhash64("_key"), F.lit(shards * BUNDLES)).cast("string"))
    return (
        _measured(docs, text).join(F.broadcast(large), "_key", "left")
        .withColumn("_bundle", F.coalesce("_own", small)).join(F.broadcast(bundles), "_bundle").drop("_own")
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """All rows and columns with their shard (a column of that name is replaced); two broadcast joins, no shuffle of texts."""
    rows, back = shielded(docs, [text])
    return back(_placed(rows, shards, text).drop("size", "text_crc32", "_key", "_bundle", "_rows"))


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = _placed(rows, shards, "text").select("doc_id", "size", "text_crc32", "shard", "_bundle", "_rows")
    cells = F.ceil(F.col("_rows") / CELL_ROWS)
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64(F.lit(7), "doc_id"), cells).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bundle", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "_bundle", "_cell").agg(F.count("*").alias("n"))
               .withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "shard"))
    within = Window.partitionBy("_bundle", "_cell").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("_no", F.row_number().over(within) - 1).join(offsets, ["_bundle", "_cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("_first") + F.col("_no")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
