"""Hard negatives by Fagin's threshold algorithm over blocks of vectors.

A component x counts as floor(256 x); a score is an integer inner product.  The rows are
hashed into blocks of about `rows` rows, the anchors into groups of about `group`.  A
block keeps, for each dimension, the order of its rows by that component.  An anchor
reads these lists from the end that its sign asks for, scores each row that it meets in
full, and stops once no unread row can count: the threshold, the score of a row that has
the last read component in every dimension, lies strictly below the score of the last
row wanted in each window, or below the window where it isn't full yet.  Where fewer
rows are left than the next step would read from a list, they are all scored, and the
block is done.  A first pass finds an anchor's positives this
way, over the rows of its label; a second one the negatives of all its windows, over the
rows of the other labels.  What the blocks return, a bounded number of rows an anchor and
window, is ranked over all blocks, so results are exact and ties go to the smaller id.

Blocks and groups meet by key (block, group) in a cogroup; each side is repeated for the
other one's parts only, no task holds more than a block and a group, and a lost one is
read again.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part; of vectors of different lengths the shorter ones count as
followed by zeros; repeated ids are rows of their own, and a repeated anchor returns its
rows again; other columns are ignored; an anchor without positives, and a positive
without negatives in its window, return nothing; an empty table gives an empty result.
A score that a long can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SCALE, LABELS = 256, 10
#: rows of a block and anchors of a group, on average
ROWS, GROUP = 16_384, 2_048
POSITIVES, NEGATIVES = 5, 3
#: a negative's score in hundredths of its positive's
LOW, HIGH = 50, 95
#: rows of each list that are read first, and how many times as many are read next
DEPTH, GROWTH = 32, 4


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", relabel: int | None = 7) -> DataFrame:
    """(row, id, label, v): the rows that take part, with a number of their own and integer components; labels of ids divisible by relabel move on by one."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("id") % relabel == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", lambda x: F.floor(F.lit(SCALE) * x)).alias("v"))


class Block:
    """Integer vectors with their ids, and one list of rows a dimension, by rising component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        by = np.argsort(ids, kind="stable")
        self.by, self.ids, self.x = by, ids[by], x[by]  # among equal scores the smaller id comes first
        self.order = np.argsort(self.x, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.x, self.order.T, 0).T.copy()
        self.most = int(np.abs(x).max(initial=0))
        self.exact = x.astype(np.float64)[by] if self.most < 1 << 53 else None

    def scores(self, rows: np.ndarray | slice, anchor: np.ndarray) -> np.ndarray:
        """Inner products in integers: by doubles while they are exact, else by longs."""
        bound = self.most * int(np.abs(anchor).astype(object).sum()) if len(anchor) else 0
        if bound >= 1 << 63:
            raise OverflowError("a score doesn't fit in a long")
        if self.exact is not None and bound < 1 << 53:
            return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ anchor

    def best(self, anchor: np.ndarray, windows: np.ndarray, k: int, wanted: np.ndarray | None = None, own: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) of scores the best k rows in it, as (places, scores), by falling score, then id.

        wanted: mask of the rows that count; own: a place that doesn't.
        """
        n = len(self.ids)
        used = np.flatnonzero(anchor)
        # reading from the end with the greatest products; a zero needs no list
        lists = [self.order[d] if anchor[d] < 0 else self.order[d][::-1] for d in used]
        weight = anchor[used].tolist()
        met, whole = np.zeros(n, bool), None
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        depth = 0
        while True:
            before, depth, old = depth, min(n, max(DEPTH, GROWTH * depth)) if len(used) else n, met.copy()
            if n - np.count_nonzero(met) <= depth - before:
                depth = n  # the rows left are fewer than each list would give: all are scored
                met[:] = True
            else:
                for order in lists:
                    met[order[before:depth]] = True
            new = np.flatnonzero(met & ~old)
            if whole is None and len(new) * 4 > n:  # one product is cheaper than gathering so many rows
                whole = self.scores(slice(None), anchor)
            s = self.scores(new, anchor) if whole is None else whole[new]
            counts = np.ones(len(new), bool) if wanted is None else wanted[new]
            if own >= 0:
                counts &= new != own
            new, s = new[counts], s[counts]
            for j, (low, high) in enumerate(windows):
                at = np.flatnonzero((s >= low) & (s <= high))
                if len(at) > k:
                    at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                places, scores = np.concatenate([found[j][0], new[at]]), np.concatenate([found[j][1], s[at]])
                by = np.lexsort((places, -scores))[:k]
                found[j] = places[by], scores[by]
            if met.all():
                return found
            last = self.sorted[used, np.where(anchor[used] < 0, depth - 1, n - depth)]
            threshold = sum(w * x for w, x in zip(weight, last.tolist(), strict=True))
            if threshold < min(scores[-1] if len(scores) == k else low for (_, scores), low in zip(found, windows[:, 0], strict=True)):
                return found


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integer lists, shorter ones followed by zeros."""
    column = column.combine_chunks()
    lens = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width)[None, :] < lens[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _sides(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right))
    return _matrix(left.column("v"), width), _matrix(right.column("v"), width)


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _table(parts: Iterable[dict[str, np.ndarray]], names: str) -> pa.Table:
    parts = list(parts)
    empty = np.empty(0, np.int64)
    return pa.table({c: pa.array(np.concatenate([p[c] for p in parts] or [empty]).astype(np.int64)) for c in names.split()})


ALL = np.array([[-(1 << 63) + 1, (1 << 63) - 1]])


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Best rows of the same label in a block, for each anchor of a group."""
    a, x = _sides(anchors, rows)
    labels, of_anchor, ids, row, number = _ints(rows, "label"), _ints(anchors, "label"), _ints(rows, "id"), _ints(rows, "row"), _ints(anchors, "row")
    out = []
    for label in np.unique(of_anchor):
        mine = np.flatnonzero(labels == label)
        if not len(mine):
            continue
        block = Block(ids[mine], x[mine])
        at = row[mine][block.by]
        for i in np.flatnonzero(of_anchor == label):
            own = np.flatnonzero(at == number[i])
            places, scores = block.best(a[i], ALL, POSITIVES, own=int(own[0]) if len(own) else -1)[0]
            out.append({"anchor": np.full(len(places), number[i]), "other": block.ids[places], "score": scores})
    return _table(out, "anchor other score")


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Best rows of other labels in a block, for each anchor of a group and each of its windows."""
    a, x = _sides(anchors, rows)
    block = Block(_ints(rows, "id"), x)
    labels, of_anchor, number = _ints(rows, "label")[block.by], _ints(anchors, "label"), _ints(anchors, "row")
    out = []
    for i, scores in enumerate(anchors.column("scores").to_pylist()):
        # 50 p <= 100 n <= 95 p, in whole numbers; none if p < 0
        windows = np.array([[-(-LOW * p // 100), HIGH * p // 100] for p in scores], np.int64)
        some = np.flatnonzero(windows[:, 0] <= windows[:, 1])
        if not len(some):
            continue
        for j, (places, s) in zip(some, block.best(a[i], windows[some], NEGATIVES, labels != of_anchor[i]), strict=True):
            full = np.full(len(places), 0)
            out.append({"anchor": full + number[i], "place": full + j, "other": block.ids[places], "score": s})
    return _table(out, "anchor place other score")


def _meet(anchors: DataFrame, rows: DataFrame, n_groups: int, n_blocks: int, work, schema: str) -> DataFrame:
    """work(group of anchors, block of rows) for each group and block."""
    block, group = F.sequence(F.lit(0), F.lit(n_blocks - 1)), F.sequence(F.lit(0), F.lit(n_groups - 1))
    left = anchors.withColumn("block", F.explode(block)).withColumn("group", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(n_groups)).cast("int"))
    # both sides come from one table; new names of the same columns tell them apart
    right = rows.select(*(F.col(c).alias(c) for c in rows.columns)).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_blocks)).cast("int")).withColumn("group", F.explode(group))
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(
        lambda a, b: work(a, b) if a.num_rows and b.num_rows else work(a.slice(0, 0), b.slice(0, 0)), schema)


def _first(df: DataFrame, by: list[str], k: int, order: list[Column], rank: str) -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def mine(vectors: DataFrame, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", relabel: int | None = 7,
         rows: int = ROWS, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id `every` divides."""
    data = checkpoint(prepared(vectors, vec_id, embedding, label, relabel))
    is_anchor = F.col("id") % every == 0
    n, n_anchors = data.agg(F.count("*"), F.count_if(is_anchor)).first()
    n_blocks, n_groups = max(1, -(-n // rows)), max(1, -(-n_anchors // group))
    anchors = data.where(is_anchor)
    order = [F.col("score").desc(), F.col("other").asc()]
    near = _meet(anchors, data, n_groups, n_blocks, _positives, "anchor long, other long, score long")
    near = checkpoint(_first(near, ["anchor"], POSITIVES, order, "place"))
    # the places start at 0 in the windows
    scores = near.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x.score).alias("scores"))
    found = _meet(anchors.join(scores, "row"), data, n_groups, n_blocks, _negatives, "anchor long, place long, other long, score long")
    found = _first(found, ["anchor", "place"], NEGATIVES, order, "rank")
    positives = near.select("anchor", (F.col("place") - 1).cast("long").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(positives, ["anchor", "place"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
