"""Toxicity by maximum-scoring segments over token log-odds.

Fit, on a bounded sample of labelled documents: every word gives itself and its
prefixes of 4 and 5 letters as features, counted once for each distinct pair of
neighbours, so that copies of a passage count once.  A feature's weight is the
lower bound (two standard errors) of its log-odds ratio between the classes under
a Dirichlet prior that is proportional to the feature's overall frequency.
Features of a weight and z-score below the limits are not kept.

Scan, linear in the words: a word weighs as its heaviest feature, any other word
weighs GAP; all maximal scoring segments are found in one pass.  By extreme-value
theory the number of chance segments of score s in n words is about
n exp(-lambda s), with lambda solved from the clean sample's word weights; the best
segment's significance and the number of significant ones are mapped to a
probability by a logistic curve fitted on the sample.

Defined cases: null and empty texts have no segment; without labelled rows of both
classes every score is the smoothed share of label 1; other columns are carried,
those named like a result column are replaced; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, chunks, free_name
from .labelled import logistic, remainder, sample, sigmoid

MODULO, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: the bounds of the fit: labelled documents of each class, features of the lexicon
SAMPLE_ROWS, MAX_LEXICON = 3000, 20_000
#: share of all counts that the prior adds; limits of z-score and weight
PRIOR, Z_MIN, WEIGHT_MIN = 0.05, 3.5, 1.5
GAP = -0.25
WORD = re.compile(r"\w+")
PREFIXES = (4, 5)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    rate: float
    weights: tuple[float, float, float]


def features(word: str) -> list[str]:
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def _counts(picked: DataFrame) -> DataFrame:
    """(f, y, n): distinct neighbourhoods of each feature in each class."""
    from zlib import crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = WORD.findall(text.lower())
                seen = set()
                for a, b, c in zip(["", *w], w, [*w[1:], ""], strict=False):
                    where = crc32(f"{a} {c}".encode())
                    seen.update((f, where) for f in features(b))
                yield pa.RecordBatch.from_pydict(
                    {"f": pa.array([s[0] for s in seen], pa.string()), "at": pa.array([s[1] for s in seen], pa.int64()), "y": pa.array([y] * len(seen), pa.int32())})

    rows = picked.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "f string, at long, y int")
    return rows.distinct().groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))


def _lexicon(picked: DataFrame) -> dict[str, float]:
    counts = checkpoint(_counts(picked))
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not total["a"] or not total["b"]:
        return {}
    g = (F.col("a") + F.col("b")) * PRIOR
    odds = lambda n, t: F.log((n + g) / (t + PRIOR * (total["a"] + total["b"]) - n - g))
    rows = (counts.withColumn("d", odds(F.col("a"), total["a"]) - odds(F.col("b"), total["b"]))
            .withColumn("e", F.sqrt(1 / (F.col("a") + g) + 1 / (F.col("b") + g)))
            .withColumn("w", F.col("d") - 2 * F.col("e")).where((F.col("d") / F.col("e") >= Z_MIN) & (F.col("w") >= WEIGHT_MIN))
            .orderBy(F.desc(F.col("d") / F.col("e")), "f").limit(MAX_LEXICON).collect())
    return {r["f"]: r["w"] for r in rows}


def word_weights(text: str, lexicon: dict[str, float]) -> tuple[list[tuple[int, float]], int]:
    """((place, weight) of each word with a known feature, number of words)."""
    words = WORD.findall(text.lower())
    get, out = lexicon.get, []
    for i, w in enumerate(words):
        best = max(get(w + "$", 0.0), get(w[:4], 0.0), get(w[:5], 0.0))
        if best:
            out.append((i, best))
    return out, len(words)


def segments(hits: list[tuple[int, float]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) of words that weigh as in hits or else GAP, in linear time."""
    # candidates: sum before it, sum at its end, first, end, and the next candidate below with a smaller sum before it
    stack: list[tuple[float, float, int, int, int]] = []
    total, after = 0.0, 0
    for i, w in hits:
        left = total + GAP * (i - after)
        right, first = left + w, i
        total, after = right, i + 1
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                break
            left, first, below = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = below
        stack.append((left, right, first, i + 1, j))
    return [(r - l, a, b) for l, r, a, b, _ in stack]


def _significance(best: float, n: int, rate: float) -> float:
    """-ln of the probability of a segment as good by chance, between 0 and 50."""
    if best <= 0:
        return 0.0
    expected = n * math.exp(-rate * best)
    return min(50.0, -math.log(max(-math.expm1(-expected), 1e-25)))


def _measure(text: str, lexicon: dict[str, float], rate: float) -> tuple[float, int, list[tuple[float, int, int]], int]:
    hits, n = word_weights(text, lexicon)
    found = segments(hits)
    best = max((s[0] for s in found), default=0.0)
    bound = math.log(max(n, 1) / 0.05) / rate  # one chance segment in twenty texts of this length
    return best, sum(s[0] >= bound for s in found), [s for s in found if s[0] >= bound], n


def _x(best: float, n_sig: int, n: int, rate: float) -> list[float]:
    return [_significance(best, n, rate), best + math.log1p(n_sig)]


def _rate(weights: dict[float, int], words: int) -> float:
    """lambda with the mean of exp(lambda weight) over the clean words equal to 1, from the words of each weight; at most 1, the value of true log-odds."""
    if not words:
        return 1.0
    gaps = words - sum(weights.values())
    value = lambda t: (math.exp(GAP * t) * gaps + sum(n * math.exp(t * w) for w, n in weights.items())) / words - 1
    lo, hi = 1e-3, 1.0
    if value(hi) <= 0:
        return hi
    if value(lo) >= 0:
        return 0.05
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return max(lo, 0.05)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    picked, counts = sample(docs, labels, label, MODULO, HELD_OUT, rows)
    if not counts[0] or not counts[1]:
        return Model({}, 1.0, (0.0, 0.0, float(logistic(np.empty((0, 2)), np.empty(0), counts)[-1])))
    # two folds, so that the curve is fitted on documents whose words the lexicon hasn't seen
    lexicons = [_lexicon(picked.where(f"half = {1 - k}")) for k in (0, 1)]

    # over whole texts: the clean words of each weight (as many weights as the lexicons have at most), then each text's measures
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = Counter(), 0
            for half, text in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hits, n = word_weights(text, lexicons[half])
                found.update(w for _, w in hits)
                words += n
            yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.float64()), pa.array([words, *found.values()], pa.int64())], names=["w", "n"])

    rows = picked.select(F.col("y").cast("int").alias("y"), F.col("half").cast("int").alias("half"), "text")
    weights = {r["w"]: r["n"] for r in rows.where("y = 0").mapInArrow(counted, "w double, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    words = weights.pop(None, 0)
    rate = _rate(weights, words)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for half, text in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist(), strict=True):
                best, n_sig, _, n = _measure(text, lexicons[half], rate)
                out.append(_x(best, n_sig, n, rate))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())], names=["y", "a", "b"])

    seen = rows.mapInArrow(measured, "y int, a double, b double").collect()
    x = [[r["a"], r["b"]] for r in seen]
    w = logistic(np.array(x).reshape(-1, 2), np.array([r["y"] for r in seen]), counts, ridge=1.0)
    return Model(_lexicon(picked), rate, tuple(map(float, w)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with score, predicted (1 from 0.3) and passages (score, first word, end word of each significant segment)."""
    names = {"score": T.DoubleType(), "predicted": T.IntegerType(),
             "passages": T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))}
    arrow = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in names.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        for batch in batches:
            for part in chunks(batch, batch.num_columns - 1):
                x, passages = [], []
                for t in part.column(part.num_columns - 1).to_pylist():
                    best, n_sig, found, n = _measure(t or "", model.lexicon, model.rate)
                    x.append([*_x(best, n_sig, n, model.rate), 1.0])
                    passages.append([{"score": s, "start": a, "end": b} for s, a, b in found])
                s = sigmoid(np.array(x).reshape(-1, 3) @ w)
                arrays = [part.column(i) for i in range(len(kept))]
                arrays += [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(passages, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return docs.select(*kept, F.col("text").alias(free_name(docs, "_text"))).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), MODULO) == HELD_OUT).alias("held_out"), "score", "predicted", "passages")
