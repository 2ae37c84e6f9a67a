"""Quality classifier by compression with two trained dictionaries.

From a bounded sample of labelled documents one zstandard dictionary is built of
good text and one of bad text.  A text is cut in blocks of BLOCK bytes, the whole
text at any length; each block is compressed with either dictionary.  The
difference of the two compressed sizes over the text's bytes is mapped to a
probability by a logistic curve fitted on the other half of the sample.

Defined cases: null and empty texts have difference 0; without labelled rows of
both classes every score is the smoothed share of label 1; other columns are
carried, those named like a result column are replaced; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, lean, shipped
from .labelled import logistic, remainder, sample, sigmoid

BLOCK = 1024
#: the bounds of the fit: labelled documents of each class, blocks of each that the dictionaries see, dictionary bytes
SAMPLE_ROWS, SAMPLE_BLOCKS, DICT_BYTES = 3000, 8, 65536
MODULO, HELD_OUT = 3, 1
#: bytes added to the length, so that the shortest texts stay near no difference
SMOOTH = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    trained: bool
    weights: tuple[float, float]


def _dictionary(blocks: list[bytes]) -> tuple[bytes, bool]:
    """(bytes, trained): too few blocks for training are joined as a raw dictionary."""
    import zstandard as z

    try:
        return z.train_dictionary(DICT_BYTES, blocks, level=3).as_bytes(), True
    except z.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:], False


def _compressor(data: bytes):  # noqa: ANN202
    import zstandard as z

    trained = data[:4] == b"\x37\xa4\x30\xec"
    d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=3)
    return z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(texts: list[str | None], model: Model) -> np.ndarray:
    """Per text: compressed bytes with the bad dictionary less those with the good one, over the text's bytes."""
    good, bad = _compressor(model.good), _compressor(model.bad)
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        diff = sum(len(bad.compress(raw[i : i + BLOCK])) - len(good.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK))
        out[k] = diff / (len(raw) + SMOOTH)
    return out


def _mapped(df: DataFrame, model: Model, names: dict[str, T.DataType], make) -> DataFrame:  # noqa: ANN001
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t in names.items())])
    rows, at = shipped(df, kept, "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                arrays = [part.column(i) for i in range(len(kept))]
                arrays += make(differences(part.column(at).to_pylist(), model))
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    picked, counts = sample(docs, labels, label, MODULO, HELD_OUT, rows)
    span = F.greatest(F.length("text") - BLOCK, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_BLOCKS - 1)),
                      lambda i: F.substring(F.col("text"), (F.floor(span * i / (SAMPLE_BLOCKS - 1)) + 1).cast("int"), F.lit(BLOCK)))
    train = picked.where("half = 0").select("doc_id", "y", F.array_distinct(cut).alias("b")).orderBy("doc_id").collect()
    blocks = {y: [b.encode() for r in train if r["y"] == y for b in r["b"] if b] for y in (0, 1)}
    if not blocks[0] or not blocks[1]:
        return Model(b"", b"", False, (0.0, float(logistic(np.empty((0, 1)), np.empty(0), counts)[-1])))
    (good, _), (bad, _) = _dictionary(blocks[1]), _dictionary(blocks[0])
    rest = _mapped(picked.where("half = 1"), raw := Model(good, bad, True, (0.0, 0.0)), {"d": T.DoubleType()},
                   lambda d: [pa.array(d)]).select("y", "d").collect()
    w = logistic(100 * np.array([[r["d"]] for r in rest]).reshape(-1, 1), np.array([r["y"] for r in rest]), counts)
    return Model(raw.good, raw.bad, True, (float(w[0]), float(w[1])))


def score(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The documents with their score (0 to 1) and predicted (1 from 0.5)."""
    w, b = model.weights

    def make(d: np.ndarray) -> list[pa.Array]:
        s = sigmoid(100 * d * w + b)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return _mapped(docs, model, {score: T.DoubleType(), predicted: T.IntegerType()}, make)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), MODULO) == HELD_OUT).alias("held_out"), "score", "predicted")
