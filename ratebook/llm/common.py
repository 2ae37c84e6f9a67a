"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: characters of text that one numpy round handles at a time inside a task
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_tidy(df: DataFrame) -> DataFrame:
    """checkpoint() that removes the shuffle files of its job at its end, not when the driver happens to collect its garbage.

    Only for plans without joins: adaptive execution may leave a side of a join running whose shuffle would then be gone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return checkpoint(df.select("*"))  # a plan of its own, made under that setting
    finally:
        conf.set(key, before)


def freed(spark: SparkSession) -> None:
    """Has the driver drop what no table refers to, so that Spark's cleaner removes the files of those shuffles and checkpoints now.

    One collection leaves tables whose owners are only cleared after it.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def by_size(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only for a side whose counted rows are within the limit."""
    return F.broadcast(small) if rows <= limit else small


def text_key(col: Column) -> Column:
    """128 bits that stand for a text; equal texts have equal keys."""
    return F.md5(F.coalesce(col, F.lit("")).cast("binary"))


def shielded(df: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(the rows with all but the needed columns under names that no operator uses, what gives them their names back).

    A column that the operator has made itself replaces one of the same name;
    the others come back in their old order, new ones behind them.
    """
    stem = "__user_"
    while any(c.startswith(stem) for c in df.columns):
        stem += "_"
    hidden = {c: f"{stem}{i}" for i, c in enumerate(df.columns) if c not in needed}

    def back(out: DataFrame) -> DataFrame:
        new = [c for c in out.columns if c not in hidden.values() and c not in df.columns]
        names = {c: hidden[c] if c in hidden and c not in out.columns else c for c in df.columns}
        return out.select(*(F.col(names[c]).alias(c) for c in df.columns if names[c] in out.columns), *new)

    return df.select(*(F.col(f"`{c}`").alias(hidden.get(c, c)) for c in df.columns)), back


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as no column of the table has."""
    while name in df.columns:
        name += "_"
    return name


def shipped(df: DataFrame, kept: Sequence[str], text: str) -> tuple[DataFrame, int]:
    """(the kept columns and the text, the place of the text): a text that is kept goes to the Python workers once."""
    if text in kept:
        return df.select(*kept), list(kept).index(text)
    return df.select(*kept, df[text].alias(free_name(df, "_text"))), len(kept)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow, which at its end gives freed memory back to the system: reused workers would keep it for later stages."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return whole


def chunks(batch: pa.RecordBatch, column: str | int, chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about so many characters of text each (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > chars:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)


__all__ = ["CHUNK_CHARS", "by_size", "checkpoint", "checkpoint_tidy", "chunks", "free_name", "freed", "lean", "shielded", "shipped", "table", "text_key"]
