"""Claim totals by Structured Streaming: restart from the checkpoint after new files land."""

from pyspark.sql import functions as F

from ratebook.operators.aggregates import claims_by_policy
from ratebook.sources import files as FL
from ratebook.sources import standin as SI
from ratebook.streaming.claims import claims_stream, publish_available

from .conftest import SF_SMALL


def test_restart_picks_up_new_files_exactly_once(spark):
    snap = SI.claim_snapshot(spark, SF_SMALL)
    first, second = snap.filter(F.col("polnum") % 2 == 0), snap.filter(F.col("polnum") % 2 == 1)
    src, out, ckpt = (FL.scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    first.write.mode("append").parquet(src)
    publish_available(claims_stream(spark, src, snap.schema, "F"), out, ckpt)
    assert spark.read.parquet(out).count() == claims_by_policy(first, "F").count()
    second.write.mode("append").parquet(src)
    publish_available(claims_stream(spark, src, snap.schema, "F"), out, ckpt)  # resumes
    got = {r.polref: r.claim for r in spark.read.parquet(out).collect()}
    exp = {r.polref: r.claim for r in claims_by_policy(snap, "F").collect()}
    assert got == exp
