"""Fitted scorers on a file stream of the events table."""

from ledgerlens.session import scratch_path
from ledgerlens.sources.views import read_table
from ledgerlens.streaming.scoring import ZScoreStats, flag_outliers, write_batches

from .conftest import SF_SMALL


def test_stream_matches_batch(spark):
    batch = read_table(spark, SF_SMALL, "events")
    stats = ZScoreStats.fit(batch, "value")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    out = scratch_path(spark, "stream_out")
    q = write_batches(flag_outliers(stream, stats), out, scratch_path(spark, "stream_ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(out).where("is_outlier").count()
    want = flag_outliers(batch, stats).where("is_outlier").count()
    assert got == want == 16
