"""A stream of observations gives the events of the batch job."""

from nestrank import fixtures as FX
from nestrank.operators.changes import detect_changes
from nestrank.streaming.change_stream import ChangeLog, detect_changes_stream


def test_change_log_equals_batch(spark, tmp_path):
    obs = FX.observations(spark, "/root/testdata/sf0.001")
    order = FX.OBSERVATION_ORDER
    log = ChangeLog(spark, str(tmp_path / "log"), order)
    halves = (obs.filter("observed_at < TIMESTAMP '1998-01-01'"), obs.filter("observed_at >= TIMESTAMP '1998-01-01'"))
    for batch_id, batch in enumerate(halves):
        log(batch, batch_id)
    want = detect_changes(obs, order).select("listing_id", "event_type", "seq", "price")
    got = log.events().select("listing_id", "event_type", "seq", "price")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stateful_stream_equals_batch(spark, tmp_path):
    """Files read as a stream, two micro-batches, last snapshots kept as state."""
    obs = FX.observations(spark, "/root/testdata/sf0.001").filter("listing_id % 10 = 0")
    order, source = FX.OBSERVATION_ORDER, str(tmp_path / "in")
    cols = ["listing_id", "event_type", "seq", "price", "old_price", "new_text"]
    for cond in ("observed_at < TIMESTAMP '1998-01-01'", "observed_at >= TIMESTAMP '1998-01-01'"):
        obs.filter(cond).coalesce(1).write.mode("append").parquet(source)
        events = detect_changes_stream(spark.readStream.schema(obs.schema).parquet(source), order)
        run = events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True
        ).start(str(tmp_path / "out"))
        assert run.awaitTermination(180)
    want = detect_changes(obs, order).select(*cols)
    got = spark.read.parquet(str(tmp_path / "out")).select(*cols)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
