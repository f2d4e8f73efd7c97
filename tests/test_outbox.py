"""All messages of a micro-batch are seen, or none, whichever write fails."""

import pytest
from conftest import SMALL, values

from runlens import constants as C
from runlens.schemas import FLAT_EVENT
from runlens.sinks import cache, outbox
from runlens.sinks import tables
from runlens.sinks.outbox import read_topic
from runlens.sources.events import guard_triggers
from runlens.sources.telemetry import gameplay_events
from runlens.streaming import jobs
from runlens.streaming import profile as P

TOPICS = (C.TRIGGERS_TOPIC, C.PARAMS_TOPIC, C.PREDICTIONS_TOPIC)


def test_nothing_is_seen_of_a_batch_that_failed(spark, tmp_path, monkeypatch):
    folder, topics, store = (str(tmp_path / name) for name in ("in", "topics", "cache"))
    gameplay_events(spark, SMALL).select(*FLAT_EVENT.fieldNames()).coalesce(1).write.parquet(folder)
    rules = P.Rules(kill_history=4, kill_min=2)

    def run():
        events = spark.readStream.schema(FLAT_EVENT).parquet(folder)
        query = jobs.start_profile(
            guard_triggers(events), store, str(tmp_path / "cp"), rules, event_time=True,
            delay="1 second", topic_format="parquet", topic_options={"path": topics},
            availableNow=True)
        try:
            query.awaitTermination(240)
        finally:
            query.stop()

    def seen():
        return [read_topic(spark, topics, topic).count() for topic in TOPICS]

    written = outbox.write_topic
    for last in range(4):  # fails at the first, second or third topic, or at the snapshots
        done = []

        def write(rows, topic, *rest, last=last, done=done, **options):
            if len(done) == last:
                raise OSError("no space")
            done.append(topic)
            written(rows, topic, *rest, **options)

        def upsert(*_):
            raise OSError("no space")

        with monkeypatch.context() as broken:
            broken.setattr(outbox, "write_topic", write)
            broken.setattr(tables, "upsert_latest", upsert)
            with pytest.raises(Exception, match="no space"):
                run()
        assert seen() == [0, 0, 0] and cache.pointer(spark, store) == (0, [])
        assert len(done) == min(last, 3)
    run()
    found = seen()
    assert all(found) and cache.read_features(spark, store).count() > 0
    run()  # nothing new: what was committed stays as it is
    assert seen() == found


def test_a_batch_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "value string")
    assert read_topic(spark, str(tmp_path), "t").count() == 0
    for batch in ("1", "1", "02"):
        outbox.commit(str(tmp_path), batch, {"t": rows, "u": rows.limit(0)})
    assert sorted(values(read_topic(spark, str(tmp_path), "t"), "value", "batch")) == [
        ("a", "02"), ("a", "1"), ("b", "02"), ("b", "1")]
    assert read_topic(spark, str(tmp_path), "u").count() == 0
