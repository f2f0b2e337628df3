from millrace.sources import table
from millrace.streaming import events as st


def test_stream_equals_batch(spark, data):
    stream = st.replay(spark, data, st.once, "t_once").select("job_event_id", "job_id", "event_type")
    batch = table(spark, data, "job_events", "job_event_id", "job_id", "event_type").distinct()
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_invalid_payloads_are_set_apart(spark):
    rows = [(1, '{"a": 1}'), (2, '{"a"'), (3, None)]
    valid, invalid = st.routed(spark.createDataFrame(rows, "job_event_id bigint, payload string"))
    assert [r[0] for r in valid.collect()] == [1] and sorted(r[0] for r in invalid.select("job_event_id").collect()) == [2, 3]
