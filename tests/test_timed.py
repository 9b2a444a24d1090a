"""Debounced checks from keyed state: timers, replace-all output, and a restart."""

import time

from quillspark.streaming import sessions, timed

SCHEMA = "uri string, version long, language_id string, op string, text string"


def test_a_pause_is_due_without_an_event_and_documents_outlive_a_restart(spark, tmp_path):
    base, got = f"file://{tmp_path}", []

    def put(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/events")

    def start():
        events = spark.readStream.schema(SCHEMA).parquet(f"{base}/events")
        with timed.rocksdb(spark):
            checks = timed.due_checks(events, 1000).writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
            return checks.foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect())).trigger(processingTime="300 milliseconds").start()

    def wait(n):
        stop = time.time() + 90
        while len(got) < n and time.time() < stop:
            time.sleep(0.2)
        assert len(got) >= n, got

    put(("a", 0, "Text", "open", "one"), ("b", 0, "Rust", "open", "two"), ("c", 5, None, "change", "never opened"))
    query = start()
    wait(3)
    put(("a", 1, None, "change", "one!"), ("a", 2, None, "change", "one!!"), ("b", 1, None, "close", None))
    wait(5)
    query.stop()
    assert sorted(r[1:] for r in got[:3]) == [("a", 0, "Text", "one", True, "open"), ("b", 0, "Rust", "two", True, "open"), ("c", 5, None, None, False, "close")]
    close, pause = got[3], got[4]
    assert close[1:] == ("b", 1, None, None, False, "close") and pause[1:] == ("a", 2, "Text", "one!!", True, "pause") and pause[0] > close[0]
    assert [tuple(r) for r in timed.open_documents(spark, f"{base}/checkpoint").collect()] == [("a", 2, "Text", "one!!")]
    put(("a", 2, None, "save", None), ("d", 0, "Go", "open", "new"))
    query = start()
    wait(7)
    put(("a", 3, None, "change", "three"))
    wait(8)
    query.stop()
    assert sorted(r[1:] for r in got[5:]) == [("a", 2, "Text", "one!!", True, "save"), ("a", 3, "Text", "three", True, "pause"), ("d", 0, "Go", "new", True, "open")]
    # What is open is what a fold of all events in a batch says.
    folded = sessions.current(spark.read.schema(SCHEMA).parquet(f"{base}/events").withColumnRenamed("version", "seq").selectExpr("*", "seq AS version"))
    assert {tuple(r) for r in timed.open_documents(spark, f"{base}/checkpoint").collect()} == {(r.uri, r.version, r.language_id, r.text) for r in folded.collect()}


def test_a_restarted_session_rechecks_what_was_open(spark, tmp_path):
    """A new driver finds the documents of the batch before; tables of older batches go."""
    rows = lambda *uris: spark.createDataFrame([(u, 1, "Text", f"text {u}", True, False) for u in uris], sessions.CURRENT)
    checked = []

    def published(changed):
        return sessions.Published(lambda d: d.select("uri", "version"), lambda docs, findings, batch: checked.append(sorted(r.uri for r in findings.collect())), lambda: changed, str(tmp_path))

    first = published(False)
    for batch, uris in enumerate((["a"], ["b"], ["c"])):
        first(rows(*uris), batch)
    published(True)(rows("d"), 3)
    assert checked == [["a"], ["b"], ["c"], ["a", "b", "c", "d"]]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["open-2", "open-3"]
