"""Checks that wait for a pause in typing, from keyed state with timers.

Events are those of `sessions`. Each open document is a value in the state store, keyed by uri, so it outlives the
driver and the executors. An open or a save is due for a check at once; a change sets a timer, and the next change sets it
anew, so a check is due once nobody has typed for `pause` milliseconds, whether or not another event comes. A close is
passed on, and takes the document and its timer away.

`open_documents` reads the documents that are open from a checkpoint, for a recheck of all of them when settings or
lexicons change, also after a restart. State is as large as the open documents, dealt out by uri; a batch touches
those with events or with a timer that is over.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sessions import step

DUE = "uri string, version long, language_id string, text string, open boolean, reason string"
DOCUMENT = "version long, language_id string, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounced(StatefulProcessor):
    """Documents by uri; emits (uri, version, language_id, text, open, reason) where a check is due."""

    def __init__(self, pause: int, order: str = "version"):
        self.pause, self.order = pause, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", DOCUMENT)

    def _row(self, key: tuple, state: tuple | None, version: int | None, reason: str) -> pd.DataFrame:
        own = (*state[:3], True) if state else (version, None, None, False)
        return pd.DataFrame([(key[0], *own, reason)], columns=["uri", "version", "language_id", "text", "open", "reason"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        events = events.astype(object).where(events.notna(), None).to_dict("records")
        held = self.document.get() if self.document.exists() else None
        now = step((*held, True) if held else None, events)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is None:
            if held:
                self.document.clear()
            yield self._row(key, None, events[-1]["version"], "close")
            return
        self.document.update(now[:3])
        last = events[-1]["op"]
        if last == "change":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.pause)
        else:
            yield self._row(key, now, None, last)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.document.exists():
            yield self._row(key, self.document.get(), None, "pause")

    def close(self) -> None:
        pass


def due_checks(events: DataFrame, pause: int = 500, order: str = "version") -> DataFrame:
    """A stream of events -> a stream of documents that are due for a check, or closed. The session's state store must be RocksDB (`rocksdb`)."""
    return events.groupBy("uri").transformWithStateInPandas(Debounced(pause, order), DUE, "append", "processingTime")


@contextlib.contextmanager
def rocksdb(spark: SparkSession, idle: bool = True):
    """Streams that start inside keep their state in RocksDB, which values and timers need.

    Without `idle` batches, timers fire only when events come, and a stream that takes what is available ends.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def open_documents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(uri, version, language_id, text) of the documents that were open after the last whole batch of a checkpoint."""
    with rocksdb(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "document").load()
    return state.select(F.col("key.uri").alias("uri"), "value.*")
