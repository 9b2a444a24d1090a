"""Versioned documents of editor sessions, batch and streaming.

Events are (uri, version, language_id, op, text) with op open, change, save or close. An open starts a
document, a change or save has effect only while it is open (a save keeps the version), a close ends it.
State is keyed by uri. Findings are published for a version only if it is still current; a closed
document's findings are replaced by none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CURRENT = "uri string, version long, language_id string, text string, open boolean, saved boolean"
STATE = "version long, language_id string, text string, open boolean"


def due(events: DataFrame, while_typing: bool = True) -> DataFrame:
    """Events that call for a check: every save, and opens and changes if typing is checked."""
    return events.where(F.col("op").isin("open", "change", "save") if while_typing else F.col("op") == "save")


def last_change(events: DataFrame) -> DataFrame:
    """Of a batch's events of a document, what the last says; each has the whole text."""
    return events.groupBy("uri").agg(F.max_by(F.struct("version", "language_id", "op", "text"), F.col("version")).alias("e")).select("uri", "e.*")


def current(events: DataFrame, order: str = "seq") -> DataFrame:
    """The state after all events, in a batch: what counts follows the last open, if nothing closed it."""
    before = Window.partitionBy("uri").orderBy(order)
    numbered = events.withColumn("_opens", F.sum(F.when(F.col("op") == "open", 1).otherwise(0)).over(before))
    last = numbered.withColumn("_last", F.max("_opens").over(Window.partitionBy("uri"))).where("_opens = _last AND _opens > 0")
    folded = last.groupBy("uri").agg(
        F.min(F.when(F.col("op") == "close", F.col(order))).alias("closed"), F.max_by("version", F.when(F.col("op") != "save", F.col(order))).alias("version"),
        F.max_by("language_id", F.when(F.col("op") == "open", F.col(order))).alias("language_id"), F.max_by("text", F.when(F.col("text").isNotNull(), F.col(order))).alias("text"),
    )
    return folded.where("closed IS NULL").drop("closed")


def step(state: tuple | None, rows: list[dict[str, Any]]) -> tuple | None:
    """The state after some events; None once closed."""
    for e in rows:
        if e["op"] == "open":
            state = (e["version"], e["language_id"], e["text"], True)
        elif e["op"] == "close":
            state = None
        elif state is not None and e["op"] == "change":
            state = (e["version"], state[1], e["text"], True)
        elif state is not None and e["op"] == "save" and e["text"] is not None:
            state = (state[0], state[1], e["text"], True)
    return state


def tracked(events: DataFrame, order: str = "version") -> DataFrame:
    """A stream of events -> a stream of documents as they are after each micro-batch; closed ones with open = false.

    `saved` says whether the batch had a save.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows = rows.astype(object).where(rows.notna(), None).to_dict("records")
        now = step(state.get if state.exists else None, rows)
        if now is None:
            if state.exists:
                state.remove()
            yield pd.DataFrame([{"uri": key[0], "version": rows[-1]["version"], "language_id": None, "text": None, "open": False, "saved": False}])
        else:
            state.update(now)
            yield pd.DataFrame([{"uri": key[0], "version": now[0], "language_id": now[1], "text": now[2], "open": True, "saved": any(e["op"] == "save" for e in rows)}])

    return events.groupBy("uri").applyInPandasWithState(run, CURRENT, STATE, "update", GroupStateTimeout.NoTimeout)


def still_current(results: DataFrame, now: DataFrame) -> DataFrame:
    """Results (uri, version, ...) whose document is open and at that version."""
    return results.join(now.select("uri", "version"), ["uri", "version"], "left_semi")


class Published:
    """What is published, by uri: each batch replaces all of a document's findings, an empty set included.

    `check` makes findings (uri, version, ...) from open documents. Without `typing`, only saves call for a check. `reload`
    runs before each batch, so changed settings and lexicons take effect. With a `folder`, all open documents are kept there
    as a table for each batch, and if `reload` says that something changed, every one of them is checked
    again: so what was published empty before any lexicon was there is published anew once one arrives. After a restart the
    table of the batch before is found there; older ones go. Findings of versions that are no longer current are dropped.
    """

    def __init__(self, check: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, DataFrame, int], None], reload: Callable[[], bool] | None = None, folder: str | None = None, typing: bool = True):
        self.check, self.sink, self.reload, self.folder, self.typing = check, sink, reload, folder, typing
        self.last: DataFrame | None = None

    def __call__(self, docs: DataFrame, batch: int) -> None:
        changed = bool(self.reload and self.reload())
        docs = docs.persist()
        try:
            now = self._open(docs, batch) if self.folder else docs.where("open").drop("saved")
            due = docs.where("NOT open OR saved") if not self.typing else docs
            if changed and self.folder:
                due = due.where("NOT open").drop("saved").unionByName(now)
            findings = still_current(self.check(due.where("open").select("uri", "version", "language_id", "text")), now)
            self.sink(due.select("uri", "version", "open"), findings, batch)
        finally:
            docs.unpersist()

    def _open(self, docs: DataFrame, batch: int) -> DataFrame:
        now = docs.where("open").drop("saved")
        spark = docs.sparkSession
        jvm = spark.sparkContext._jvm
        before, older = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/open-{batch - k}") for k in (1, 2))
        store = before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.last is None and store.exists(before):
            self.last = spark.read.schema(now.schema).parquet(str(before))
        if self.last is not None:
            now = now.unionByName(self.last.join(docs.select("uri"), "uri", "left_anti").select(*now.columns))
        path = f"{self.folder}/open-{batch}"
        now.write.mode("overwrite").parquet(path)
        self.last = spark.read.schema(now.schema).parquet(path)
        store.delete(older, True)
        return self.last


def start(events: DataFrame, published: Published, checkpoint: str, trigger: dict[str, Any] | None = None):
    """Run a session stream; the trigger's interval is also how often settings are looked at."""
    return tracked(events).writeStream.outputMode("update").foreachBatch(published).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
