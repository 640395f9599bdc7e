"""Streams of file events: per-path debounce with a deadline that each event replaces, and the late guard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SETTLE_MS, DEBOUNCE_MS, REMOVE_MS = 2000, 3000, 3000

# Folders whose events are left out, beside hidden ones.
IGNORED = ("node_modules", "attachments")
OUT = "path string, kind string, fired_ms long"


def wanted(events: DataFrame) -> DataFrame:
    """Events of notes outside the ignored folders."""
    return events.where(F.col("path").endswith(".md") & ~F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(*IGNORED)))


def delay(kind: str) -> int:
    """How long after an event it takes effect."""
    return REMOVE_MS if kind == "removed" else SETTLE_MS + DEBOUNCE_MS


def classified(kind: str) -> str:
    """I3."""
    return {"removed": "unlink", "created": "add"}.get(kind, "change")


class Debounce(StatefulProcessor):
    """Keeps per path the last event; every event replaces the deadline, so a removal may bring it forward."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "kind string, ts_ms long, due_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, at, due = self.last.get() if self.last.exists() else (None, -1, None)
        out = []
        # a trigger's events of one path may come in several batches; they are short and are put in order together
        new = pd.concat(list(rows), ignore_index=True)
        for e in new[new.ts_ms >= at].sort_values("ts_ms", kind="stable").itertuples():
            if due is not None and e.ts_ms >= due:
                out.append((key[0], classified(kind), due))
            kind, at = e.kind, e.ts_ms
            due = at + delay(kind)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if kind is not None:
            self.last.update((kind, at, due))
            self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=["path", "kind", "fired_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind, _, due = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], classified(kind), due)], columns=["path", "kind", "fired_ms"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """The stream of effects of ``events(path, kind, ts)``; needs the RocksDB state store."""
    rows = wanted(events).withWatermark("ts", late).withColumn("ts_ms", F.unix_millis("ts"))
    return rows.select("path", "kind", "ts", "ts_ms").groupBy("path").transformWithStateInPandas(Debounce(), OUT, "append", "eventtime")


def debounced_batch(events: DataFrame) -> DataFrame:
    """The same effects of a finished set of events: an event takes effect unless another comes before its deadline."""
    w = Window.partitionBy("path").orderBy("ts_ms", "seq")
    due = F.col("ts_ms") + F.when(F.col("kind") == "removed", REMOVE_MS).otherwise(SETTLE_MS + DEBOUNCE_MS)
    rows = wanted(events).withColumn("due", due).withColumn("next", F.lead("ts_ms").over(w))
    kind = F.when(F.col("kind") == "removed", "unlink").when(F.col("kind") == "created", "add").otherwise("change")
    return rows.where(F.col("next").isNull() | (F.col("next") >= F.col("due"))).select("path", kind.alias("kind"), F.col("due").alias("fired_ms"))


def newest(events: DataFrame) -> DataFrame:
    """I4: per path the version with the greatest time; late and repeated ones drop out.  In a stream a running aggregate."""
    return events.groupBy("path").agg(F.max("mtime").alias("mtime"))


def run(effects: DataFrame, apply, checkpoint: str):
    """A single query that applies each batch of effects in order; a batch is applied again after a failure, so ``apply`` is an upsert."""
    return effects.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
