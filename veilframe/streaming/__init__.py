"""Streams: rewriting as a stateless map, and the log as state for each slot."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilframe.functions.scalars import path_key
from veilframe.operators.dictionary import Dictionary
from veilframe.operators.policy import with_policy
from veilframe.operators.redaction import redact, redact_json

PASS = "agent string, slot string, mode string, label string, kind string, seq long, at timestamp, folded array<string>, replaced array<long>, dropped array<long>"
ENTRY = "agent string, slot string, mode string, label string, kind string, seq long, at timestamp, folded string, replaced long, dropped long, is_new boolean"


def rewrite_stream(spark: SparkSession, events: DataFrame, d: Dictionary) -> DataFrame:
    """Events (event_type, payload, ...) with their policy and rewritten payloads; the same for a batch."""
    rows = with_policy(events)
    plain, lines = redact(spark, d, "payload", allow_drop=False), redact_json(spark, d, "payload")
    done = rows.where("not allow_drop").withColumn("result", plain).unionByName(rows.where("allow_drop").withColumn("result", lines))
    return done.drop("payload").select("*", "result.*").drop("result")


class _Log(StatefulProcessor):
    """One slot: an add pass is summed, a replacing pass takes the old one's place, an empty replacing pass clears the slot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.terms = handle.getMapState("terms", "folded string", "replaced long, dropped long")
        self.first = handle.getValueState("first", "at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passes = pd.concat(list(rows)).sort_values("seq")
        for _, p in passes.iterrows():
            had = self.first.exists()
            if p["mode"] != "add" and had:
                self.terms.clear()
            if not len(p["folded"]):
                if p["mode"] != "add" and had:
                    self.first.clear()
                continue
            for k, r, n in zip(p["folded"], p["replaced"], p["dropped"]):
                old = self.terms.getValue((k,)) if self.terms.containsKey((k,)) else (0, 0)
                self.terms.updateValue((k,), (old[0] + int(r), old[1] + int(n)))
            is_new = p["mode"] == "add" or not had
            if is_new:
                self.first.update((p["at"].to_pydatetime(),))
            out = [(*key, p["mode"], p["label"], p["kind"], int(p["seq"]), self.first.get()[0], k[0], v[0], v[1], is_new) for k, v in self.terms.iterator()]
            yield pd.DataFrame(out, columns=["agent", "slot", "mode", "label", "kind", "seq", "at", "folded", "replaced", "dropped", "is_new"])

    def close(self) -> None:
        pass


def log_stream(passes: DataFrame) -> DataFrame:
    """The log's entries as they change, from passes of the schema PASS: state is one slot's terms, spread over the slots.

    Needs the RocksDB state store. is_new marks what goes to the feed; a repeated replacing pass keeps its time.
    """
    return passes.groupBy("agent", "slot").transformWithStateInPandas(statefulProcessor=_Log(), outputStructType=ENTRY, outputMode="update", timeMode="none")


class _Last(StatefulProcessor):
    """One key: a flag that the last row which says something sets; a row out whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "flag boolean, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for _, r in pd.concat(list(rows)).sort_values("seq").iterrows():
            was, seq = self.held.get() if self.held.exists() else (False, -(2**63))
            if r["seq"] < seq:
                continue
            self.held.update((bool(r["flag"]), int(r["seq"])))
            if bool(r["flag"]) != was:
                yield pd.DataFrame([(*key, bool(r["flag"]), int(r["seq"]))], columns=["key", "flag", "seq"])

    def close(self) -> None:
        pass


def _last_flags(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Last(), outputStructType="key string, flag boolean, seq long", outputMode="update", timeMode="none")


def taint_stream(reads: DataFrame) -> DataFrame:
    """(path_key, hidden, seq) whenever a file becomes tainted or is released; state is one flag a file, by path_key.

    reads: path, seq, hidden, whole. A read that hides something taints; a whole read that hides nothing releases; others change nothing.
    """
    rows = reads.where("hidden or whole").select(path_key(F.col("path")).alias("key"), F.col("hidden").alias("flag"), "seq")
    return _last_flags(rows).toDF("path_key", "hidden", "seq")


def pause_stream(controls: DataFrame) -> DataFrame:
    """(session, paused, seq) whenever a session is paused or goes on; only a user pauses and resumes, an end resumes.

    controls: session, seq, command, origin.
    """
    may = controls.where("command in ('pause', 'resume', 'end') and (command = 'end' or origin = 'user')")
    return _last_flags(may.select(F.col("session").cast("string").alias("key"), (F.col("command") == "pause").alias("flag"), "seq")).toDF("session", "paused", "seq")


def latest_entries(changes: DataFrame) -> DataFrame:
    """The current log from log_stream's output: of each slot the rows of its last pass."""
    last = changes.withColumn("top", F.max("seq").over(Window.partitionBy("agent", "slot")))
    return last.where("seq = top").drop("top")


def reloading(load, run, *, stamp=lambda: None, clock=time.monotonic, recheck: float = 1.0):
    """A foreachBatch function that loads the small configuration anew when its stamp (path, time, size) has changed.

    The stamp is looked at no oftener than every `recheck` seconds. A configuration that cannot be loaded leaves the last good one in
    force; without one, the batch fails and nothing passes.
    """
    held: dict = {}

    def each(batch: DataFrame, batch_id: int) -> None:
        if "value" not in held or clock() - held["at"] >= recheck:
            held["at"], now = clock(), stamp()
            if "value" not in held or now is None or now != held["stamp"]:
                try:
                    held["value"], held["stamp"] = load(), now
                except Exception:
                    if "value" not in held:
                        raise
        run(batch, batch_id, held["value"])

    return each


def windowed_events(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", by: Column | str = "event_type") -> DataFrame:
    """Counts and sums of values by window and kind, with a watermark for late events."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), F.col(by) if isinstance(by, str) else by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
