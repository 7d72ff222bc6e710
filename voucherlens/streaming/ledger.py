"""The ledger of paid work: what was submitted, answered, failed or lost, kept as state by key and resumable at any point.

Events are (event_id, stem, model, kind, job, cost, error, ts), kind being submitted, answered or failed. Whatever is
delivered again changes nothing: an answer is paid for once, and after it a key takes no more events.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from voucherlens.operators import chunks, lookups

EVENTS = "event_id long, stem string, model string, kind string, job string, cost double, error string, ts timestamp"
ENTRY = "stem string, model string, version long, status string, attempts long, job string, cost double, error string"
_STATE = "version long, status string, attempts long, job string, cost double, error string, seen array<long>, due long"
MOST_BYTES = 1900 * 1024 * 1024


def plan(images: DataFrame, done: DataFrame, jobs: DataFrame, model: str, budget: int, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(work, others) for one run of a model.

    `images`: (stem, size, pos); `done`: (stem, model); `jobs`: saved (job_name, model, stem) rows, one an image.
    work: (stem, job_name, chunk): images without a result, by the saved job that holds them already, else (job_name null)
    by new chunks of `budget` bytes, 1900 MB at most, in the images' order. others: saved rows to keep untouched. `force`
    takes every image and resumes nothing.
    """
    open_ = lookups.pending(images, done, model, force)
    named = jobs.where("job_name is not null and job_name <> ''")
    mine = named.where(F.col("model") == model).join(open_.select("stem"), "stem", "left_semi") if not force else named.limit(0)
    resumed = mine.groupBy("stem").agg(F.min("job_name").alias("job_name"))  # an image that two jobs hold is resumed once
    others = named.join(mine.select("job_name", "model").distinct(), ["job_name", "model"], "left_anti")
    new = chunks.byte_chunks(open_.join(resumed.select("stem"), "stem", "left_anti"), min(budget, MOST_BYTES), "size", ("pos", "stem"))
    work = resumed.select("stem", "job_name", F.lit(None).cast("long").alias("chunk"))
    return work.unionByName(new.select("stem", F.lit(None).cast("string").alias("job_name"), "chunk")), others


def fold(entry: dict | None, event: dict) -> dict | None:
    """The entry after an event, or None where the event changes nothing: it was seen, or the work is done."""
    now = entry or {"version": 0, "status": "new", "attempts": 0, "job": None, "cost": 0.0, "error": None, "seen": []}
    if now["status"] == "done" or event["event_id"] in now["seen"]:
        return None
    now = now | {"version": now["version"] + 1, "seen": [*now["seen"], event["event_id"]]}
    if event["kind"] == "submitted":
        again = event["job"] == now["job"] and now["status"] == "submitted"
        return now | {"status": "submitted", "attempts": now["attempts"] + (not again), "job": event["job"], "error": None}
    if event["kind"] == "answered":
        return now | {"status": "done", "job": event["job"] or now["job"], "cost": event["cost"] or 0.0, "error": None}
    return now | {"status": "failed", "error": event["error"] or "failed"}


class LedgerProcessor(StatefulProcessor):
    """State by (stem, model): `fold` over a key's events in the order of their time, and a timer for jobs that nobody answers.

    The events a key has seen are kept until it is done, a few for each attempt.
    """

    def __init__(self, patience_s: int = 86_400):
        self.patience_s = patience_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", _STATE)

    def _read(self) -> dict | None:
        names = [x.split()[0] for x in _STATE.split(", ")]
        found = dict(zip(names, self.entry.get(), strict=True)) if self.entry.exists() else None
        return found and found | {"seen": list(found["seen"] or [])}

    def _write(self, entry: dict) -> None:
        self.entry.update(tuple(entry.get(x.split()[0]) for x in _STATE.split(", ")))

    def _row(self, key: tuple, entry: dict) -> Row:
        return Row(**{"stem": key[0], "model": key[1]} | {c: entry[c] for c in ("version", "status", "attempts", "job", "cost", "error")})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        entry, changed = self._read(), False
        for event in sorted((r.asDict() for r in rows), key=lambda e: (e["ts"], e["event_id"])):
            if (after := fold(entry, event)) is None:
                continue
            entry, changed = after, True
            if entry["status"] == "submitted":
                entry["due"] = int(event["ts"].replace(tzinfo=event["ts"].tzinfo or dt.UTC).timestamp() * 1000) + 1000 * self.patience_s
        if not changed:
            return
        if entry["status"] == "submitted":
            self.handle.registerTimer(entry["due"])
        if entry["status"] == "done":
            entry["seen"] = []
        self._write(entry)
        yield self._row(key, entry)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        entry = self._read()
        if entry and entry["status"] == "submitted" and expiredTimerInfo.getExpiryTimeInMs() >= entry["due"]:
            entry |= {"version": entry["version"] + 1, "status": "failed", "error": "no answer in time"}
            self._write(entry)
            yield self._row(key, entry)

    def close(self) -> None:
        pass


def changes(events: DataFrame, patience_s: int = 86_400, watermark: str = "1 hour") -> DataFrame:
    """A stream of ledger entries as they change. Needs the RocksDB state store; late events within the watermark count."""
    keyed = events.withWatermark("ts", watermark).groupBy("stem", "model")
    return keyed.transformWithState(LedgerProcessor(patience_s), ENTRY, "Update", "EventTime")


def keep(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes entries to a folder for each batch, overwritten if the batch is run again; resumes where the checkpoint stands."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def current(entries: DataFrame) -> DataFrame:
    """The last version of each key's entry."""
    rest = ["status", "attempts", "job", "cost", "error"]
    return entries.groupBy("stem", "model").agg(F.max_by(F.struct("version", *rest), "version").alias("x")).select("stem", "model", "x.*")


def to_retry(entries: DataFrame, most: int = 3) -> DataFrame:
    """(stem, model) of failed work with attempts left: what a re-run takes up, and nothing else."""
    return current(entries).where((F.col("status") == "failed") & (F.col("attempts") < most)).select("stem", "model")


def settled(events: DataFrame) -> DataFrame:
    """The batch form of the ledger: what `current` holds once all events have come, in order and without waiting.

    Of events delivered several times one counts. Up to a key's first answer its events are folded by partial
    aggregates, so a key's events are nowhere collected.
    """
    once = events.dropDuplicates(["stem", "model", "event_id"])
    key, at = ["stem", "model"], F.struct("ts", "event_id")
    paid = once.where("kind = 'answered'").groupBy(*key).agg(F.min(F.struct("ts", "event_id", "job", "cost")).alias("paid"))
    before = once.join(paid, key, "left").where(F.col("paid").isNull() | (at < F.struct("paid.ts", "paid.event_id")) | (F.col("event_id") == F.col("paid.event_id")))
    out = before.groupBy(*key).agg(
        F.max("paid").alias("paid"), F.count_distinct(F.when(F.col("kind") == "submitted", F.col("job"))).alias("attempts"), F.max_by("kind", at).alias("last"),
        F.max_by(F.when(F.col("kind") == "submitted", F.col("job")), F.when(F.col("kind") == "submitted", at)).alias("job"),
        F.max_by(F.coalesce("error", F.lit("failed")), F.when(F.col("kind") == "failed", at)).alias("error"),
    )
    done = F.col("paid").isNotNull()
    status = F.when(done, "done").otherwise(F.col("last"))
    return out.select(*key, status.alias("status"), "attempts", F.when(done, F.coalesce("paid.job", "job")).otherwise(F.col("job")).alias("job"), F.when(done, F.coalesce("paid.cost", F.lit(0.0))).otherwise(0.0).alias("cost"), F.when(status == "failed", F.col("error")).alias("error"))
