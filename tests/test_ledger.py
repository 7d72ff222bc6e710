import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voucherlens.streaming import ledger


def events(seed=3, n=60):
    r, out, at = random.Random(seed), [], dt.datetime(2024, 1, 1)
    for i in range(n):
        stem, job = f"s{i % 12}", f"j{i // 12}"
        at += dt.timedelta(minutes=1)
        kind = r.choice(["submitted", "submitted", "answered", "failed"]) if i >= 12 else "submitted"
        out.append((i, stem, "m", kind, job if kind != "failed" else None, 0.5 if kind == "answered" else None, "oops" if kind == "failed" and r.random() < 0.5 else None, at))
    return out


def folded(rows):
    entries = {}
    for e in sorted(rows, key=lambda e: (e[7], e[0])):
        event = dict(zip("event_id stem model kind job cost error ts".split(), e, strict=True))
        after = ledger.fold(entries.get(e[1]), event)
        entries[e[1]] = after or entries[e[1]]
    return {k: (v["status"], v["attempts"], v["job"], v["cost"], v["error"]) for k, v in entries.items()}


def test_stream_pays_no_row_twice(spark, tmp_path):
    rows = events()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    broken = {"left": 1}

    def run(part, fail=False):
        spark.createDataFrame(part, ledger.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = ledger.changes(spark.readStream.schema(ledger.EVENTS).option("maxFilesPerTrigger", 1).parquet(source))
        if fail:
            # the batch is written, then the process dies before the batch is committed
            def write(batch, number):
                batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
                if broken["left"]:
                    broken["left"] = 0
                    raise RuntimeError("killed")

            query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        else:
            query = ledger.keep(stream, target, checkpoint)
        try:
            query.awaitTermination(120)
        except Exception:
            assert fail

    run(rows[:20])
    run(rows[20:40] + rows[10:20], fail=True)
    run(rows[40:])
    entries = spark.read.parquet(target)
    got = {x.stem: (x.status, x.attempts, x.job, x.cost, x.error) for x in ledger.current(entries).collect()}
    want = folded(rows)
    assert {k: (v[0], v[1], v[3]) for k, v in got.items()} == {k: (v[0], v[1], v[3]) for k, v in want.items()}
    assert entries.where("status = 'done'").groupBy("stem").count().where("count > 1").count() == 0
    assert {x.stem for x in ledger.to_retry(entries, 9).collect()} == {k for k, v in want.items() if v[0] == "failed"}


def test_job_without_an_answer_is_lost(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    day = dt.datetime(2024, 1, 1)
    for i, part in enumerate([[(1, "a", "m", "submitted", "j", None, None, day)], [(2, "b", "m", "submitted", "j", None, None, day + dt.timedelta(days=5))], [(3, "c", "m", "submitted", "j", None, None, day + dt.timedelta(days=6))]]):
        spark.createDataFrame(part, ledger.EVENTS).coalesce(1).write.mode("append").parquet(source)
        ledger.keep(ledger.changes(spark.readStream.schema(ledger.EVENTS).option("maxFilesPerTrigger", 1).parquet(source), patience_s=3600), target, checkpoint).awaitTermination(120)
        assert i < 3
    got = {x.stem: (x.status, x.error) for x in ledger.current(spark.read.parquet(target)).collect()}
    assert got["a"] == ("failed", "no answer in time")


def test_settled_is_the_ledger_in_batch(spark):
    rows = events(5, 150)
    df = spark.createDataFrame(rows + rows[::3], ledger.EVENTS)
    got = {x.stem: (x.status, x.attempts, x.job, x.cost, x.error) for x in ledger.settled(df).collect()}
    assert got == folded(rows)
    assert ledger.settled(df.limit(0)).collect() == []


@pytest.mark.parametrize("force", [False, True])
def test_plan_resumes_saved_jobs(spark, force):
    images = spark.createDataFrame([(f"s{i}", 40 + i, i) for i in range(10)], "stem string, size long, pos int")
    done = spark.createDataFrame([("s0", "m"), ("s1", "other")], "stem string, model string")
    jobs = spark.createDataFrame([("j1", "m", "s2"), ("j1", "m", "s0"), ("j2", "m", "s3"), ("j2b", "m", "s3"), ("j3", "x", "s4"), ("j4", "m", "s0"), (None, "m", "s5"), ("", "m", "s6")], "job_name string, model string, stem string")
    work, others = ledger.plan(images, done, jobs, "m", 100, force)
    got = {x.stem: (x.job_name, x.chunk) for x in work.collect()}
    if force:
        assert set(got) == {f"s{i}" for i in range(10)} and all(x[0] is None for x in got.values()) and others.count() == 6
        return
    assert set(got) == {f"s{i}" for i in range(1, 10)} and got["s2"] == ("j1", None) and got["s3"] == ("j2", None)
    assert [got[f"s{i}"][1] for i in (1, 4, 5, 6, 7, 8, 9)] == [0, 0, 1, 1, 2, 2, 3]
    assert {(x.job_name, x.stem) for x in others.collect()} == {("j3", "s4"), ("j4", "s0")}
