import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bibspark.streaming import intake


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_intake(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.ris").write_bytes(b"TY  - BOOK\nER  - \n")
    (src / "b.ris").write_bytes(b"\xff\xfe\x00")
    (src / "c.bin").write_bytes(b"x")
    (src / "d.xml").write_bytes(b"<!DOCTYPE x><mods/>")
    q = intake.intake_stream(spark, str(src), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.name for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["a.ris"]
    assert {r.name: r.block for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"b.ris": "UTF8_INVALID", "c.bin": "FORMAT_UNSUPPORTED", "d.xml": "XML_HOSTILE"}


def test_ledger_stream(spark, tmp_path):
    rows = [("a", 1, "GENESIS", "h1"), ("a", 2, "h1", "h2"), ("a", 3, "x", "h3"), ("b", 1, "GENESIS", "k1"), ("b", 3, "k1", "k3")]
    spark.createDataFrame(rows, "ledger_id string, sequence long, previous_hash string, hash string").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ledger_id string, sequence long, previous_hash string, hash string").parquet(str(tmp_path / "e"))
    run(intake.verify_ledger_stream(events), "verdicts", "append")
    got = {(r.ledger_id, r.sequence, r.problem) for r in spark.table("verdicts").collect()}
    assert got == {("a", 3, "link"), ("b", 3, "gap")}


def _ledger(name, n, seed=1):
    """A sound ledger of n events, a minute apart."""
    marks = ["GENESIS", *(f"{name}{i}" for i in range(1, n + 1))]
    return [(name, i, marks[i - 1], marks[i], datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(1, n + 1)]


EVENT = "ledger_id string, sequence long, previous_hash string, hash string, at timestamp"


def _stream(spark, path, parts):
    """A micro-batch for each list of events, in order."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{path}/{i}")
    for i, f in enumerate(sorted(Path(path).glob("*/*.parquet"), key=lambda f: int(f.parent.name))):
        os.utime(f, (1e9 + i, 1e9 + i))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_ledger_out_of_order(spark, tmp_path):
    """Events shuffled over three micro-batches give no false gap; true gaps and repeats are found, each once."""
    rnd = random.Random(3)
    events = [*_ledger("a", 400), *_ledger("b", 50)]
    gone = {("a", 37), ("a", 38), ("a", 200), ("b", 1)}
    kept = [e for e in events if e[:2] not in gone]
    kept = [(*e[:2], "wrong", *e[3:]) if e[:2] == ("a", 300) else e for e in kept]
    rnd.shuffle(kept)
    third = len(kept) // 3
    again = [e for e in kept[:third] if e[1] % 50 == 3]
    parts = [kept[:third], kept[third : 2 * third] + again, kept[2 * third :], [("clock", 1, "GENESIS", "c", datetime(2030, 1, 1))]]
    run(intake.verify_ledger_stream(_stream(spark, tmp_path / "in", parts), at="at", delay="2 days"), "unordered")
    got = sorted((r.ledger_id, r.sequence, r.problem) for r in spark.table("unordered").collect())
    assert got == sorted([("a", 39, "gap"), ("a", 201, "gap"), ("a", 300, "link"), ("b", 2, "gap"), *((*e[:2], "repeat") for e in again)])


def test_ledger_gap_closes_late(spark, tmp_path):
    """A gap that the watermark has not passed is not reported; what fills it later is verified."""
    a = _ledger("a", 9)
    run(intake.verify_ledger_stream(_stream(spark, tmp_path / "in", [a[:2] + a[4:], a[2:4]]), at="at", delay="1 day"), "closed")
    assert spark.table("closed").count() == 0
    clock = [("clock", i, "GENESIS" if i == 1 else "c1", f"c{i}", datetime(2030, 1, i)) for i in (1, 2)]
    run(intake.verify_ledger_stream(_stream(spark, tmp_path / "in2", [a[:2] + a[4:], clock[:1], clock[1:], a[2:4]]), at="at", delay="1 day"), "late")
    assert sorted((r.sequence, r.problem) for r in spark.table("late").collect()) == [(5, "gap")]  # what comes behind the watermark is dropped


def test_windows_and_repeats(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "error", "A", "d1"), ("2024-01-01 00:10:00", "error", "A", "d1"), ("2024-01-01 01:10:00", "notice", "B", "d2"), ("2024-01-01 09:00:00", "notice", "B", "d3")]
    spark.createDataFrame(rows, "ts string, severity string, code string, sha256 string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "f"))
    s = lambda: spark.readStream.schema("ts timestamp, severity string, code string, sha256 string").parquet(str(tmp_path / "f"))
    run(intake.findings_per_window(s()), "windows")
    assert {(str(r.start), r.code, r.findings) for r in spark.table("windows").collect()} >= {("2024-01-01 00:00:00", "A", 2), ("2024-01-01 01:00:00", "B", 1)}
    run(intake.without_repeats(s(), at="ts"), "once")
    assert spark.table("once").count() == 3


@pytest.mark.parametrize("key", ["a", "b"])
def test_conflicts(spark, tmp_path, key):
    spark.createDataFrame([("a",), ("b",)], "id string").write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema("id string").parquet(str(tmp_path / "r"))
    ok, conflicts = intake.new_records(s, spark.createDataFrame([(key,)], "id string"))
    run(ok, f"ok_{key}")
    run(conflicts, f"conflict_{key}")
    assert [r.id for r in spark.table(f"conflict_{key}").collect()] == [key]
    assert spark.table(f"ok_{key}").count() == 1


def test_ledgers_over_many_days(spark, tmp_path):
    """Ledgers of more days than a watermark's usual delay, in any order: no event is late. A micro-batch is several files."""
    import duckdb

    from bibspark import registry

    duck = duckdb.connect()
    duck.execute(f"copy (select * replace (event_id * 1013 as event_id) from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, registry.QUERIES["stream_ledger_order"](spark, str(tmp_path)).select("ledger_id", "sequence", "problem").collect()))
    assert got == sorted(duck.execute(f"select ledger_id, sequence, problem from ({registry.ORACLES['stream_ledger_order']})").fetchall())


class _Store:
    """A state variable that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return {
                "exists": lambda: None in self.rows, "get": lambda: self.rows.get(None), "update": lambda v: self.rows.__setitem__(None, v), "containsKey": lambda k: k in self.rows, "getValue": lambda k: self.rows.get(k),
                "updateValue": lambda k, v: self.rows.__setitem__(k, v), "removeKey": lambda k: self.rows.pop(k), "keys": lambda: iter(list(self.rows)),
            }[name](*args)

        return call


def test_early_events_cost_few_calls(monkeypatch):
    """Events that wait cost a call to the state store a block, not some each; blocks beyond those in memory come back from the store."""
    import types

    import pandas as pd

    rnd, calls = random.Random(5), []
    last, early, timers = _Store(calls), _Store(calls), []
    handle = types.SimpleNamespace(getValueState=lambda *a: last, getMapState=lambda *a: early, registerTimer=lambda ms: timers.append(ms))
    clock = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    v = intake.LedgerVerifier(True)
    v.init(handle)
    n, gone = 20_000, {1, 700, 5000, 5001, 19_999}
    events = [("a", i, f"h{i - 1}" if i > 1 else "GENESIS", f"h{i}", f"h{i}" if i != 9000 else "x", 10 * i) for i in range(1, n + 1) if i not in gone]
    rnd.shuffle(events)
    third = len(events) // 3
    again = events[:5]
    others = [(f"b{k}", i, "x" if i > 1 else "GENESIS", "x", "x", i) for k in range(500) for i in (2, 1)]  # ledgers of the same bucket
    found = []
    for part in (others + events[:third], [*events[third : 2 * third], *again], events[2 * third :]):
        f = pd.DataFrame(part, columns=["ledger_id", "sequence", "previous_hash", "hash", "content", "ms"])
        for x in v.handleInputRows((7,), iter([f.iloc[:3000], f.iloc[3000:]]), clock(0)):
            found += x.itertuples(index=False, name=None)
    assert len(calls) < 2000, len(calls)
    for now in (6990, 60_000, 10**9):
        for x in v.handleExpiredTimer((7,), clock(now), None):
            found += x.itertuples(index=False, name=None)
    assert len(calls) < 3000 and not early.rows and dict(zip(*last.rows[None][:2])) == {"a": n} | {f"b{k}": 2 for k in range(500)} and not any(last.rows[None][3])
    assert sorted(found) == sorted([*(("a", e[1], "repeat") for e in again), *(("a", s, "gap") for s in (2, 701, 5002, 20_000)), ("a", 9000, "content")])
