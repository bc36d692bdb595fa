"""Structured Streaming forms of intake, conflict checks, ledger verification, duplicate suppression and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bibspark.operators.ledger import FIELDS, GENESIS, event_hash
from bibspark.sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files of a folder as they arrive."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).load(path)


def intake_stream(spark: SparkSession, path: str, accepted: str, quarantine: str, checkpoint: str, glob: str = "*", most: int | None = None):
    """Continuous intake: each micro-batch goes to a folder epoch=n of accepted or quarantine Parquet; returns the running
    query. A batch that is tried again replaces its own folders. most: larger files are quarantined."""

    def write(rows: DataFrame, epoch: int) -> None:
        known = files.intake(rows, most).persist(StorageLevel.MEMORY_AND_DISK)
        known.where("block is null").drop("block").write.mode("overwrite").parquet(f"{accepted}/epoch={epoch}")
        known.where("block is not null").drop("text").write.mode("overwrite").parquet(f"{quarantine}/epoch={epoch}")
        known.unpersist()

    source = stream_files(spark, path, glob)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_records(incoming: DataFrame, current: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts) of a stream of records against the current snapshot (stream-static joins)."""
    keys = current.select(key).distinct()
    return incoming.join(keys, key, "left_anti"), incoming.join(keys, key, "left_semi")


def without_repeats(arrivals: DataFrame, delay: str = "1 hour", at: str = "arrived", digest: str = "sha256") -> DataFrame:
    """Drops content that arrived before, within the watermark."""
    return arrivals.withWatermark(at, delay).dropDuplicatesWithinWatermark([digest])


def findings_per_window(findings: DataFrame, width: str = "1 hour", delay: str = "1 hour", at: str = "ts") -> DataFrame:
    """Findings by tumbling window, severity and code; windows close behind the watermark."""
    groups = findings.withWatermark(at, delay).groupBy(F.window(at, width), "severity", "code").agg(F.count("*").alias("findings"))
    return groups.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "severity", "code", "findings")


VERDICT = "ledger_id string, sequence long, problem string"


BUCKETS = 1024  # groups that ledgers are dealt to by a hash: a call to the state store, and a group, cost as much as some hundred events
BLOCK = 256  # sequence numbers whose waiting events, of all ledgers of a bucket, are one value of the state
HELD = 4  # blocks of a bucket in the worker's memory
LAST = "ledger_id array<string>, sequence array<bigint>, hash array<string>, early array<bigint>, timer bigint"
EARLY = "ledger_id array<string>, sequence array<bigint>, previous_hash array<string>, hash array<string>, content array<string>, ms array<bigint>"


class LedgerVerifier(StatefulProcessor):
    """Per ledger of a bucket: the last sequence number and hash that are verified, and a buffer of events that came too early.

    The buffer is a map of the state store, not of the worker's memory: BLOCK neighbouring numbers are a value, of which HELD are
    in memory at most. Frames are read one by one. An event is verified when all before it are. patient: a gap stays open until
    the watermark passes the event behind it, else only until the micro-batch ends."""

    def __init__(self, patient: bool) -> None:
        self.patient = patient

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.early = handle.getMapState("early", "block long", EARLY)

    def _begin(self) -> None:
        *known, self.timer = self.last.get() or ([], [], [], [], 0)
        self.ledgers = {ledger: state for ledger, *state in zip(*known, strict=True)}  # sequence, hash, waiting events
        self.waiting = sum(known[3])
        self.stored = self.waiting > 0  # without waiting events the map is empty
        self.blocks: dict[int, dict[tuple, tuple]] = {}  # those in memory: (ledger, sequence) -> (previous_hash, hash, content, ms)
        self.changed: set[int] = set()
        self.out: list = []

    def _block(self, number: int) -> dict[tuple, tuple]:
        if number not in self.blocks:
            while len(self.blocks) >= HELD:
                self._write(next(iter(self.blocks)))
            found = self.early.getValue((number,)) if self.stored and self.early.containsKey((number,)) else None
            self.blocks[number] = dict(zip(zip(*found[:2], strict=True), zip(*found[2:], strict=True), strict=True)) if found else {}
        return self.blocks[number]

    def _write(self, number: int) -> None:
        """A block leaves memory."""
        events = self.blocks.pop(number)
        if number in self.changed:
            self.changed.remove(number)
            if events:
                self.early.updateValue((number,), (*map(list, zip(*events, strict=True)), *map(list, zip(*events.values(), strict=True))))
                self.stored = True
            elif self.stored and self.early.containsKey((number,)):
                self.early.removeKey((number,))

    def _verify(self, ledger: str, sequence: int, previous: str, own: str, content: str) -> None:
        state = self.ledgers[ledger]
        if sequence != state[0] + 1:
            self.out.append((ledger, sequence, "gap"))
        elif previous != state[1]:
            self.out.append((ledger, sequence, "link"))
        elif own != content:
            self.out.append((ledger, sequence, "content"))
        state[:2] = sequence, own

    def _take(self, ledger: str, sequence: int) -> None:
        """Verify an event of the buffer."""
        number = sequence // BLOCK
        self._verify(ledger, sequence, *self._block(number).pop((ledger, sequence))[:3])
        self.changed.add(number)
        self.ledgers[ledger][2] -= 1
        self.waiting -= 1

    def _see(self, ledger: str, sequence: int, event: tuple) -> bool:
        """Verify an event and what it lets follow, or keep it: then true."""
        state = self.ledgers.setdefault(ledger, [0, GENESIS, 0])
        if sequence <= state[0] or state[2] and (ledger, sequence) in self._block(sequence // BLOCK):
            self.out.append((ledger, sequence, "repeat"))
        elif sequence == state[0] + 1:
            self._verify(ledger, sequence, *event[:3])
            while state[2] and (ledger, state[0] + 1) in self._block((state[0] + 1) // BLOCK):
                self._take(ledger, state[0] + 1)
        else:
            self._block(sequence // BLOCK)[ledger, sequence] = event
            self.changed.add(sequence // BLOCK)
            state[2] += 1
            self.waiting += 1
            return True
        return False

    def _wake(self, ms: int) -> None:
        """Ask to be woken, unless that is asked for already; who is woken asks for what is left."""
        if not 0 < self.timer <= ms:
            self.handle.registerTimer(ms)
            self.timer = ms

    def _close_gaps(self, now: int | None) -> None:
        """Go on behind gaps whose next event is older than now (None: all), and ask to be woken for the rest."""
        stored = [number for (number,) in self.early.keys()] if self.stored else []
        open_until: dict[str, int] = {}
        for number in sorted({*stored, *self.blocks}):
            for ledger, sequence in sorted(self._block(number), key=lambda k: k[1]):
                due = self._block(number)[ledger, sequence][3]
                if ledger in open_until:
                    continue
                if sequence != self.ledgers[ledger][0] + 1 and now is not None and due > now:
                    open_until[ledger] = due
                else:
                    self._take(ledger, sequence)
        if open_until:
            self._wake(min(open_until.values()))

    def _end(self) -> Iterator[pd.DataFrame]:
        for number in list(self.blocks):
            self._write(number)
        states = self.ledgers.values()
        self.last.update((list(self.ledgers), *([s[i] for s in states] for i in range(3)), self.timer))
        yield from self._found()

    def _found(self) -> Iterator[pd.DataFrame]:
        if self.out:
            yield pd.DataFrame(self.out, columns=["ledger_id", "sequence", "problem"])
            self.out = []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._begin()
        first = None
        for frame in rows:
            ledgers, s, previous, own, content, ms = (frame[c].tolist() for c in ("ledger_id", "sequence", "previous_hash", "hash", "content", "ms"))
            for i in sorted(range(len(s)), key=s.__getitem__):
                if self._see(ledgers[i], s[i], (previous[i], own[i], content[i], ms[i])):
                    first = ms[i] if first is None else min(first, ms[i])
            yield from self._found()
        if self.waiting and not self.patient:
            self._close_gaps(None)
        elif self.waiting and first is not None:
            self._wake(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._end()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._begin()
        self.timer = 0
        if self.waiting:
            self._close_gaps(timerValues.getCurrentWatermarkInMs())
        yield from self._end()

    def close(self) -> None:
        pass


def verify_ledger_stream(events: DataFrame, expected: Column | None = None, at: str | None = None, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(ledger_id, sequence, problem) of a stream of events (ledger.FIELDS and hash): gap, link or content, first that
    holds; repeat for a number that was verified or is waiting already (the event that came first counts).

    Events of one ledger may come in any order. With a time column `at`, an event that comes early waits in the state
    until those before it are there, or until the watermark (`delay` behind the newest event) passes it: then the gap
    before it is reported. Without one, micro-batches have to come in order and gaps are reported at their end. The
    content is checked where events have all FIELDS. expected: the hash that an event should have, if it is not
    event_hash(). buckets: groups that ledgers are dealt to, fixed for the life of a checkpoint; a task holds a few hundred events of each
    ledger of one of them. Needs the RocksDB state store."""
    if expected is None:
        expected = event_hash() if {*FIELDS} <= {*events.columns} else F.col("hash")
    ms = F.unix_millis(F.col(at).cast("timestamp")) if at else F.lit(0).cast("long")
    rows = events.withWatermark(at, delay) if at else events
    bucket = F.pmod(F.xxhash64("ledger_id"), F.lit(buckets)).alias("bucket")
    rows = rows.select(bucket, "ledger_id", "sequence", "previous_hash", "hash", expected.alias("content"), ms.alias("ms"), *([at] if at else []))
    return rows.groupBy("bucket").transformWithStateInPandas(LedgerVerifier(at is not None), VERDICT, "Append", "EventTime" if at else "none")
