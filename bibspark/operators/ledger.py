"""Hash-chained audit ledgers, revision lineages and checkpoints."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bibspark.functions.digest import encoded

GENESIS = "GENESIS"
FIELDS = ("ledger_id", "sequence", "instant", "action", "target", "state_digest", "previous_hash")


def event_hash(previous: Column | None = None) -> Column:
    """Hash of an event's fields and its predecessor's hash."""
    return F.sha2(encoded(*FIELDS[:-1], previous if previous is not None else F.col("previous_hash")), 256)


def append_chain(events: DataFrame) -> DataFrame:
    """Events (FIELDS without previous_hash) with previous_hash and hash.

    Hashing a chain is sequential within a ledger by nature; ledgers go in parallel. Each partition streams its sorted
    ledgers and keeps one hash, so a ledger of any length takes constant memory."""
    rows = events.select(*FIELDS[:-1], encoded(*FIELDS[:-1]).alias("_body")).repartition("ledger_id").sortWithinPartitions("ledger_id", "sequence")
    kept = [f.name for f in rows.schema.fields if f.name != "_body"]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("previous_hash", StringType()), StructField("hash", StringType())])

    def run(batches):
        ledger, last = None, GENESIS
        for b in batches:
            before, after = [], []
            for own, text in zip(b.column(0).to_pylist(), b.column(len(kept)).to_pylist(), strict=True):
                if own != ledger or ledger is None:
                    ledger, last = own, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{text}{len(last)}:{last}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*kept, "previous_hash", "hash"])

    return rows.mapInArrow(run, schema)


def chain_breaks(events: DataFrame, expected: Column | None = None) -> DataFrame:
    """Events whose link is broken: (ledger_id, sequence, gap, link, content), each a boolean.

    gap: the event before is missing, or several have this number; link: the hash before is not that of the event before
    (unknown where that is missing). Neighbours meet by joins on ledger and number, so a ledger of any length is many
    tasks' work.

    expected: the hash that an event should have, if ledgers are not chained by event_hash()."""
    before = events.groupBy("ledger_id", (F.col("sequence") + 1).alias("sequence")).agg(F.min("hash").alias("prior"))
    same = events.groupBy("ledger_id", "sequence").agg(F.count("*").alias("same"))
    first = F.col("sequence") == 1
    rows = events.join(before, ["ledger_id", "sequence"], "left").join(same, ["ledger_id", "sequence"]).select(
        "ledger_id",
        "sequence",
        (F.col("prior").isNull() & ~first | (F.col("same") > 1)).alias("gap"),
        F.coalesce(F.col("previous_hash") != F.when(first, GENESIS).otherwise(F.col("prior")), F.col("previous_hash").isNull()).alias("link"),
        F.coalesce(F.col("hash") != (event_hash() if expected is None else expected), F.lit(True)).alias("content"),
    )
    return rows.where("gap or link or content")


def verify_ledgers(events: DataFrame, states: DataFrame | None = None, expected: Column | None = None) -> DataFrame:
    """(ledger_id, events, broken, terminal_ok, valid); states: (ledger_id, digest) that the last event has to bind."""
    n = events.groupBy("ledger_id").agg(F.count("*").alias("events"), F.max_by("state_digest", "sequence").alias("terminal"))
    b = chain_breaks(events, expected).groupBy("ledger_id").agg(F.count("*").alias("broken"))
    rows = n.join(b, "ledger_id", "left").withColumn("broken", F.coalesce("broken", F.lit(0)).cast("long"))
    ok = F.lit(True)
    if states is not None:
        rows, ok = rows.join(states.select("ledger_id", F.col("digest").alias("bound")), "ledger_id", "left"), F.col("terminal").eqNullSafe(F.col("bound"))
    return rows.select("ledger_id", "events", "broken", ok.alias("terminal_ok"), ((F.col("broken") == 0) & ok).alias("valid"))


def lineage_problems(revisions: DataFrame) -> DataFrame:
    """Revisions (workspace_id, id, parent_id, ordinal) whose parent is not the revision before them."""
    before = revisions.select("workspace_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("id").alias("expected"))
    rows = revisions.join(before, ["workspace_id", "ordinal"], "left")
    return rows.where(~F.col("parent_id").eqNullSafe(F.col("expected"))).select("workspace_id", "id", "parent_id", "expected")


def retain_last(revisions: DataFrame, keep: int = 20) -> DataFrame:
    """The newest `keep` revisions of each workspace; the parent of the oldest kept becomes null."""
    order = Window.partitionBy("workspace_id").orderBy(F.desc("ordinal"))
    rows = revisions.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    oldest = F.max("r").over(Window.partitionBy("workspace_id"))
    return rows.withColumn("parent_id", F.when(F.col("r") < oldest, F.col("parent_id"))).drop("r")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def version_jumps(schemas: DataFrame) -> DataFrame:
    """Schema versions that are not one more than the last, or whose creation instant changed."""
    w = Window.partitionBy("schema_id").orderBy("version")
    rows = schemas.withColumns({"prior": F.lag("version").over(w), "created_before": F.lag("created_at").over(w)})
    return rows.where("version <> prior + 1 or created_at <> created_before").select("schema_id", "version", "prior")


def prefix_extension(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(ledger_id, extends): current has all events of previous unchanged, and more."""
    cols = ["ledger_id", "sequence", "hash"]
    lost = previous.select(*cols).exceptAll(current.select(*cols)).select("ledger_id").distinct().withColumn("lost", F.lit(True))
    top = lambda rows, name: rows.groupBy("ledger_id").agg(F.max("sequence").alias(name))
    rows = top(previous, "before").join(top(current, "now"), "ledger_id", "left").join(lost, "ledger_id", "left")
    return rows.select("ledger_id", (F.coalesce(F.col("now") > F.col("before"), F.lit(False)) & F.col("lost").isNull()).alias("extends"))


def checkpoints(events: DataFrame, generation: Column | None = None) -> DataFrame:
    """One checkpoint per ledger: first and last hash, count, last sequence and a digest that binds them."""
    rows = events.groupBy("ledger_id").agg(F.min_by("hash", "sequence").alias("genesis_hash"), F.max_by("hash", "sequence").alias("terminal_hash"), F.count("*").alias("audit_count"), F.max("sequence").alias("sequence"), F.max_by("state_digest", "sequence").alias("state_digest"))
    rows = rows.withColumn("generation", generation if generation is not None else F.lit(1).cast("long"))
    return rows.withColumn("digest", F.sha2(encoded("ledger_id", "genesis_hash", "terminal_hash", "audit_count", "sequence", "state_digest"), 256))


def verify_checkpoints(stored: DataFrame, events: DataFrame) -> DataFrame:
    """(ledger_id, status) of stored checkpoints against the ledgers as they are: matches, extended, rolled-back,
    forked, missing."""
    s = stored.select("ledger_id", F.col("terminal_hash").alias("was"), F.col("sequence").alias("at"))
    now = events.groupBy("ledger_id").agg(F.max("sequence").alias("last"))
    there = events.select("ledger_id", F.col("sequence").alias("at"), "hash")
    rows = s.join(now, "ledger_id", "left").join(there, ["ledger_id", "at"], "left")
    status = F.when(F.col("last").isNull(), "missing").when(F.col("last") < F.col("at"), "rolled-back").when(~F.col("hash").eqNullSafe(F.col("was")), "forked").when(F.col("last") > F.col("at"), "extended").otherwise("matches")
    return rows.select("ledger_id", status.alias("status"))


def progression_problems(anchors: DataFrame) -> DataFrame:
    """Consecutive checkpoints (lineage_id, generation, sequence, audit_count) that do not progress by one generation
    and one sequence number with a growing audit count."""
    w = Window.partitionBy("lineage_id").orderBy("generation", "sequence")
    rows = anchors.withColumns({c: F.lag(k).over(w) for c, k in (("g", "generation"), ("s", "sequence"), ("a", "audit_count"))})
    return rows.where("generation <> g + 1 or sequence <> s + 1 or audit_count <= a").select("lineage_id", "generation", "sequence")


def freshness(derived: DataFrame, present: DataFrame) -> DataFrame:
    """(name, state) of derived tables (name, input_digest, saved) against present digests (name, digest):
    not-saved, unsaved, current or stale."""
    rows = derived.join(present, "name", "left")
    state = F.when(F.col("digest").isNull(), "not-saved").when(~F.col("saved"), "unsaved").when(F.col("digest") == F.col("input_digest"), "current").otherwise("stale")
    return rows.select("name", state.alias("state"))
