"""Versioned state as table transforms: conflicts, import, upsert, delete, patch, rollback, diff, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions import identity


def id_conflicts(incoming: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    return incoming.select(key).join(current.select(key), key, "left_semi").distinct()


def claims(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode(identity.identity_claims(F.col("identifiers"), F.col("links"))).alias("claim"))


def claim_conflicts(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """(id, claim) of incoming records that share an identity claim with a current one."""
    return claims(incoming).join(claims(current).select("claim"), "claim", "left_semi").select("id", "claim").distinct()


def apply_import(incoming: DataFrame, current: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per incoming record (id, outcome, reason): validation-failed, id-conflict, claim-conflict or accepted."""
    errors = findings.where("severity = 'error'").select(F.col("record_id").alias("id")).distinct().withColumn("e", F.lit(True))
    ids = id_conflicts(incoming, current).withColumn("i", F.lit(True))
    same = claim_conflicts(incoming, current).select("id").distinct().withColumn("c", F.lit(True))
    rows = incoming.select("id").join(errors, "id", "left").join(ids, "id", "left").join(same, "id", "left")
    reason = F.when(F.col("e"), "validation-failed").when(F.col("i"), "id-conflict").when(F.col("c"), "claim-conflict").otherwise("accepted")
    return rows.select("id", F.when(reason == "accepted", "applied").otherwise("not-applied").alias("outcome"), reason.alias("reason"))


def append_accepted(current: DataFrame, incoming: DataFrame, outcomes: DataFrame) -> DataFrame:
    return current.unionByName(incoming.join(outcomes.where("outcome = 'applied'").select("id"), "id", "left_semi"))


def upsert(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of changes replace those of the same key."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(current: DataFrame, keys: DataFrame, key: str = "id", guard: DataFrame | None = None) -> DataFrame:
    """Without the given keys, except those that guard (a table with the key column) still refers to."""
    gone = keys.select(key)
    if guard is not None:
        gone = gone.join(guard.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return current.join(gone, key, "left_anti")


def patch(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Non-null columns of changes replace those of the same key; a column `clear` (array of names) names those that
    become null."""
    cols = [c for c in changes.columns if c not in (key, "clear")]
    clear = F.col("clear") if "clear" in changes.columns else F.array().cast("array<string>")
    renamed = changes.select(key, clear.alias("_clear"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    gone = lambda c: F.coalesce(F.array_contains("_clear", c), F.lit(False))
    new = {c: F.coalesce(f"_new_{c}", c) if c in cols else F.col(c) for c in current.columns}
    return current.join(renamed, key, "left").select(*[F.col(c) if c == key else F.when(~gone(c), v).alias(c) for c, v in new.items()])


def rollback(history: DataFrame, to_revision: str, new_revision: str) -> DataFrame:
    """The rows of an earlier revision as a new one; history is partitioned by revision_id, so one partition is read."""
    return history.where(F.col("revision_id") == to_revision).withColumn("revision_id", F.lit(new_revision))


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, field, before, after): added, removed (field null) and changed (one row per changed field)."""
    a = before.select(F.col(key), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    b = after.select(F.col(key), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    rows = a.join(b, key, "full")
    fields = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit("changed").alias("change"), F.lit(c).alias("field"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after"))) for c in columns]
    whole = lambda name: F.array(F.struct(F.lit(name).alias("change"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    found = F.when(F.col("in_a").isNull(), whole("added")).when(F.col("in_b").isNull(), whole("removed")).otherwise(F.array_compact(F.array(*fields)))
    return rows.select(key, F.explode(found).alias("d")).select(key, "d.*")


def store(rows: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A revision as a table of the warehouse, in `buckets` buckets by key, sorted within; read back.

    Revisions that are stored alike are compared, joined and upserted by key without a shuffle, as often as one likes:
    choose buckets for the size that revisions will have (about 256 MB each), the same for all."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("errorifexists").saveAsTable(name)
    return rows.sparkSession.table(name)


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (missing, extra, equal): multiset equality of two tables."""
    missing = left.exceptAll(right).agg(F.count("*").alias("missing")).withColumn("k", F.lit(1))
    extra = right.exceptAll(left).agg(F.count("*").alias("extra")).withColumn("k", F.lit(1))
    return missing.join(extra, "k").select("missing", "extra", ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("equal"))


def reconcile(manifests: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, reasons) of manifests (id, active_generation, previous_generation, payload_digest) against stored objects
    (id, generation, payload_digest)."""
    active = objects.select("id", F.col("generation").alias("active_generation"), F.col("payload_digest").alias("active_digest"))
    previous = objects.select("id", F.col("generation").alias("previous_generation"), F.lit(True).alias("has_previous"))
    stored = objects.groupBy("id").agg(F.count("*").alias("stored"))
    rows = manifests.join(stored, "id", "full").join(active, ["id", "active_generation"], "left").join(previous, ["id", "previous_generation"], "left")
    tests = [
        ("missing-manifest", F.col("payload_digest").isNull() & F.col("active_generation").isNull()),
        ("missing-active", F.col("active_generation").isNotNull() & F.col("active_digest").isNull()),
        ("missing-previous", F.col("previous_generation").isNotNull() & F.col("has_previous").isNull()),
        ("digest-mismatch", F.col("active_digest") != F.col("payload_digest")),
        ("unreferenced", F.col("stored") > F.when(F.col("active_generation").isNotNull(), 1).otherwise(0) + F.when(F.col("previous_generation").isNotNull(), 1).otherwise(0)),
    ]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))
    return rows.select("id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def manifest_rows(tables: dict[str, DataFrame], key: str = "revision_id") -> DataFrame:
    """(revision_id, table, rows): how many rows of each table a revision has."""
    parts = [t.groupBy(key).agg(F.count("*").alias("rows")).select(key, F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def choose_active(snapshots: DataFrame) -> DataFrame:
    """(id, generation, state): the newest snapshot (id, generation, available, digest, header_digest) that verifies; if
    the newest disagrees with its header the state is stopped, if it is unavailable the verified one before is taken."""
    ok = F.col("available") & (F.col("digest") == F.col("header_digest"))
    newest = snapshots.groupBy("id").agg(F.max_by(F.struct("generation", "available", ok.alias("ok")), "generation").alias("n"), F.max(F.when(ok, F.col("generation"))).alias("verified"))
    state = F.when(F.col("n.ok"), "active").when(F.col("n.available"), "stopped").when(F.col("verified").isNotNull(), "fallback").otherwise("unavailable")
    return newest.select("id", F.when(state == "active", F.col("n.generation")).when(state == "fallback", F.col("verified")).alias("generation"), state.alias("state"))
