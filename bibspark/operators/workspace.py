"""Whole snapshots: next states with an audit row, schema evolution, digests over tables, checkpoints and witnesses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.functions import digest, identity
from bibspark.functions.text import first_reason
from bibspark.operators import fields, hierarchy, ledger, rules, snapshots

REVISION = "workspace_id string, id string, parent_id string, ordinal long, label string, digest string"
EVENT = "ledger_id string, sequence long, instant string, action string, target string, state_digest string, previous_hash string, hash string"


def empty_workspace(spark: SparkSession, workspace_id: str, instant: str) -> dict[str, DataFrame]:
    """Typed empty tables, one revision and the genesis audit event."""
    revision = spark.createDataFrame([(workspace_id, "rev-1", None, 1, "created", None)], REVISION)
    event = spark.createDataFrame([(workspace_id, 1, instant, "create", workspace_id, None)], "ledger_id string, sequence long, instant string, action string, target string, state_digest string")
    return {"revision": revision, "audit": ledger.append_chain(event).select(*[f.split()[0] for f in EVENT.split(", ")])}


def next_event(audit: DataFrame, action: str, target: str, state_digest: Column, instant: str) -> DataFrame:
    """The next audit event of each ledger, bound to the last one."""
    last = audit.groupBy("ledger_id").agg(F.max_by("hash", "sequence").alias("previous_hash"), (F.max("sequence") + 1).alias("sequence"))
    rows = last.select("ledger_id", "sequence", F.lit(instant).alias("instant"), F.lit(action).alias("action"), F.lit(target).alias("target"), state_digest.alias("state_digest"), "previous_hash")
    return rows.withColumn("hash", ledger.event_hash())


def next_revision(revisions: DataFrame, new_id: str, label: str, state_digest: Column) -> DataFrame:
    """The successor of each workspace's newest revision."""
    last = revisions.groupBy("workspace_id").agg(F.max_by("id", "ordinal").alias("parent_id"), (F.max("ordinal") + 1).alias("ordinal"))
    return last.select("workspace_id", F.lit(new_id).alias("id"), "parent_id", "ordinal", F.lit(label).alias("label"), state_digest.alias("digest"))


def state_digest(tables: dict[str, DataFrame]) -> DataFrame:
    """(digest) of a snapshot: the digest of its tables' digests in the order of their names."""
    parts = [digest.table_digest(t, t.columns).select(F.lit(n).alias("name"), "rows", "digest") for n, t in sorted(tables.items())]
    all_parts = reduce(DataFrame.unionByName, parts)
    text = F.array_sort(F.collect_list(F.struct("name", F.concat_ws(":", "name", F.col("rows").cast("string"), "digest").alias("d"))))
    return all_parts.agg(F.sha2(F.array_join(F.transform(text, lambda x: x["d"]), "\n"), 256).alias("digest"))


def import_archive(schemas: DataFrame, units: DataFrame, current_schemas: DataFrame, current_units: DataFrame) -> DataFrame:
    """(kind, id, outcome, reason) of incoming schemas (schema_id) and units (id, parent_id, schema_id): id conflicts with
    what is there, and hierarchy problems of what comes."""
    bad = hierarchy.hierarchy_findings(units.select("id", "parent_id")).groupBy("id").agg(F.min("problem").alias("problem"))
    u = units.select("id").join(snapshots.id_conflicts(units, current_units).withColumn("there", F.lit(True)), "id", "left").join(bad, "id", "left")
    unit_rows = u.select(F.lit("unit").alias("kind"), "id", first_reason((F.col("there"), "id-conflict"), (F.col("problem").isNotNull(), "hierarchy")).alias("reason"))
    s = schemas.select(F.col("schema_id").alias("id")).join(current_schemas.select(F.col("schema_id").alias("id"), F.lit(True).alias("there")), "id", "left")
    rows = unit_rows.unionByName(s.select(F.lit("schema").alias("kind"), "id", first_reason((F.col("there"), "id-conflict")).alias("reason")))
    return rows.select("kind", "id", F.when(F.col("reason").isNull(), "applied").otherwise("not-applied").alias("outcome"), F.coalesce("reason", F.lit("accepted")).alias("reason"))


def schema_changes(before: DataFrame, after: DataFrame, units: DataFrame) -> DataFrame:
    """(schema_id, change) of field tables: added, removed, labels or structure; structural changes of a schema that has
    units, and its removal, are refused."""
    b = fields.structure_digest(before).withColumnRenamed("digest", "was")
    a = fields.structure_digest(after).withColumnRenamed("digest", "now")
    used = units.select("schema_id").distinct().withColumn("used", F.lit(True))
    rows = b.join(a, "schema_id", "full").join(used, "schema_id", "left")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), F.when(F.col("used"), "refused-removal").otherwise("removed")).when(F.col("was") != F.col("now"), F.when(F.col("used"), "refused-structure").otherwise("structure")).otherwise("labels")
    return rows.select("schema_id", change.alias("change"))


def bump_units(units: DataFrame, versions: DataFrame) -> DataFrame:
    """Units at their schema's new version (versions: schema_id, version)."""
    v = versions.select("schema_id", F.col("version").alias("_v"))
    return units.join(v, "schema_id", "left").withColumn("schema_version", F.coalesce("_v", "schema_version")).drop("_v")


def fork(revisions: DataFrame, audit: DataFrame, new_id: str, instant: str) -> dict[str, DataFrame]:
    """A successor workspace per ledger: a revision without a parent, and a genesis event that names the last hash."""
    last = audit.groupBy("ledger_id").agg(F.max_by("hash", "sequence").alias("terminal"), F.max_by("state_digest", "sequence").alias("state_digest"))
    event = last.select(F.concat("ledger_id", F.lit(f"/{new_id}")).alias("ledger_id"), F.lit(1).cast("long").alias("sequence"), F.lit(instant).alias("instant"), F.lit("fork").alias("action"), F.concat(F.lit("after:"), "terminal").alias("target"), "state_digest", F.lit(ledger.GENESIS).alias("previous_hash"))
    newest = revisions.groupBy("workspace_id").agg(F.max_by("digest", "ordinal").alias("digest"))
    revision = newest.select(F.concat("workspace_id", F.lit(f"/{new_id}")).alias("workspace_id"), F.lit("rev-1").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).cast("long").alias("ordinal"), F.lit("forked").alias("label"), "digest")
    return {"revision": revision, "audit": event.withColumn("hash", ledger.event_hash())}


def prior_terminal(target: Column) -> Column:
    """The hash that a fork's genesis event points to."""
    return F.nullif(F.regexp_extract(target, r"^after:([0-9a-f]{64})$", 1), F.lit(""))


def record_decisions(reviews: DataFrame, instant: str) -> DataFrame:
    """Decision rows with content-derived ids from reviews (source_kind, source_sha, entity_ids, decision)."""
    cols = ["source_kind", "source_sha", "entity_ids", "decision"]
    rows = reviews.select(*cols).withColumn("instant", F.lit(instant))
    return rows.withColumn("record_sha", digest.seal([*cols, "instant"]))


def broken_seals(rows: DataFrame, columns: list[str], stored: str = "record_sha") -> DataFrame:
    """Rows whose stored digest is not that of their columns."""
    return rows.where(F.col(stored) != digest.seal(columns))


def snapshot_problems(revisions: DataFrame, audit: DataFrame, tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(part, id, problem): repeated keys of each table, broken lineage, broken ledgers."""
    parts = [t.groupBy(F.col(keys[n]).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(n).alias("part"), "id", F.lit("duplicate-key").alias("problem")) for n, t in tables.items()]
    parts.append(ledger.lineage_problems(revisions).select(F.lit("revision").alias("part"), "id", F.lit("parent").alias("problem")))
    breaks = ledger.chain_breaks(audit)
    parts.append(breaks.select(F.lit("audit").alias("part"), F.concat_ws("#", "ledger_id", F.col("sequence").cast("string")).alias("id"), first_reason((F.col("gap"), "gap"), (F.col("link"), "link"), (F.col("content"), "content")).alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def witnesses(anchors: DataFrame, origin: str) -> DataFrame:
    """Witness rows of checkpoints (lineage_id, sequence, generation, audit_count, digest): each names the one before."""
    before = F.lag("digest").over(Window.partitionBy("lineage_id").orderBy("sequence"))
    rows = anchors.select("lineage_id", F.lit(origin).alias("origin_scope"), "sequence", "generation", "audit_count", F.col("digest").alias("anchor_digest"), before.alias("predecessor_digest"))
    cols = ["lineage_id", "origin_scope", "sequence", "generation", "audit_count", "anchor_digest"]
    return rows.withColumn("digest", digest.row_digest(cols))


def compare_external(topology: DataFrame, terminals: DataFrame, anchors: DataFrame) -> DataFrame:
    """(lineage_id, status) of local anchors (lineage_id, sequence, digest) against witness topology and the terminals
    (lineage_id, digest, sequence) that a policy names: indeterminate, fork, invalid-evidence, gap, rollback,
    content-mismatch or trusted-match."""
    t = terminals.select("lineage_id", F.col("digest").alias("terminal"), F.col("sequence").alias("terminal_at"))
    rows = anchors.join(topology.select("lineage_id", F.col("status").alias("topology")), "lineage_id", "left").join(t, "lineage_id", "left")
    status = (
        F.when(F.col("terminal").isNull() | F.col("topology").isNull(), "indeterminate").when(F.col("topology") == "forked", "fork").when(F.col("topology").isin("invalid", "boundary", "terminal-conflict"), "invalid-evidence").when(F.col("topology") == "gap", "gap")
        .when(F.col("terminal_at") > F.col("sequence"), "rollback").when(F.col("terminal") != F.col("digest"), "content-mismatch").otherwise("trusted-match")
    )
    return rows.select("lineage_id", status.alias("status"))


def recovery_reviews(snapshots_now: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, status) of recovered snapshots (id, digest, audit_count, origin) against claimed checkpoints of the same
    columns: matches, other-origin, behind, ahead, differs or unclaimed."""
    c = claims.select("id", F.col("digest").alias("cd"), F.col("audit_count").alias("ca"), F.col("origin").alias("co"))
    rows = snapshots_now.join(c, "id", "left")
    status = F.when(F.col("cd").isNull(), "unclaimed").when(F.col("origin") != F.col("co"), "other-origin").when(F.col("digest") == F.col("cd"), "matches").when(F.col("audit_count") < F.col("ca"), "behind").when(F.col("audit_count") > F.col("ca"), "ahead").otherwise("differs")
    return rows.select("id", status.alias("status"))


def correct_records(current: DataFrame, changes: DataFrame, most_links: int = 20, most_names: int = 50) -> tuple[DataFrame, DataFrame]:
    """(next, refused): records with the changes that keep every rule; refused: (id, reason) of the others.

    A change is refused if its record does not exist, gets too many links or names, or would have an error finding."""
    patched = snapshots.patch(current.join(changes.select("id"), "id", "left_semi"), changes)
    rows = patched.withColumn("claims", identity.identity_claims(F.col("identifiers"), F.col("links")))
    errors = rules.row_findings(rows, F.col("id"), rules.catalog_rules()).where("severity = 'error'").groupBy(F.col("record_id").alias("id")).agg(F.min("code").alias("code"))
    reason = F.coalesce(first_reason((F.size("links") > most_links, "too-many-links"), (F.size("creators") > most_names, "too-many-names")), F.col("code"))
    judged = patched.join(errors, "id", "left").withColumn("reason", reason)
    bad = judged.where("reason is not null").select("id", "reason")
    unknown = changes.select("id").join(current.select("id"), "id", "left_anti").select("id", F.lit("no-record").alias("reason"))
    good = changes.join(bad, "id", "left_anti")
    return snapshots.patch(current, good), bad.unionByName(unknown)


def change_config(config: DataFrame, changes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(next, problems) of the one-row configuration; with a problem the configuration stays as it was."""
    wanted = config.withColumns({k: F.lit(v) for k, v in changes.items()})
    problems = rules.row_findings(wanted, F.lit("config"), rules.config_rules())
    ok = problems.isEmpty()
    return (wanted if ok else config), problems


def same_review(stored: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, same): whether a stored review equals the one that is derived again."""
    d = derived.select(key, digest.row_digest(columns).alias("now"))
    return stored.select(key, digest.row_digest(columns).alias("was")).join(d, key, "full").select(key, F.col("was").eqNullSafe(F.col("now")).alias("same"))
