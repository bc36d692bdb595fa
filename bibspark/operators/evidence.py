"""Evidence decisions and outcomes: coverage of entities by active decisions, status by precedence, link rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions import digest
from bibspark.operators.scan import running

#: Allowed (outcome, reason) by decision.
LINKS = [("admit", "applied", "accepted"), ("admit", "not-applied", "conflict"), ("admit", "not-applied", "validation-failed"), ("reject", "not-applied", "rejected"), ("withdraw", "not-applied", "withdrawn")]


def decision_outcomes(decisions: DataFrame, applications: DataFrame) -> DataFrame:
    """Each decision with its outcome, if it has one."""
    a = applications.select("decision_sha", "outcome", "reason", "revision_id")
    return decisions.join(a, decisions.record_sha == a.decision_sha, "left").drop("decision_sha")


def active_decisions(decisions: DataFrame, applications: DataFrame, entities: DataFrame) -> DataFrame:
    """Admitted and applied decisions of which a scoped entity is still there with the same source digest (archive
    sources need only the entity)."""
    d = decision_outcomes(decisions, applications).where("decision = 'admit' and outcome = 'applied'")
    scope = d.select("record_sha", "source_kind", "source_sha", F.explode("entity_ids").alias("entity_id"))
    exact = scope.where("source_kind <> 'archive'").join(entities.select("entity_id", "source_sha"), ["entity_id", "source_sha"], "left_semi")
    loose = scope.where("source_kind = 'archive'").join(entities.select("entity_id"), "entity_id", "left_semi")
    held = exact.select("record_sha").unionByName(loose.select("record_sha")).distinct()
    return d.join(held, "record_sha", "left_semi")


def unattributed(entities: DataFrame, active: DataFrame, exempt: tuple[str, ...] = ("fixture",)) -> DataFrame:
    """Entities (entity_id, source_kind, source_sha) that no active decision covers; exempt kinds never count."""
    covered = active.select(F.explode("entity_ids").alias("entity_id"), "source_sha").distinct()
    return entities.where(~F.col("source_kind").isin(*exempt)).join(covered, ["entity_id", "source_sha"], "left_anti")


def assessment(decisions: DataFrame, applications: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: applied, not_applied, admitted_unverified, active, unattributed, blocked, reason (the first that blocks)."""
    d = decision_outcomes(decisions, applications)
    active = active_decisions(decisions, applications, entities)
    counts = d.agg(F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "not-applied").alias("not_applied"), F.count_if((F.col("decision") == "admit") & F.col("outcome").isNull()).alias("admitted_unverified"))
    a = active.agg(F.count("*").alias("active"))
    u = unattributed(entities, active).agg(F.count("*").alias("unattributed"))
    one = F.lit(1)  # three tables of one row each
    rows = counts.withColumn("k", one).join(a.withColumn("k", one), "k").join(u.withColumn("k", one), "k").drop("k")
    reason = F.when(F.col("admitted_unverified") > 0, "admitted-unverified").when(F.col("unattributed") > 0, "unattributed").otherwise("none")
    return rows.withColumns({"blocked": (F.col("unattributed") > 0) | (F.col("admitted_unverified") > 0), "reason": reason})


def status_by_precedence(decisions: DataFrame) -> DataFrame:
    """(entity_id, status, mixed): withdraw before reject before admit, whatever their times; mixed if the decisions on
    an entity bind different sources."""
    rank = F.when(F.col("decision") == "withdraw", 0).when(F.col("decision") == "reject", 1).otherwise(2)
    rows = decisions.select(F.explode("entity_ids").alias("entity_id"), "decision", rank.alias("rank"), "source_sha")
    return rows.groupBy("entity_id").agg(F.min_by("decision", "rank").alias("status"), (F.min("source_sha") != F.max("source_sha")).alias("mixed"))


def bad_links(decisions: DataFrame, applications: DataFrame) -> DataFrame:
    """Outcomes whose (decision, outcome, reason) is not allowed, or without a decision."""
    a = applications.join(decisions.select(F.col("record_sha").alias("decision_sha"), "decision"), "decision_sha", "left")
    allowed = decisions.sparkSession.createDataFrame(LINKS, "decision string, outcome string, reason string")
    return a.join(allowed, ["decision", "outcome", "reason"], "left_anti").select("decision_sha", "decision", "outcome", "reason")


def outcome_revisions(applications: DataFrame, revisions: DataFrame) -> DataFrame:
    """Applied outcomes whose revision is retained with another digest (revision_digest differs)."""
    r = revisions.select(F.col("id").alias("revision_id"), F.col("digest").alias("kept"))
    return applications.where("outcome = 'applied'").join(r, "revision_id").where("revision_digest <> kept").select("decision_sha", "revision_id")


def warning_manifest(warnings: DataFrame) -> DataFrame:
    """(source_sha, warnings, digest) over warnings (source_sha, code, record_id, detail), independent of their order."""
    rows = warnings.select("source_sha", digest.row_digest(["code", "record_id", "detail"]).alias("d"))
    return rows.groupBy("source_sha").agg(F.count("*").alias("warnings"), digest.multiset_digest(F.col("d")).alias("digest"))


def receipt_checks(receipts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, refused) of receipts (id, workspace_id, lineage_id, sequence, anchor_digest, checkpoint) against anchors
    (workspace_id, lineage_id, sequence, digest, checkpoint), each number once; null where a receipt holds.

    The first that holds: workspace (unknown), lineage (unknown there), ahead (of the newest anchor), sequence (no anchor
    has it: the one in force is an earlier one), digest, checkpoint (not that of the anchor), stale (a newer one is in
    force). The anchor in force at a receipt's number is found by a scan over the lineage, so a lineage may be of any
    length."""
    mine = receipts.select("workspace_id", "lineage_id", "sequence", "id", "anchor_digest", "checkpoint", F.lit(None).cast("struct<sequence:bigint>").alias("a"), F.lit(1).alias("late"))
    known = F.struct(F.col("sequence").cast("long").alias("sequence"), "digest", F.col("checkpoint").alias("point"))
    theirs = anchors.select("workspace_id", "lineage_id", "sequence", F.lit(None).cast(receipts.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("anchor_digest"), "checkpoint", known.alias("a"), F.lit(0).alias("late"))
    both = mine.withColumn("a", F.lit(None).cast(theirs.schema["a"].dataType)).unionByName(theirs)
    placed = running(both, ["workspace_id", "lineage_id"], ["sequence", "late", "id"], earlier={"force": F.col("a")}).where("late = 1")
    newest = anchors.groupBy("workspace_id", "lineage_id").agg(F.max("sequence").alias("last"))
    spaces = newest.select("workspace_id", F.lit(True).alias("known")).distinct()
    rows = placed.join(spaces, "workspace_id", "left").join(newest, ["workspace_id", "lineage_id"], "left")
    refused = (
        F.when(F.col("known").isNull(), "workspace")
        .when(F.col("last").isNull(), "lineage")
        .when(F.col("sequence") > F.col("last"), "ahead")
        .when(F.col("force").isNull() | (F.col("force.sequence") != F.col("sequence")), "sequence")
        .when(F.col("force.digest") != F.col("anchor_digest"), "digest")
        .when(F.to_json("force.point") != F.to_json("checkpoint"), "checkpoint")
        .when(F.col("sequence") < F.col("last"), "stale")
    )
    return rows.select("id", refused.alias("refused"))
