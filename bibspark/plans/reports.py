"""Report tables: findings, incidents, evidence, revisions, value tables, hand-off and public projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions import formats
from bibspark.operators import lists


def findings_report(findings: DataFrame) -> DataFrame:
    """Findings by severity rank, code and record."""
    return findings.withColumn("rank", formats.severity_rank(F.col("severity"))).orderBy("rank", "code", "record_id", "detail").drop("rank")


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and code with subtotals (null code) and the total (null severity)."""
    return findings.rollup("severity", "code").agg(F.count("*").alias("findings"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of all tables."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def value_table(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """Values with their field's kind, in order, as text; a dash for none."""
    shown = F.coalesce("s", F.col("n").cast("string"), F.col("b").cast("string"), F.lit("—"))
    joined = values.join(definitions.select("schema_id", "field_id", "kind"), ["schema_id", "field_id"], "left")
    return joined.select("unit_id", "field_id", "kind", "value_index", shown.alias("shown"))


def original_and_canonical(catalog: DataFrame, fields: list[str]) -> DataFrame:
    """(id, side, name, value): canonical fields and the source evidence of each record, one row each."""
    canonical = catalog.unpivot("id", fields, "name", "value").withColumn("side", F.lit("canonical"))
    source = catalog.select("id", F.explode("trace").alias("name", "value")).withColumn("side", F.lit("source"))
    return canonical.unionByName(source).select("id", "side", "name", "value")


def selection_bytes(units: DataFrame, values: DataFrame, most: int) -> DataFrame:
    """(schema_id, bytes, over) of archive selections: UTF-8 bytes of their ids and values against a budget."""
    v = values.groupBy(F.col("unit_id").alias("id")).agg(F.sum(F.octet_length(F.coalesce("s", F.col("n").cast("string"), F.col("b").cast("string"), F.lit(""))) + F.octet_length("field_id")).alias("own"))
    rows = units.join(v, "id", "left").groupBy("schema_id").agg(F.sum(F.octet_length("id") + F.coalesce("own", F.lit(0))).cast("long").alias("bytes"))
    return rows.withColumn("over", F.col("bytes") > most)


def display_labels(units: DataFrame, values: DataFrame) -> DataFrame:
    """(id, label): the title, else the reference code, else the id."""
    v = values.groupBy("unit_id").agg(F.min(F.when(F.col("field_id") == "title", F.col("s"))).alias("t"), F.min(F.when(F.col("field_id") == "reference_code", F.col("s"))).alias("r"))
    return units.join(v, units.id == v.unit_id, "left").select("id", F.coalesce("t", "r", "id").alias("label"))


def public_projection(catalog: DataFrame, gate: DataFrame) -> DataFrame:
    """Allow-listed columns of public records; nothing if the one-row gate (reason) is not open."""
    rows = catalog.where("public_visible and not suppressed").select("id", "title", "creators", "format", "availability", "location", F.lit(1).alias("_k"))
    return rows.join(gate.where("reason = 'open'").select(F.lit(1).alias("_k")), "_k").drop("_k")


def public_services(incidents: DataFrame) -> DataFrame:
    """Distinct services with an open incident, sorted."""
    return lists.open_incidents(incidents).select("service").distinct().orderBy("service")


def handoff(incidents: DataFrame, revisions: DataFrame, config: DataFrame) -> DataFrame:
    """Open incidents with the newest revision of their workspace and its configuration."""
    newest = revisions.groupBy("workspace_id").agg(F.max_by("id", "ordinal").alias("revision_id"))
    return lists.open_incidents(incidents).join(newest, "workspace_id", "left").join(config, "workspace_id", "left")


def ordered(rows: DataFrame, kind: str) -> DataFrame:
    """The order of each report table."""
    order = {"incident": ["opened_at", "id"], "schema": ["name", "id"], "service": ["area", "title", "id"], "audit": ["sequence"], "snapshot": [F.desc("saved_at"), "name"], "quarantine": ["id"], "revision": [F.desc("ordinal")]}
    return rows.orderBy(*order[kind])
