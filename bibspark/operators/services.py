"""Service records: rules, long export and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions import text
from bibspark.operators import fields
from bibspark.plans.dictionaries import SENSITIVITIES, SERVICE_STATES


def record_problems(records: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, problem) of records (id, kind, area, title, state, owner_role, system, sensitivity, created_at, updated_at):
    unsafe or repeated ids, unknown kinds, areas that do not fit, states, sensitivities, texts and instants."""
    kinds = definitions.select(F.col("schema_id").alias("kind"), F.col("area").alias("own_area")).distinct()
    rows = records.join(kinds, "kind", "left")
    c = F.col
    tests = [
        ("unsafe-id", ~text.is_safe_id(c("id"))),
        ("unknown-kind", c("own_area").isNull()),
        ("area", c("area") != c("own_area")),
        ("state", ~c("state").isin(*SERVICE_STATES)),
        ("sensitivity", ~c("sensitivity").isin(*SENSITIVITIES)),
        ("title", ~text.is_canonical(c("title"), 500, required=True)),
        ("owner", ~text.is_canonical(c("owner_role"), 160)),
        ("system", ~text.is_canonical(c("system"), 256)),
        ("instants", c("updated_at") < c("created_at")),
    ]
    one = rows.select("id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))).alias("problem"))
    twice = records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate-id").alias("problem"))
    return one.unionByName(twice)


def value_problems(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """Typed values of service records (unit_id, schema_id = kind, field_id, value_index, s, n, b)."""
    one = fields.typed_value_violations(values, definitions, fields.SERVICE)
    many = fields.repeat_violations(values, definitions, fields.SERVICE).select("unit_id", "field_id", F.lit(None).cast("int").alias("value_index"), "problem")
    return one.unionByName(many)


def long_table(records: DataFrame, values: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per value, and one with blanks for a record without any."""
    v = values.join(definitions.select("schema_id", "field_id", "kind"), ["schema_id", "field_id"], "left").select(F.col("unit_id").alias("id"), "field_id", F.col("kind").alias("field_kind"), "value_index", F.coalesce("s", F.col("n").cast("string"), F.col("b").cast("string")).alias("value"))
    head = records.select("id", "kind", "area", "title", "state", "owner_role", "system", "sensitivity", "created_at", "updated_at")
    rows = head.join(v, "id", "left")
    return rows.select(*head.columns, F.coalesce("field_id", F.lit("")).alias("field_id"), F.coalesce("field_kind", F.lit("")).alias("field_kind"), F.coalesce(F.col("value_index").cast("string"), F.lit("")).alias("value_index"), text.protect_cell(F.coalesce("value", F.lit(""))).alias("value"))


def to_json(records: DataFrame, values: DataFrame) -> DataFrame:
    """(id, out): each record with its values as JSON."""
    v = values.groupBy(F.col("unit_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("field_id", "value_index", "s", "n", "b"))).alias("values"))
    rows = records.join(v, "id", "left")
    return rows.select("id", F.to_json(F.struct(*records.columns, "values")).alias("out"))


def states(records: DataFrame) -> DataFrame:
    """One row: blocked, review and due counts."""
    return records.agg(F.count_if(F.col("state") == "blocked").alias("blocked"), F.count_if(F.col("state").isin("review", "due")).alias("review_or_due"))


def rollup(records: DataFrame, definitions: DataFrame) -> DataFrame:
    """(area, kinds, records): every area, with its kinds."""
    areas = definitions.groupBy("area").agg(F.array_join(F.array_sort(F.collect_set("schema_id")), ", ").alias("kinds"))
    n = records.groupBy("area").agg(F.count("*").alias("records"))
    return areas.join(n, "area", "left").select("area", "kinds", F.coalesce("records", F.lit(0)).cast("long").alias("records"))
