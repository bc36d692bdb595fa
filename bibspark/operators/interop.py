"""Round-trip observations and their assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions.text import first_reason


def observation_problems(observations: DataFrame) -> DataFrame:
    """(case_id, path, problem) of observations (case_id, path, expected, displayed, underlying, reexported,
    transformation, finding): an unchanged one has four equal values, a hazard was executed or asked the network, a loss
    is of a loss class; (case_id, path) is unique."""
    c = F.col
    equal = c("expected").eqNullSafe(c("displayed")) & c("expected").eqNullSafe(c("underlying")) & c("expected").eqNullSafe(c("reexported"))
    hazard = c("transformation").isin("executed", "network")
    problem = first_reason(((c("transformation") == "unchanged") & ~equal, "unchanged-differs"), ((c("finding") == "hazard") != hazard, "hazard"), ((c("finding") == "loss") != c("transformation").isin("truncated", "dropped"), "loss"))
    one = observations.select("case_id", "path", problem.alias("problem")).where("problem is not null")
    twice = observations.groupBy("case_id", "path").agg(F.count("*").alias("n")).where("n > 1").select("case_id", "path", F.lit("repeated").alias("problem"))
    return one.unionByName(twice)


def report_mismatches(report: DataFrame, observations: DataFrame) -> DataFrame:
    """(case_id, path, side): losses and hazards that only the report or only the observations have."""
    keys = ["case_id", "path", "finding"]
    seen = observations.where("finding in ('loss', 'hazard')").select(*keys)
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(report.select(*keys), seen, "report").unionByName(only(seen, report.select(*keys), "observed"))


def field_differences(sent: DataFrame, back: DataFrame, key: str = "id") -> DataFrame:
    """(key, field, sent, back) of a round trip: every common field that came back differently, values as JSON.

    Both sides hold distinct keys; a record that did not come back differs in all its fields."""
    cols = [c for c in sent.columns if c in back.columns and c != key]
    as_text = lambda side, c: F.to_json(F.struct(F.col(f"{side}.{c}").alias("v")), {"ignoreNullFields": "false"})
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), as_text("s", c).alias("sent"), as_text("b", c).alias("back")) for c in cols])
    rows = sent.alias("s").join(back.alias("b"), F.col(f"s.{key}") == F.col(f"b.{key}"), "left")
    return rows.select(F.col(f"s.{key}").alias(key), F.explode(pairs).alias("p")).select(key, "p.*").where("sent <> back")


def assess(required: DataFrame, results: DataFrame, observations: DataFrame) -> DataFrame:
    """(bundle_id, status) by precedence: INVALID (broken or unknown observations), OBSOLETE (another profile version),
    FAILED (hazard or failed case), BLOCKED, INCOMPLETE (a required case without a result), PASS.

    required: (bundle_id, case_id); results: (bundle_id, case_id, outcome, current)."""
    bad = observation_problems(observations).select("case_id").distinct().withColumn("bad", F.lit(True))
    rows = required.withColumn("required", F.lit(True)).join(results, ["bundle_id", "case_id"], "full").join(bad, "case_id", "left")
    flag = lambda test, name: F.coalesce(F.bool_or(test), F.lit(False)).alias(name)
    flags = rows.groupBy("bundle_id").agg(
        flag(F.col("bad") | F.col("required").isNull(), "invalid"), flag(~F.col("current"), "obsolete"), flag(F.col("outcome") == "fail", "failed"), flag(F.col("outcome") == "blocked", "blocked"), flag(F.col("outcome").isNull(), "incomplete")
    )
    status = F.lit("PASS")
    for name in ("incomplete", "blocked", "failed", "obsolete", "invalid"):
        status = F.when(F.col(name), name.upper()).otherwise(status)
    return flags.select("bundle_id", status.alias("status"))
