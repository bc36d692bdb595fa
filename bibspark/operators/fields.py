"""Schema-driven validation: user-defined fields become typed rules on a long table of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import dates, digest, identity, text

KINDS = ("text", "long-text", "integer", "decimal", "boolean", "date", "date-time", "edtf", "identifier", "uri", "language-code", "media-type", "checksum", "controlled-term", "record-reference", "agent-reference")
LARGEST = 1_000_000_000_000
ARCHIVE = {"most": {"long-text": 8192}, "text": 2048, "values": 250}
SERVICE = {"most": {"long-text": 4000}, "text": 1000, "values": 100}


def value_problem(kind: Column, s: Column, n: Column, b: Column, repeatable: Column, vocabulary: Column, limits=ARCHIVE) -> Column:
    """First reason why one value breaks its field's kind, or null.

    A boolean stands in b, numbers in n, all others in s. Reasons: type, range, empty, canonical, length, line-break,
    format-control, shape, vocabulary."""
    number = kind.isin("integer", "decimal")
    is_text = ~number & (kind != "boolean")
    most = F.when(kind == "long-text", limits["most"]["long-text"]).otherwise(limits["text"])
    shape = (
        F.when(kind == "date", dates.is_calendar_date(s))
        .when(kind == "date-time", dates.is_instant(s))
        .when(kind == "edtf", dates.is_edtf(s))
        .when(kind == "uri", identity.url_problem(s).isNull())
        .when(kind == "language-code", text.is_language_tag(s))
        .when(kind == "media-type", text.is_media_type(s))
        .when(kind == "checksum", text.is_checksum(s))
        .when(kind.isin("record-reference", "agent-reference"), text.is_safe_id(s))
        .otherwise(True)
    )
    return text.first_reason(
        ((kind == "boolean") & b.isNull() | number & n.isNull() | is_text & s.isNull(), "type"),
        (number & (F.isnan(n) | (F.abs(n) > LARGEST)) | (kind == "integer") & (n != F.floor(n)), "range"),
        (is_text & (s == ""), "empty"),
        (is_text & (s != text.clean_text(s)), "canonical"),
        (is_text & s.rlike(text.CONTROL), "control"),
        (is_text & (F.length(s) > most), "length"),
        (is_text & (repeatable | (kind == "identifier")) & s.contains("\n"), "line-break"),
        ((kind == "identifier") & text.has_format_control(s), "format-control"),
        (is_text & ~shape, "shape"),
        ((kind == "controlled-term") & (F.size(vocabulary) > 0) & ~F.array_contains(vocabulary, s), "vocabulary"),
    )


def typed_value_violations(values: DataFrame, fields: DataFrame, limits=ARCHIVE) -> DataFrame:
    """(unit_id, field_id, value_index, problem): unknown fields and values that break their field's kind.

    values: (unit_id, schema_id, field_id, value_index, s, n, b); fields: (schema_id, field_id, kind, repeatable,
    vocabulary), small, so Spark broadcasts it by its size."""
    c = F.col
    joined = values.join(fields, ["schema_id", "field_id"], "left")
    problem = F.when(c("kind").isNull(), "unknown-field").otherwise(value_problem(c("kind"), c("s"), c("n"), c("b"), c("repeatable"), c("vocabulary"), limits))
    return joined.select("unit_id", "field_id", "value_index", problem.alias("problem")).where("problem is not null")


def repeat_violations(values: DataFrame, fields: DataFrame, limits=ARCHIVE) -> DataFrame:
    """(unit_id, field_id, n, problem): several values of a field that does not repeat, too many, or of mixed types."""
    kind_of = F.when(F.col("b").isNotNull(), "b").when(F.col("n").isNotNull(), "n").otherwise("s")
    groups = values.groupBy("unit_id", "schema_id", "field_id").agg(F.count("*").alias("n_values"), F.count_distinct(kind_of).alias("types"))
    joined = groups.join(fields.select("schema_id", "field_id", "repeatable"), ["schema_id", "field_id"])
    problem = text.first_reason((~F.col("repeatable") & (F.col("n_values") > 1), "repeat"), (F.col("n_values") > limits["values"], "too-many"), (F.col("types") > 1, "mixed-types"))
    return joined.select("unit_id", "field_id", "n_values", problem.alias("problem")).where("problem is not null")


def missing_required(units: DataFrame, values: DataFrame, fields: DataFrame) -> DataFrame:
    """(unit_id, field_id) of required fields without a value."""
    wanted = units.select("unit_id", "schema_id").join(fields.where("required").select("schema_id", "field_id"), "schema_id")
    return wanted.join(values.select("unit_id", "field_id").distinct(), ["unit_id", "field_id"], "left_anti").select("unit_id", "field_id")


def vocabulary_violations(values: DataFrame, terms: DataFrame) -> DataFrame:
    """Values of fields with a vocabulary (terms: schema_id, field_id, term) that are none of its terms."""
    bound = values.join(terms.select("schema_id", "field_id").distinct(), ["schema_id", "field_id"], "left_semi")
    return bound.join(terms.withColumnRenamed("term", "s"), ["schema_id", "field_id", "s"], "left_anti").select("unit_id", "field_id", "s")


def schema_problems(fields: DataFrame) -> DataFrame:
    """(schema_id, problem, detail) of field definitions: duplicate or unsafe ids, unknown kinds, vocabularies, mappings.

    fields: (schema_id, field_id, label, kind, required, repeatable, vocabulary, map_ead, map_aspace, map_atom, map_ric)"""
    c = F.col
    of = lambda rows, problem, detail: rows.select("schema_id", F.lit(problem).alias("problem"), detail.alias("detail"))
    ids = fields.groupBy("schema_id", "field_id").agg(F.count("*").alias("n")).where("n > 1")
    maps = fields.select("schema_id", F.explode(F.create_map(*[x for t in ("ead", "aspace", "atom", "ric") for x in (F.lit(t), F.col(f"map_{t}"))])).alias("target", "mapping")).where("mapping <> ''")
    repeated = maps.groupBy("schema_id", "target", F.lower("mapping").alias("mapping")).agg(F.count("*").alias("n")).where("n > 1")
    bad_terms = (F.size("vocabulary") > 250) | (F.size(F.array_distinct("vocabulary")) < F.size("vocabulary")) | F.exists("vocabulary", lambda v: v.contains("\n") | (v == ""))
    return (
        of(ids, "duplicate-field", c("field_id"))
        .unionByName(of(fields.where(~text.is_safe_id(c("field_id"))), "unsafe-field", c("field_id")))
        .unionByName(of(fields.where(~c("kind").isin(*KINDS)), "unknown-kind", c("field_id")))
        .unionByName(of(fields.where(bad_terms), "vocabulary", c("field_id")))
        .unionByName(of(repeated, "duplicate-mapping", F.concat_ws(":", "target", "mapping")))
    )


def unit_problems(units: DataFrame, schemas: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(unit_id, problem): unit id, schema, version, level, parent, language and instants. All problems, not the first.

    schemas: (schema_id, version, record_type)"""
    c = F.col
    known = schemas.select("schema_id", F.col("version").alias("current"), "record_type")
    rows = units.join(known, "schema_id", "left")
    tests = [
        ("schema-missing", c("current").isNull()),
        ("schema-version", c("current") != c("schema_version")),
        ("level", ~c("level").isin(*levels)),
        ("not-hierarchical", (c("record_type") != "description") & ((c("level") != "other") | c("parent_id").isNotNull())),
        ("self-parent", c("parent_id") == c("unit_id")),
        ("language", ~text.is_language_tag(c("language"))),
        ("instants", c("updated_at") < c("created_at")),
        ("unsafe-id", ~text.is_safe_id(c("unit_id"))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    one = rows.select("unit_id", F.explode(found).alias("problem"))
    twice = units.groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1").select("unit_id", F.lit("duplicate-id").alias("problem"))
    return one.unionByName(twice)


def duplicate_reference_codes(values: DataFrame) -> DataFrame:
    """(s, n): reference codes that distinct units share."""
    return values.where("field_id = 'reference_code'").groupBy("schema_id", "s").agg(F.count_distinct("unit_id").alias("n")).where("n > 1")


def structure_digest(fields: DataFrame) -> DataFrame:
    """(schema_id, digest) of everything that records depend on: field ids, kinds and flags, not labels."""
    rows = fields.select("schema_id", digest.row_digest(["field_id", "kind", "required", "repeatable"]).alias("d"))
    return rows.groupBy("schema_id").agg(digest.multiset_digest(F.col("d")).alias("digest"))
