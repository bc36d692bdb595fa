"""Lossless JSON packages: archive schemas with their units, and whole snapshots with a payload digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD = "struct<field_id:string,kind:string,required:boolean,repeatable:boolean,vocabulary:array<string>>"
UNIT = "struct<id:string,parent_id:string,level:string,published:boolean,values:array<struct<field_id:string,value_index:int,s:string,n:double,b:boolean>>>"
PACKAGE = f"schema_id string, version int, fields array<{FIELD}>, units array<{UNIT}>"


def archive_packages(schemas: DataFrame, fields: DataFrame, units: DataFrame, values: DataFrame) -> DataFrame:
    """(schema_id, out): one JSON package per schema. A package holds one schema's units by its definition."""
    f = fields.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("field_id", "kind", "required", "repeatable", "vocabulary"))).alias("fields"))
    v = values.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("field_id", "value_index", "s", "n", "b"))).alias("values"))
    u = units.join(v.withColumnRenamed("unit_id", "id"), "id", "left").groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("id", "parent_id", "level", "published", "values"))).alias("units"))
    rows = schemas.join(f, "schema_id", "left").join(u, "schema_id", "left")
    return rows.select("schema_id", F.to_json(F.struct("schema_id", "version", "fields", "units"), {"ignoreNullFields": "false"}).alias("out"))


def read_packages(files: DataFrame) -> dict[str, DataFrame]:
    """schemas, fields, units and values of package files (path, text)."""
    p = files.select(F.from_json("text", PACKAGE).alias("p")).where("p.schema_id is not null")
    units = p.select("p.schema_id", F.explode_outer("p.units").alias("u")).where("u is not null")
    return {
        "schemas": p.select("p.schema_id", "p.version"),
        "fields": p.select("p.schema_id", F.inline("p.fields")),
        "units": units.select("schema_id", "u.id", "u.parent_id", "u.level", "u.published"),
        "values": units.select("schema_id", F.col("u.id").alias("unit_id"), F.inline("u.values")),
    }


def snapshot_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, line, digest): a snapshot as JSON lines, each with its digest; order does not matter."""
    out = None
    for name, rows in sorted(tables.items()):
        lines = rows.select(F.lit(name).alias("table"), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out.withColumn("digest", F.sha2("line", 256))


def read_snapshot(lines: DataFrame, table: str, schema: str) -> DataFrame:
    """One table of a snapshot's lines; lines whose digest differs are left out (see damaged_lines)."""
    good = lines.where((F.col("table") == table) & (F.sha2("line", 256) == F.col("digest")))
    return good.select(F.from_json("line", schema).alias("r")).select("r.*")


def damaged_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.sha2("line", 256) != F.col("digest")).groupBy("table").agg(F.count("*").alias("damaged"))


def ead_identity(files: DataFrame) -> DataFrame:
    """(path, document_id, agency, problem) of EAD files (path, text): exactly one document id becomes the schema id."""
    ids = F.regexp_extract_all("text", F.lit(r"(?s)<(?:\w+:)?(?:eadid|recordid|recordId)(?:\s[^<>]*)?>\s*(.*?)\s*</"), F.lit(1))
    agency = F.regexp_extract("text", r"(?s)<(?:\w+:)?(?:agencyname|agencyName)(?:\s[^<>]*)?>\s*(.*?)\s*</", 1)
    problem = F.when(F.size(ids) == 0, "no-document-id").when(F.size(ids) > 1, "several-document-ids")
    return files.select("path", F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).alias("document_id"), F.nullif(agency, F.lit("")).alias("agency"), problem.alias("problem"))


def attribute_evidence(files: DataFrame, elements: list[str]) -> DataFrame:
    """(path, pos, code, value): attributes of the named elements as source evidence, code is element@attribute."""
    names = "|".join(elements)
    tags = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(rf"<((?:\w+:)?(?:{names})\s[^<>]*?)/?>"), F.lit(1))).alias("pos", "tag"))
    attributes = F.regexp_extract_all("tag", F.lit(r"""([\w:.-]+\s*=\s*"[^"]*")"""), F.lit(1))
    rows = tags.select("path", "pos", F.regexp_extract("tag", r"^(?:\w+:)?(\w+)", 1).alias("element"), F.explode(attributes).alias("a"))
    return rows.select("path", "pos", F.concat_ws("@", "element", F.regexp_extract("a", r"^([\w:.-]+)", 1)).alias("code"), F.regexp_extract("a", r'"([^"]*)"', 1).alias("value"))
