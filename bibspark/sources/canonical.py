"""Canonical catalog records from fields in long form (path, ordinal, pos, code, value): shared by all ingest families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import formats, identity

IDENTIFIER = "array<struct<scheme:string,value:string>>"
META = ("issued", "publisher", "place", "language", "abstract", "rights", "license", "series", "container_title", "volume", "issue", "pages", "extent", "coverage")
LISTS = ("creators", "contributors", "subjects", "genres", "notes", "relations", "links")
COLUMNS = ("path", "ordinal", "id", "title", *LISTS, "year", "format", "identifiers", "availability", "edition", "location", "suppressed", *META)


def in_order(test: Column, value: Column) -> Column:
    """An aggregate: values of the fields that pass the test, by position."""
    return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", value.alias("v"))))), lambda x: x["v"])


def first_of(codes: list[str], code: str = "code") -> Column:
    """An aggregate: the first non-empty value of the first of the codes that has one."""
    found = [F.min_by(F.when((F.col(code) == c) & (F.col("value") != ""), F.col("value")), F.when((F.col(code) == c) & (F.col("value") != ""), F.col("pos"))) for c in codes]
    return F.coalesce(*found, F.lit(""))


def legacy_defaults(rows: DataFrame) -> DataFrame:
    """Archive units of older packages: published false, language en, record type description where they are missing."""
    have = set(rows.columns)
    fill = {"published": F.lit(False), "language": F.lit("en"), "record_type": F.lit("description")}
    return rows.withColumns({c: F.coalesce(c, v) if c in have else v for c, v in fill.items()})


def finish(rows: DataFrame, family: str) -> DataFrame:
    """Fills in ids, years, availability and missing columns; rows need path, ordinal and digest."""
    none, empty = F.lit(""), F.array().cast("array<string>")
    out = rows
    for c in COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(False) if c == "suppressed" else empty if c in LISTS else F.array().cast(IDENTIFIER) if c == "identifiers" else none)
    digest = F.col("digest") if "digest" in rows.columns else F.sha2("path", 256)
    out = out.withColumns({"id": F.coalesce(F.nullif("id", F.lit("")), identity.fallback_id(F.lit(family), digest, F.col("ordinal"))), "year": F.coalesce(F.nullif("year", F.lit("")), F.substring("issued", 1, 4)), "availability": formats.availability_default(F.col("availability"), F.col("links")), "location": F.coalesce(F.nullif("location", F.lit("")), F.when(F.size("links") > 0, "Online").otherwise(""))})
    return out.select(*COLUMNS)


