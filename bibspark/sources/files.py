"""File intake: bytes, digests, text and format gates, hostility profiles, preservation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.functions.text import CONTROL, first_reason

#: Media types that go with an extension.
MEDIA = {**dict.fromkeys(("json", "jsonld"), ("application/json", "application/ld+json")), **dict.fromkeys(("xml", "marcxml"), ("application/xml", "text/xml")), **dict.fromkeys(("ris", "bib", "bibtex", "csv", "tsv", "mrk", "txt"), ("text/plain", "text/csv", "text/tab-separated-values", "application/x-bibtex", "application/x-research-info-systems"))}
EXTENSIONS = {"xml": "xml", "json": "json", "jsonld": "jsonld", "ris": "ris", "bib": "bibtex", "bibtex": "bibtex", "marcxml": "xml", "csv": "csv", "tsv": "tsv", "mrk": "marc-text", "txt": "marc-text"}


def read_files(spark: SparkSession, path: str, glob: str = "*", most: int | None = None) -> DataFrame:
    """(path, length, content). With `most`, larger files are never read: the size filter reaches the source."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.where(F.col("length") <= most) if most else rows


def intake(files: DataFrame, most: int | None = None) -> DataFrame:
    """One row per file: (path, name, length, sha256, text, format, block). block is the first reason not to parse it:
    MIME_MISMATCH, FILE_EMPTY, FILE_TOO_LARGE (with most), UTF8_INVALID, CONTROL_CHARACTER, FORMAT_UNSUPPORTED or
    XML_HOSTILE, else null. A column media_type, where files have one, is what the sender declared."""
    raw = F.col("content").cast("string")
    ok = F.is_valid_utf8(raw)
    body = F.regexp_replace(F.when(ok, raw), "^\\x{FEFF}", "")
    given = F.coalesce(F.col("media_type"), F.lit("")) if "media_type" in files.columns else F.lit("")
    rows = files.select(given.alias("media_type"), "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), ok.alias("utf8"), body.alias("text"))
    rows = rows.withColumn("format", route(F.col("name"), F.col("text")))
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[x for k, v in MEDIA.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    block = first_reason(
        ((F.col("media_type") != "") & ~F.array_contains(F.coalesce(F.try_element_at(kinds, ext), F.array().cast("array<string>")), F.col("media_type")), "MIME_MISMATCH"),
        (F.col("length") == 0, "FILE_EMPTY"),
        (F.col("length") > most if most else F.lit(False), "FILE_TOO_LARGE"),
        (~F.col("utf8"), "UTF8_INVALID"),
        (F.col("text").rlike(CONTROL), "CONTROL_CHARACTER"),
        (F.col("format").isNull(), "FORMAT_UNSUPPORTED"),
        (F.col("format").endswith("xml") & hostile_xml(F.col("text")), "XML_HOSTILE"),
    )
    return rows.withColumn("block", block).drop("utf8", "media_type")


def route(name: Column, body: Column) -> Column:
    """Exchange format by extension, then by root element or JSON shape; null if none fits."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.substring(F.ltrim(body), 1, 4096)
    xml = F.when(head.rlike(r"<(\w+:)?(collection|record)[\s>]") & head.contains("MARC21"), "marcxml").when(head.rlike(r"<oai_dc:|<dc:|<(metadata|records)[\s>]"), "dcxml").when(head.rlike(r"<(\w+:)?mods"), "modsxml").when(head.rlike(r"<(\w+:)?ead[\s>]"), "eadxml")
    json = F.when(head.contains('"@context"'), "jsonld").when(head.rlike(r'"(records|format_version)"\s*:'), "packet-json").when(head.rlike(r'^\s*[\[{]'), "csl-json")
    out = None
    for e, f in EXTENSIONS.items():
        value = xml if f == "xml" else json if f in ("json", "jsonld") else F.lit(f)
        out = F.when(ext == e, value) if out is None else out.when(ext == e, value)
    return out


def hostile_xml(body: Column) -> Column:
    """DTDs, entities and processing instructions other than the declaration."""
    return body.rlike(r"(?i)<!DOCTYPE|<!ENTITY") | body.rlike(r"<\?(?!xml[\s?])")


def xml_profile(rows: DataFrame, body: str = "text") -> DataFrame:
    """Adds elements, attributes, max_depth, dtd and instructions of markup (comments and scripts are not looked into)."""
    b = F.col(body)
    tags = F.regexp_extract_all(b, F.lit(r"<(/?[A-Za-z_][^<>]*?/?)>"), F.lit(1))
    deep = F.aggregate(
        F.col("_tags"),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, t: F.struct(
            (acc["now"] + F.when(t.startswith("/"), -1).when(t.endswith("/"), 0).otherwise(1)).cast("int").alias("now"),
            F.greatest(acc["most"], (acc["now"] + F.when(t.startswith("/"), 0).otherwise(1)).cast("int")).alias("most"),
        ),
    )
    out = rows.withColumn("_tags", tags).withColumns(
        {
            "elements": F.size(F.filter("_tags", lambda t: ~t.startswith("/"))),
            "attributes": F.aggregate("_tags", F.lit(0), lambda n, t: n + F.size(F.regexp_extract_all(t, F.lit(r"(\s[A-Za-z_:][\w:.-]*\s*=)"), F.lit(1)))),
            "max_depth": deep["most"],
            "dtd": b.rlike(r"(?i)<!DOCTYPE|<!ENTITY"),
            "instructions": b.rlike(r"<\?(?!xml[\s?])"),
        }
    )
    return out.drop("_tags")


def json_profile(rows: DataFrame, body: str = "text", deepest: int = 64) -> DataFrame:
    """Adds valid (no repeated member names either: VARIANT rejects them), depth and keys of JSON texts."""
    b = F.col(body)
    bare = F.regexp_replace(b, r'"(?:[^"\\]|\\.)*"', '""')
    marks = F.regexp_extract_all(bare, F.lit(r"([\[\]{}])"), F.lit(1))
    depth = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, m: F.struct((acc["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1)).cast("int").alias("now"), F.greatest(acc["most"], acc["now"] + F.when(m.isin("[", "{"), 1).otherwise(0)).cast("int").alias("most")),
    )["most"]
    return rows.withColumns({"valid": F.try_parse_json(b).isNotNull(), "depth": depth, "keys": F.size(F.regexp_extract_all(b, F.lit(r'("(?:[^"\\]|\\.)*"\s*:)'), F.lit(1))), "too_deep": depth > deepest})


def capture(files: DataFrame) -> DataFrame:
    """Exact bytes to preserve: (path, content, length, sha256)."""
    return files.select("path", "content", "length", F.sha2("content", 256).alias("sha256"))


def preservation_mismatches(kept: DataFrame) -> DataFrame:
    """(path, problem) of kept rows (path, content, length, sha256) whose bytes no longer agree."""
    problem = first_reason((F.octet_length("content") != F.col("length"), "length"), (F.sha2("content", 256) != F.col("sha256"), "digest"))
    return kept.select("path", problem.alias("problem")).where("problem is not null")


def join_chunks(chunks: DataFrame) -> DataFrame:
    """(path, content) of base64 chunks (path, ordinal, data)."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "data")))
    return chunks.groupBy("path").agg(F.unbase64(F.array_join(F.transform(ordered, lambda x: x["data"]), "")).alias("content"))
