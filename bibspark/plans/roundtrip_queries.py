"""Registered round trips through files and texts of exchange formats, and hierarchical exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibspark.operators import hierarchy, tables
from bibspark.plans import crosswalk, dictionaries, views
from bibspark.plans.more_queries import _records
from bibspark.plans.queries import n, query
from bibspark.sources import bibtex, jsons, tabular, tagged, xml


def _folder(spark, tag: str) -> str:
    return tables.new_folder(spark, tag)


def _as_files(exported):
    """One file per record, written once: readers go over the files more than once, and names given anew could differ."""
    return tables.stage(exported.select(F.concat(F.lit("f"), F.monotonically_increasing_id()).alias("path"), F.col("out").alias("text")), "files")


def _shown(back):
    return back.select("id", "title", "format", F.size("identifiers").alias("identifiers"), F.get("links", F.lit(0)).alias("link"))


ALL = "(CASE WHEN doi IS NULL THEN 0 ELSE 1 END + CASE WHEN carrier IS NULL THEN 0 ELSE 1 END + CASE WHEN isbn2 IS NULL THEN 1 ELSE 2 END)"


@query("marc_roundtrip", f"SELECT id, title, format, {ALL} AS identifiers, link FROM catalog", "catalog")
def marc_roundtrip(spark, d):
    return _shown(tagged.read_marc_text(_as_files(crosswalk.marc_text(_records(spark, d)))))


@query("bibtex_roundtrip", "SELECT regexp_replace(id, '[^A-Za-z0-9_:-]', '-', 'g') AS id, title, format, CASE WHEN doi IS NULL THEN 1 ELSE 2 END AS identifiers, link FROM catalog", "catalog")
def bibtex_roundtrip(spark, d):
    return _shown(bibtex.read_bibtex(_as_files(crosswalk.bibtex(_records(spark, d)))))


@query("jsonld_roundtrip", f"SELECT id, title, format, {ALL} AS identifiers, link FROM catalog", "catalog")
def jsonld_roundtrip(spark, d):
    return _shown(jsons.read_jsonld(_as_files(crosswalk.jsonld(_records(spark, d)))))


@query("mods_roundtrip", f"SELECT id, title, format, {ALL} AS identifiers, link FROM catalog", "catalog")
def mods_roundtrip(spark, d):
    path = _folder(spark, "mods")
    crosswalk.write_documents(crosswalk.mods(_records(spark, d)), path, "modsxml")
    return _shown(xml.read_mods(spark, path))


@query("dc_roundtrip", "SELECT id, title, format, link FROM catalog", "catalog")
def dc_roundtrip(spark, d):
    path = _folder(spark, "dc")
    crosswalk.write_documents(crosswalk.dublin_core(_records(spark, d)), path, "dcxml")
    return _shown(xml.read_dc(spark, path)).drop("identifiers")


@query("csv_roundtrip", f"SELECT id, title, format, {ALL} AS identifiers, link FROM catalog", "catalog")
def csv_roundtrip(spark, d):
    path = _folder(spark, "csv")
    crosswalk.tabular(_records(spark, d)).write.option("header", True).option("escape", '"').csv(path)
    return _shown(tabular.read_catalog_table(spark, path))


@query(
    "source_elements",
    """SELECT code, name, CAST(n AS BIGINT) AS n FROM (SELECT 'TY' AS code, 'Type' AS name, count(*) AS n FROM catalog UNION ALL SELECT 'M3', 'Declared type', count(*) FROM catalog UNION ALL SELECT 'ID', 'Identifier', count(*) FROM catalog UNION ALL SELECT 'AU', 'Author', count(*) FROM catalog
    UNION ALL SELECT 'UR', 'Link', count(*) FROM catalog UNION ALL SELECT 'TI', 'Title', count(*) FROM catalog WHERE title <> '' UNION ALL SELECT 'DO', 'DOI', count(doi) FROM catalog UNION ALL SELECT 'SN', 'ISBN or ISSN', count(*) + count(isbn2) FROM catalog)""",
    "catalog",
)
def source_elements(spark, d):
    found = tagged.ris_fields(_as_files(crosswalk.ris(_records(spark, d))))
    return tagged.source_elements(found, dictionaries.field_names(spark, "ris")).groupBy("code", "name").agg(n("n"))


def _tree(spark, d):
    u = views.units(spark, d).where("level in ('fonds', 'series', 'file')")
    order = hierarchy.preorder(u.select("id", "parent_id")).withColumnRenamed("id", "unit_id")
    titles = u.select(F.col("id").alias("unit_id"), F.lit("title").alias("field_id"), F.lit(0).alias("value_index"), F.concat(F.lit("Unit "), "id").alias("s"))
    return u.select(F.col("id").alias("unit_id"), "parent_id", "level", F.lit(True).alias("published")), titles, order


@query("ead_export", "SELECT 'R' || r_regionkey AS root, count(DISTINCT n_nationkey) + count(c_custkey) AS components FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def ead_export(spark, d):
    out = crosswalk.ead_fragments(crosswalk.ead_components(*_tree(spark, d)))
    return out.groupBy("root").agg(F.sum(F.size(F.regexp_extract_all("out", F.lit(r"(<c )"), F.lit(1)))).alias("components"))


@query("ead_roundtrip", "SELECT id AS unit_id, parent_id, level FROM unit WHERE level IN ('fonds', 'series', 'file')", "unit")
def ead_roundtrip(spark, d):
    out = crosswalk.ead_fragments(crosswalk.ead_components(*_tree(spark, d))).select(F.col("root").alias("path"), F.col("position").alias("at"), F.col("out").alias("text"))
    return xml.read_ead_fragments(out)[0].select("unit_id", "parent_id", "level")


@query("atom_export", "SELECT id AS legacyId, coalesce(parent_id, '') AS parentId, CASE level WHEN 'fonds' THEN 'Fonds' WHEN 'series' THEN 'Series' ELSE 'File' END AS levelOfDescription, 'Unit ' || id AS title FROM unit WHERE level IN ('fonds', 'series', 'file')", "unit")
def atom_export(spark, d):
    return crosswalk.archive_table(*_tree(spark, d), "atom").select("legacyId", "parentId", "levelOfDescription", "title")


@query("aspace_export", "SELECT id AS ref_id, coalesce(parent_id, '') AS parent_ref_id, CASE level WHEN 'fonds' THEN 1 WHEN 'series' THEN 2 ELSE 3 END AS hierarchy, level FROM unit WHERE level IN ('fonds', 'series', 'file')", "unit")
def aspace_export(spark, d):
    return crosswalk.archive_table(*_tree(spark, d), "aspace").select("ref_id", "parent_ref_id", "hierarchy", "level")
