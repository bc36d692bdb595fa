"""CSV and TSV: catalog tables (loose and versioned) and archival descriptions with inferred columns and depth parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bibspark.functions import formats, text
from bibspark.functions.identity import loose_identifier
from bibspark.operators.hierarchy import parents_by_depth
from bibspark.sources.canonical import IDENTIFIER, finish

VERSION = "bibspark_tabular_version"
#: The columns of a catalog table, in order.
HEADERS = (VERSION, "id", "title", "creators", "contributors", "year", "issued", "created", "modified", "format", "identifiers", "links", "publisher", "place", "language", "subjects", "genres", "abstract", "rights", "license", "series", "container_title", "volume", "issue", "pages", "extent", "audience", "coverage", "relations", "notes", "availability", "edition", "location", "suppressed", "public_visible", "requestable")
LISTS = ("creators", "contributors", "links", "subjects", "genres", "relations", "notes")


def read_cells(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text under normalised header names, with path and ordinal. Rows with too few or too many cells are
    left out; csv_rejects() tells them."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", delimiter).option("enforceSchema", False)
    header = reader.csv(path).columns
    schema = StructType([*(StructField(c, StringType()) for c in header), StructField("_corrupt_record", StringType())])
    rows = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("enforceSchema", True).csv(path)
    named = rows.where("_corrupt_record is null").drop("_corrupt_record").toDF(*[normal_header(c) for c in header])
    return named.withColumn("path", F.input_file_name()).withColumn("ordinal", (F.monotonically_increasing_id() % (1 << 33) + 1).cast("int"))


def normal_header(name: str) -> str:
    return "_".join("".join(ch if ch.isalnum() else " " for ch in name.lower()).split())


def header_problems(header: list[str], allowed: tuple[str, ...] | None = HEADERS) -> list[str]:
    """Problems of a header: empty, duplicate or unknown names."""
    names = [normal_header(h) for h in header]
    out = ["empty" for n in names if not n]
    out += [f"duplicate:{n}" for n in sorted({n for n in names if n and names.count(n) > 1})]
    return out + [f"unknown:{n}" for n in names if allowed and n and n not in allowed]


def csv_rejects(files: DataFrame, delimiter: str = ",", allowed: tuple[str, ...] | None = None) -> DataFrame:
    """(path, line, problem) of tables (path, text): ragged rows, quotes inside or after a cell, unterminated quotes, and
    headers with empty, repeated, look-alike or (with allowed) unknown names; versioned and other rows mixed.

    line counts records, 1 is the header. One pass of a tokeniser over cells and their ends."""
    d = "\\t" if delimiter == "\t" else delimiter
    cell = rf'("(?:[^"]|"")*"|[^"{d}\r\n]*)({d}|\r\n|\n|\r|$)'
    body = F.regexp_replace("text", r"[\r\n]+$", "")
    cells, ends = F.regexp_extract_all(body, F.lit(cell), F.lit(1)), F.regexp_extract_all(body, F.lit(cell), F.lit(2))
    whole = F.array_join(F.zip_with(cells, ends, lambda x, y: F.concat(x, y)), "")
    t = files.select("path", body.alias("body"), F.zip_with(cells, ends, lambda x, y: F.struct(x.alias("cell"), y.alias("end"))).alias("cells"), (whole != body).alias("broken"))
    rows = t.select(
        "path", "broken", "body",
        F.aggregate(  # after the last end the pattern matches once more, empty
            F.when((F.size("cells") > 1) & (F.element_at("cells", -1)["cell"] == "") & (F.get("cells", F.size("cells") - 2)["end"] == ""), F.slice("cells", 1, F.size("cells") - 1)).otherwise(F.col("cells")),
            F.struct(F.array().cast("array<array<string>>").alias("rows"), F.array().cast("array<string>").alias("now")),
            lambda acc, c: F.when(c["end"] == delimiter, F.struct(acc["rows"].alias("rows"), F.concat(acc["now"], F.array(c["cell"])).alias("now"))).otherwise(F.struct(F.concat(acc["rows"], F.array(F.concat(acc["now"], F.array(c["cell"])))).alias("rows"), F.array().cast("array<string>").alias("now"))),
        )["rows"].alias("rows"),
    )
    bare = lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))
    header = F.transform(F.get("rows", F.lit(0)), bare)
    names = F.transform(header, lambda h: F.regexp_replace(F.trim(F.regexp_replace(F.lower(h), r"[^\p{L}\p{N}]+", " ")), " ", "_"))
    plain = F.transform(header, lambda h: F.lower(F.regexp_replace(h, r"\p{Cf}", "")))
    quote = F.when(F.size(F.split("body", '"')) % 2 == 0, "unterminated-quote").otherwise("late-quote")
    version = F.array_position(names, VERSION).cast("int")
    found = F.concat(
        F.when(F.col("broken"), F.array(F.struct(F.lit(0).alias("line"), quote.alias("problem")))).otherwise(F.array().cast("array<struct<line:int,problem:string>>")),
        F.transform(F.filter(F.transform("rows", lambda r, i: F.struct(r.alias("r"), (i + 1).alias("line"))), lambda x: F.size(x["r"]) != F.size(F.get("rows", F.lit(0)))), lambda x: F.struct(x["line"].alias("line"), F.lit("ragged").alias("problem"))),
        F.when(F.exists(names, lambda n: n == ""), F.array(F.struct(F.lit(1).alias("line"), F.lit("empty-header").alias("problem")))).otherwise(F.array().cast("array<struct<line:int,problem:string>>")),
        F.when((F.size(F.array_distinct(names)) < F.size(names)) | (F.size(F.array_distinct(plain)) < F.size(plain)), F.array(F.struct(F.lit(1).alias("line"), F.when(F.size(F.array_distinct(header)) < F.size(header), "duplicate-header").when(F.size(F.array_distinct(plain)) < F.size(plain), "look-alike-header").otherwise("duplicate-header").alias("problem")))).otherwise(F.array().cast("array<struct<line:int,problem:string>>")),
        F.when((version > 0) & (F.size(F.array_distinct(F.transform(F.slice("rows", 2, F.size("rows")), lambda r: F.get(r, version - 1) == "1"))) > 1), F.array(F.struct(F.lit(0).alias("line"), F.lit("mixed-versions").alias("problem")))).otherwise(F.array().cast("array<struct<line:int,problem:string>>")),
        *([F.transform(F.array_except(F.filter(names, lambda n: n != ""), F.array(*map(F.lit, allowed))), lambda n: F.struct(F.lit(1).alias("line"), F.concat(F.lit("unknown-header:"), n).alias("problem")))] if allowed else []),
    )
    return rows.select("path", F.explode(found).alias("f")).select("path", "f.line", "f.problem")


def read_catalog_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Canonical records. Rows with a version have JSON list cells and protected formulas, others lists between ; or |."""
    rows = read_cells(spark, path, delimiter)
    unknown = header_problems([c for c in rows.columns if c not in ("path", "ordinal")])
    if unknown:
        raise ValueError(f"{path}: {', '.join(unknown)}")
    have = set(rows.columns)
    raw = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    versioned = raw(VERSION) == "1"
    restore = (lambda v: text.unprotect_cell(text.tsv_unescape(v))) if delimiter == "\t" else text.unprotect_cell
    cell = lambda c: F.when(versioned, restore(raw(c))).otherwise(raw(c))
    none = F.array().cast("array<string>")
    listed = {c: F.when(versioned, F.coalesce(text.json_list(cell(c)), none)).otherwise(text.split_list(cell(c))) for c in LISTS}
    loose = F.transform(text.split_list(cell("identifiers")), loose_identifier)
    idents = F.when(versioned, F.coalesce(F.from_json(cell("identifiers"), IDENTIFIER), F.array().cast(IDENTIFIER))).otherwise(loose)
    plain = [c for c in HEADERS if c not in LISTS and c not in (VERSION, "identifiers", "suppressed", "public_visible", "requestable", "format", "created", "modified", "audience")]
    out = rows.select("path", "ordinal", *[cell(c).alias(c) for c in plain], *[v.alias(c) for c, v in listed.items()], idents.alias("identifiers"), formats.format_from_text(cell("format")).alias("format"), F.coalesce(text.strict_boolean(cell("suppressed"), False), F.lit(False)).alias("suppressed"))
    return finish(out, "tsv" if delimiter == "\t" else "csv")


#: Columns of archival tables and the core fields that they fill.
ATOM = {"identifier": "reference_code", "title": "title", "eventdates": "dates", "eventactors": "creator", "extentandmedium": "extent", "scopeandcontent": "scope_content", "arrangement": "arrangement", "accessconditions": "access_conditions", "reproductionconditions": "use_conditions", "language": "language", "subjectaccesspoints": "subjects", "relatedunitsofdescription": "related_material", "digitalobjecturi": "digital_object_uri", "generalnote": "note"}
ATOM_UNIT = {"legacyid": "unit_id", "parentid": "parent_id", "levelofdescription": "level", "publicationstatus": "published", "culture": "language_tag", "eventtypes": "event_types", "qubitparentslug": "parent_slug"}
ASPACE = {"unit_id": "reference_code", "title": "title", "dates": "dates", "creators": "creator", "extents": "extent", "n_scopecontent": "scope_content", "n_arrangement": "arrangement", "n_accessrestrict": "access_conditions", "n_userestrict": "use_conditions", "n_relatedmaterial": "related_material", "digital_object_uri": "digital_object_uri", "n_odd": "note"}
ASPACE_UNIT = {"ref_id": "unit_id", "parent_ref_id": "parent_id", "hierarchy": "depth", "level": "level", "other_level": "other_level", "publish": "published", "langcode": "language_tag"}


def read_archive_table(spark: SparkSession, path: str, profile: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, values, fields) of an archival CSV; profile: atom or aspace. Unknown columns become text fields."""
    cells = read_cells(spark, path)
    fields_of, unit_of = (ATOM, ATOM_UNIT) if profile == "atom" else (ASPACE, ASPACE_UNIT)
    have = [c for c in cells.columns if c not in ("path", "ordinal")]
    custom = [c for c in have if c not in fields_of and c not in unit_of]
    raw = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    col = {v: raw(k) for k, v in unit_of.items()}
    rows = cells.where(F.lower(col["unit_id"]) != "reference id") if profile == "aspace" else cells  # an optional row of labels
    level = formats.level_in(col["level"], col.get("other_level", F.lit("")))
    base = rows.select("path", "ordinal", col["unit_id"].alias("unit_id"), F.nullif(col["parent_id"], F.lit("")).alias("parent_id"), level.alias("level"), col["published"].rlike("(?i)^(published|1|true|yes)$").alias("published"), (col["depth"].try_cast("int") if "depth" in col else F.lit(None).cast("int")).alias("depth"))
    units = depth_parents(base) if profile == "aspace" else base.drop("depth")
    lists = [F.struct(F.lit(f).alias("field_id"), text.decode_pipe_list(text.unprotect_cell(raw(c))).alias("vs")) for c, f in [*fields_of.items(), *((c, c) for c in custom)] if c in have]
    long = rows.select(col["unit_id"].alias("unit_id"), F.explode(F.array(*lists)).alias("f")).select("unit_id", "f.field_id", F.posexplode("f.vs").alias("value_index", "s")).where("s <> ''")
    kinds = spark.createDataFrame([(f, "text") for f in [*fields_of.values(), *custom]], "field_id string, kind string")
    return units, long, kinds


def depth_parents(units: DataFrame) -> DataFrame:
    """Parents from a depth column in file order: the last earlier unit one level up, at any depth. A parent id that is
    given and differs, and a level that is skipped, are told in depth_problem."""
    before = F.lag("depth").over(Window.partitionBy("path").orderBy("ordinal"))
    found = parents_by_depth(units.withColumn("before", before), "path", "ordinal", "depth", "unit_id", "above")
    rows = found.withColumn("by_depth", F.when(F.col("depth") > 1, F.col("above"))).drop("above")
    problem = text.first_reason((F.col("depth") > F.coalesce("before", F.lit(0)) + 1, "skipped-level"), (F.col("parent_id").isNotNull() & F.col("by_depth").isNotNull() & (F.col("parent_id") != F.col("by_depth")), "depth-conflict"))
    return rows.withColumn("depth_problem", problem).withColumn("parent_id", F.coalesce("parent_id", "by_depth")).drop("by_depth", "before")


def late_parents(units: DataFrame) -> DataFrame:
    """Units (path, ordinal, unit_id, parent_id) whose parent stands after them."""
    p = units.select("path", F.col("unit_id").alias("parent_id"), F.col("ordinal").alias("parent_at"))
    return units.join(p, ["path", "parent_id"]).where("parent_at > ordinal").select("path", "unit_id", "parent_id")
