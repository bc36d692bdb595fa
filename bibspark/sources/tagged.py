"""RIS and MARC mnemonic files: lines to fields in long form, then canonical records; broken files go to quarantine.

A file is one row (path, text); its lines are split in-engine, and one record is one group of its own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions import formats, identity
from bibspark.functions.text import first_reason
from bibspark.operators.tables import stage
from bibspark.sources.canonical import finish, first_of, in_order

TAG = r"^([A-Z0-9]{2}) {2}- ?(.*)$"
FIELD = r"^=(LDR|\d{3}) {2}(.*)$"


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\n$", ""), "\n")).alias("line_no", "line"))


def _numbered(files: DataFrame, before: str) -> DataFrame:
    """(path, ordinal, pos, line): records by splitting each file's text where `before` matches."""
    body = F.regexp_replace("text", r"\r\n?", "\n")
    parts = F.filter(F.split(body, before), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(""))) != "")
    records = files.select("path", F.posexplode(parts).alias("ordinal", "body"))
    return records.select("path", (F.col("ordinal") + 1).alias("ordinal"), F.posexplode(F.filter(F.split("body", "\n"), lambda x: x != "")).alias("pos", "line"))


def ris_fields(files: DataFrame) -> DataFrame:
    """(path, ordinal, pos, code, value) of all tagged lines; code is null on lines that are not tagged."""
    rows = _numbered(files, r"(?m)^ER {2}-[ \t]*$")
    ok = F.col("line").rlike(TAG)
    return rows.select("path", "ordinal", "pos", F.when(ok, F.regexp_extract("line", TAG, 1)).alias("code"), F.when(ok, F.trim(F.regexp_extract("line", TAG, 2))).alias("value"))


def ris_quarantine(files: DataFrame) -> DataFrame:
    """(path, problem) of files with an untagged line, a record that does not begin with its one TY, a missing ER, a
    repeated ID or a blank line inside a record."""
    fields = ris_fields(files)
    records = fields.groupBy("path", "ordinal").agg(F.count_if(F.col("code").isNull()).alias("untagged"), F.count_if((F.col("code") == "TY") & (F.col("value") != "")).alias("ty"), F.min_by("code", "pos").alias("head"), F.count_if(F.col("code") == "ID").alias("ids"))
    per_file = records.groupBy("path").agg(F.max("untagged").alias("untagged"), F.bool_or((F.col("ty") != 1) | (F.col("head") != "TY")).alias("ty"), F.max("ids").alias("ids"))
    body = F.regexp_replace("text", r"\r\n?", "\n")
    shape = files.select("path", (~body.rlike(r"(?s)(^|.*\n)ER {2}-[ \t]*\n*$")).alias("open"), body.rlike(r"(?m)^(?!ER {2}-)[A-Z0-9]{2} {2}-.*\n\n").alias("blank"))
    rows = shape.join(per_file, "path", "left")
    problem = first_reason((F.col("open"), "missing-end"), (F.col("blank"), "blank-inside"), (F.col("untagged") > 0, "untagged-line"), (F.col("ty"), "type-first-once"), (F.col("ids") > 1, "repeated-id"))
    return rows.select("path", problem.alias("problem")).where("problem is not null")


def read_ris(files: DataFrame) -> DataFrame:
    """Canonical records of all files that are not in quarantine."""
    good = files.join(ris_quarantine(files), "path", "left_anti")
    f = ris_fields(good)
    code, value = F.col("code"), F.col("value")
    many = lambda *codes: in_order(code.isin(*codes), value)
    issn = value.rlike(r"(?i)^\d{4}-?\d{3}[\dX]$")
    ident = F.struct(F.when(code == "DO", "doi").when(issn, "issn").otherwise("isbn").alias("scheme"), value.alias("value"))
    rows = f.groupBy("path", "ordinal").agg(
        first_of(["ID"]).alias("id"),
        first_of(["TI", "T1", "CT"]).alias("title"),
        many("AU", "A1").alias("creators"),
        many("A2").alias("contributors"),
        many("KW").alias("subjects"),
        many("N1").alias("notes"),
        many("UR").alias("links"),
        in_order(code.isin("DO", "SN"), ident).alias("identifiers"),
        F.coalesce(F.max(F.when(code == "M3", formats.exact_format(value))), F.max(F.when(code == "TY", formats.format_from_ris(value)))).alias("format"),
        first_of(["ET"]).alias("edition"),
        first_of(["PY", "Y1"]).alias("issued"),
        first_of(["PB"]).alias("publisher"),
        first_of(["CY"]).alias("place"),
        first_of(["LA"]).alias("language"),
        first_of(["AB", "N2"]).alias("abstract"),
        first_of(["C1"]).alias("rights"),
        first_of(["T3"]).alias("series"),
        first_of(["T2", "JO", "JF"]).alias("container_title"),
        first_of(["VL"]).alias("volume"),
        first_of(["IS"]).alias("issue"),
        F.concat_ws("–", F.nullif(first_of(["SP"]), F.lit("")), F.nullif(first_of(["EP"]), F.lit(""))).alias("pages"),
    )
    return finish(rows, "ris")


def marc_fields(files: DataFrame) -> DataFrame:
    """(path, ordinal, pos, tag, indicators, body) of all lines; tag is null on malformed ones."""
    rows = _numbered(files, r"(?m)(?=^=LDR {2})")
    ok = F.col("line").rlike(FIELD)
    body = F.regexp_extract("line", FIELD, 2)
    tag = F.when(ok, F.regexp_extract("line", FIELD, 1))
    data = ~tag.rlike("^(LDR|00[1-9])$")
    return rows.select("path", "ordinal", F.col("pos").alias("field"), tag.alias("tag"), F.when(data, F.regexp_replace(F.substring(body, 1, 2), r"[\\ ]", "#")).alias("indicators"), F.when(data, F.substring(body, 3, 1 << 30)).otherwise(body).alias("body"))


def marc_subfields(fields: DataFrame) -> DataFrame:
    """Fields with one row per subfield (code, value, pos), empty values left out; control fields have no code."""
    parts = F.regexp_extract_all("body", F.lit(r"\$([a-z0-9](?:\\[$\\]|[^$])*)"), F.lit(1))
    data = fields.where(~F.col("tag").rlike("^(LDR|00[1-9])$")).select("path", "ordinal", "field", "tag", "indicators", F.posexplode(parts).alias("sub", "part"))
    values = data.select("path", "ordinal", "field", "tag", "indicators", F.substring("part", 1, 1).alias("code"), F.trim(F.regexp_replace(F.expr("substring(part, 2)"), r"\\([$\\])", "$1")).alias("value"), (F.col("field") * 1000 + F.col("sub")).alias("pos"))
    control = fields.where(F.col("tag").rlike("^(LDR|00[1-9])$")).select("path", "ordinal", "field", "tag", F.lit("").alias("indicators"), F.lit("").alias("code"), F.col("body").alias("value"), (F.col("field") * 1000).alias("pos"))
    return control.unionByName(values).where("value <> ''")


def marc_quarantine(files: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(path, problem) of files with a bad or repeated leader, a malformed line, data without a subfield, repeated 001 or
    003, or repeated $a in one 020, 022 or 024."""
    f = marc_fields(files) if fields is None else fields
    tag = F.col("tag")
    per = f.groupBy("path", "ordinal").agg(
        F.count_if(tag.isNull()).alias("bad_line"),
        F.count_if(tag == "LDR").alias("leaders"),
        F.count_if((tag == "LDR") & ~identity.is_marc_leader(F.col("body"))).alias("bad_leader"),
        F.count_if(~tag.rlike("^(LDR|00[1-9])$") & (~F.col("body").startswith("$") | tag.rlike("^00"))).alias("no_subfield"),
        F.count_if(tag == "001").alias("n001"),
        F.count_if(tag == "003").alias("n003"),
    )
    twice = marc_subfields(f).where("tag in ('020', '022', '024') and code = 'a'").groupBy("path", "ordinal", "field").count().where("count > 1").select("path").distinct().withColumn("twice", F.lit(True))
    per_file = per.groupBy("path").agg(*(F.max(c).alias(c) for c in ("bad_line", "bad_leader", "no_subfield", "n001", "n003")), F.bool_or(F.col("leaders") != 1).alias("leader"))
    rows = per_file.join(twice, "path", "left")
    problem = first_reason((F.col("leader"), "one-leader"), (F.col("bad_leader") > 0, "bad-leader"), (F.col("bad_line") > 0, "malformed-line"), (F.col("no_subfield") > 0, "no-subfield"), ((F.col("n001") > 1) | (F.col("n003") > 1), "repeated-control"), (F.col("twice"), "repeated-a"))
    return rows.select("path", problem.alias("problem")).where("problem is not null")


def marc_records(sub: DataFrame, family: str) -> DataFrame:
    """Canonical records of MARC subfields (path, ordinal, field, tag, indicators, code, value, pos)."""
    tag, code, value = F.col("tag"), F.col("code"), F.col("value")
    key = F.concat_ws("$", tag, F.nullif(code, F.lit("")))
    names = sub.where("tag in ('700', '720')").groupBy("path", "ordinal", "field").agg(F.min(F.when(code == "a", value)).alias("name"), F.lower(F.min(F.when(code == "e", value))).alias("role"), F.min("pos").alias("pos"))
    is_creator = F.coalesce(F.col("role").rlike("^(author|creator|composer|artist)$"), F.lit(False))
    people = names.where("name is not null").groupBy("path", "ordinal").agg(in_order(is_creator, F.col("name")).alias("more_creators"), in_order(~is_creator, F.col("name")).alias("contributors"))
    f655 = sub.where("tag = '655'").groupBy("path", "ordinal", "field").agg(F.min(F.when(code == "a", value)).alias("a"), F.max(F.lower(F.when(code == "2", value))).alias("source"), F.min("pos").alias("pos"))
    local = F.coalesce(F.col("source") == "local", F.lit(False))
    genres = f655.groupBy("path", "ordinal").agg(in_order(local, F.col("a")).alias("declared"), in_order(~local, F.col("a")).alias("genres"))
    f024 = sub.where("tag = '024'").groupBy("path", "ordinal", "field").agg(F.min("indicators").alias("ind"), F.min(F.when(code == "a", value)).alias("a"), F.coalesce(F.min(F.when(code == "2", value)), F.lit("")).alias("source"), F.min("pos").alias("pos"))
    other = f024.where("a is not null").select("path", "ordinal", "pos", identity.marc024_scheme(F.substring("ind", 1, 1), F.col("source")).alias("scheme"), F.col("a").alias("value"))
    plain = sub.where("tag in ('020', '022') and code = 'a'").select("path", "ordinal", "pos", F.when(tag == "020", "isbn").otherwise("issn").alias("scheme"), F.when(tag == "020", identity.without_qualifier(value)).otherwise(value).alias("value"))
    idents = plain.unionByName(other).groupBy("path", "ordinal").agg(in_order(F.lit(True), F.struct("scheme", "value")).alias("identifiers"))
    rows = sub.withColumn("key", key)
    one = lambda *keys: first_of(list(keys), "key")
    many = lambda k: in_order(F.col("key") == k, value)
    base = rows.groupBy("path", "ordinal").agg(
        one("001").alias("id"),
        F.array_join(in_order(F.col("key").isin("245$a", "245$b"), value), " ").alias("title"),
        many("100$a").alias("main"),
        one("LDR").alias("leader"),
        one("008").alias("fixed"),
        one("336$b").alias("c336"),
        one("338$b").alias("c338"),
        one("999$a").alias("c999"),
        many("999$s").alias("status"),
        many("852$x").alias("holding_note"),
        many("856$u").alias("links"),
        one("250$a").alias("edition"),
        one("852$b").alias("location"),
        one("264$c", "260$c").alias("issued"),
        one("264$b", "260$b").alias("publisher"),
        one("264$a", "260$a").alias("place"),
        one("041$a").alias("language"),
        many("650$a").alias("subjects"),
        one("520$a").alias("abstract"),
        one("300$a").alias("extent"),
        many("500$a").alias("notes"),
    )
    none = F.array().cast("array<string>")
    joined = base.join(people, ["path", "ordinal"], "left").join(genres, ["path", "ordinal"], "left").join(idents, ["path", "ordinal"], "left")
    trace = F.create_map(F.lit("336$b"), F.col("c336"), F.lit("338$b"), F.col("c338"), F.lit("999$a"), F.col("c999"), F.lit("LDR/06"), F.substring("leader", 7, 1), F.lit("LDR/07"), F.substring("leader", 8, 1))
    out = joined.withColumns(
        {
            "creators": F.concat("main", F.coalesce("more_creators", none)),
            "contributors": F.coalesce("contributors", none),
            "genres": F.coalesce("genres", none),
            "identifiers": F.coalesce("identifiers", F.array().cast("array<struct<scheme:string,value:string>>")),
            "format": formats.format_from_marc(trace, F.coalesce("genres", none), F.coalesce("declared", none)),
            "suppressed": formats.is_suppressed(F.col("status"), F.col("holding_note")) if family == "marcxml" else F.lit(False),
            "year": F.coalesce(F.nullif(F.substring("issued", 1, 4), F.lit("")), F.nullif(F.substring("fixed", 8, 4), F.lit("")), F.lit("")),
        }
    )
    return finish(out, family)


def read_marc_text(files: DataFrame) -> DataFrame:
    fields = stage(marc_fields(files), "fields")  # fields and subfields are read several times: each text is parsed once
    good = fields.join(marc_quarantine(files, fields), "path", "left_anti")
    return marc_records(stage(marc_subfields(good), "subfields"), "marc-text")


def source_elements(fields: DataFrame, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """Every source field as evidence (path, ordinal, pos, code, name, value); dictionary: (code, name)."""
    return fields.join(dictionary.withColumnRenamed("code", code), code, "left").select("path", "ordinal", "pos", F.col(code).alias("code"), F.coalesce("name", code).alias("name"), "value")
