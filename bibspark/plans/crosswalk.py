"""Exports: canonical records to the lines or documents of exchange formats, one string column `out` per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import formats, text
from bibspark.operators.scan import running
from bibspark.operators.tables import stage
from bibspark.sources.tabular import ASPACE, ATOM, HEADERS, LISTS, VERSION
from bibspark.sources.xml import EAD4_DID, EAD4_TEXT, EAD_DID, EAD_TEXT

NS = "urn:bibspark:"


def _col(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _date() -> Column:
    return F.coalesce(F.nullif(_col("issued"), F.lit("")), _col("year"))


def _line(prefix: str, value: Column) -> Column:
    """An array of one line, or none for an empty value."""
    v = text.plain_line(value)
    return F.when(v != "", F.array(F.concat(F.lit(prefix), v))).otherwise(F.array().cast("array<string>"))


def _lines(prefix: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit(prefix), text.plain_line(x)))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def ids_of(scheme: str) -> Column:
    return F.transform(F.filter("identifiers", lambda i: i["scheme"] == scheme), lambda i: i["value"])


def ris(records: DataFrame) -> DataFrame:
    """(id, out): a RIS record with its end line."""
    out = _joined(
        _line("TY  - ", formats.to_ris(F.col("format"))), _line("M3  - ", F.col("format")), _line("ID  - ", F.col("id")), _line("TI  - ", _col("title")), _lines("AU  - ", F.col("creators")), _lines("A2  - ", F.col("contributors")), _line("PY  - ", _date()), _line("PB  - ", _col("publisher")), _line("CY  - ", _col("place")), _line("LA  - ", _col("language")), _line("ET  - ", _col("edition")), _line("T2  - ", _col("container_title")), _line("T3  - ", _col("series")), _line("VL  - ", _col("volume")), _line("IS  - ", _col("issue")), _line("SP  - ", _col("pages")), _lines("KW  - ", F.col("subjects")), _line("AB  - ", _col("abstract")), _line("C1  - ", _col("rights")), _lines("N1  - ", F.col("notes")), _lines("DO  - ", ids_of("doi")), _lines("SN  - ", ids_of("isbn")), _lines("SN  - ", ids_of("issn")), _lines("UR  - ", F.col("links")), F.array(F.lit("ER  - ")),
    )
    return records.select("id", out.alias("out"))


def bibtex(records: DataFrame) -> DataFrame:
    field = lambda name, value: F.when(value != "", F.array(F.concat(F.lit(f"  {name} = {{"), text.bibtex_escape(value), F.lit("},")))).otherwise(F.array().cast("array<string>"))
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("{"), x, F.lit("}"))), " and ")
    raw = lambda name, value: F.when(value != "", F.array(F.concat(F.lit(f"  {name} = {{"), value, F.lit("},")))).otherwise(F.array().cast("array<string>"))
    first = lambda scheme: F.coalesce(F.get(ids_of(scheme), F.lit(0)), F.lit(""))
    key = F.regexp_replace("id", "[^A-Za-z0-9_:-]", "-")
    container = F.when(F.col("format").isin("Book chapter", "Conference paper"), field("booktitle", _col("container_title"))).otherwise(field("journal", _col("container_title")))
    body = _joined(field("title", _col("title")), field("type", F.col("format")), raw("author", names("creators")), raw("editor", names("contributors")), field("year", F.substring(_date(), 1, 4)), field("publisher", _col("publisher")), field("address", _col("place")), field("edition", _col("edition")), container, field("series", _col("series")), field("volume", _col("volume")), field("number", _col("issue")), field("pages", _col("pages")), field("doi", first("doi")), field("isbn", first("isbn")), field("issn", first("issn")), field("url", F.coalesce(F.get("links", F.lit(0)), F.lit(""))), field("keywords", F.array_join("subjects", "; ")), field("abstract", _col("abstract")), field("language", _col("language")), field("note", F.array_join("notes", "; ")))
    return records.select("id", F.concat(F.lit("@"), formats.to_bibtex(F.col("format")), F.lit("{"), key, F.lit(",\n"), body, F.lit("\n}")).alias("out"))


def csl(records: DataFrame) -> DataFrame:
    name = lambda c: F.transform(c, lambda x: F.struct(x.alias("literal")))
    none = lambda v: F.nullif(v, F.lit(""))
    first = lambda scheme: F.get(ids_of(scheme), F.lit(0))
    item = F.struct(F.col("id"), formats.to_csl(F.col("format")).alias("type"), F.col("format").alias("genre"), _col("title").alias("title"), name("creators").alias("author"), name("contributors").alias("editor"), F.struct(none(_date()).alias("literal")).alias("issued"), none(_col("publisher")).alias("publisher"), none(_col("place")).alias("publisher-place"), none(_col("language")).alias("language"), none(_col("abstract")).alias("abstract"), first("doi").alias("DOI"), first("isbn").alias("ISBN"), first("issn").alias("ISSN"), F.get("links", F.lit(0)).alias("URL"), none(_col("container_title")).alias("container-title"), none(_col("volume")).alias("volume"), none(_col("issue")).alias("issue"), none(_col("pages")).alias("page"), none(F.array_join("subjects", "; ")).alias("keyword"))
    return records.select("id", F.to_json(item).alias("out"))


def jsonld(records: DataFrame) -> DataFrame:
    person = lambda c: F.transform(c, lambda x: F.struct(F.lit("Person").alias("@type"), x.alias("name")))
    none = lambda v: F.nullif(v, F.lit(""))
    value = F.transform("identifiers", lambda i: F.struct(F.lit("PropertyValue").alias("@type"), i["scheme"].alias("propertyID"), i["value"].alias("value")))
    item = F.struct(F.lit("https://schema.org").alias("@context"), formats.to_schema(F.col("format")).alias("@type"), F.col("format").alias("additionalType"), F.concat(F.lit(NS), F.col("id")).alias("@id"), value.alias("identifier"), _col("title").alias("name"), person("creators").alias("author"), person("contributors").alias("contributor"), none(_date()).alias("datePublished"), none(_col("language")).alias("inLanguage"), F.col("subjects").alias("about"), none(_col("abstract")).alias("description"), none(_col("license")).alias("license"), F.col("links").alias("url"))
    return records.select("id", F.to_json(item).alias("out"))


def _tag(name: str, value: Column) -> Column:
    return F.when(value != "", F.array(F.concat(F.lit(f"<{name}>"), text.xml_escape(value), F.lit(f"</{name}>")))).otherwise(F.array().cast("array<string>"))


def _tags(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"<{name}>"), text.xml_escape(v), F.lit(f"</{name}>")))


def dublin_core(records: DataFrame) -> DataFrame:
    body = _joined(_tag("dc:identifier", F.concat(F.lit(NS), F.col("id"))), _tag("dc:title", _col("title")), _tags("dc:creator", F.col("creators")), _tags("dc:contributor", F.col("contributors")), _tag("dc:type", F.col("format")), _tag("dc:date", _date()), _tag("dc:publisher", _col("publisher")), _tags("dc:subject", F.col("subjects")), _tag("dc:description", _col("abstract")), _tag("dc:language", _col("language")), _tags("dc:identifier", F.transform("identifiers", lambda i: F.concat_ws(":", i["scheme"], i["value"]))), _tags("dc:identifier", F.col("links")), _tag("dc:rights", _col("rights")), _tag("dc:rights", _col("license")), _tags("dc:relation", F.col("relations")), _tag("dc:coverage", _col("coverage")))
    return records.select("id", F.concat(F.lit("<oai_dc:dc>\n"), body, F.lit("\n</oai_dc:dc>")).alias("out"))


def mods(records: DataFrame) -> DataFrame:
    name = lambda c, role: F.transform(c, lambda v: F.concat(F.lit("<name><namePart>"), text.xml_escape(v), F.lit(f'</namePart><role><roleTerm type="text">{role}</roleTerm></role></name>')))
    ident = F.transform("identifiers", lambda i: F.concat(F.lit('<identifier type="'), i["scheme"], F.lit('">'), text.xml_escape(i["value"]), F.lit("</identifier>")))
    inner = lambda *parts: F.array_join(F.flatten(F.array(*parts)), "")
    origin = F.concat(F.lit("<originInfo>"), inner(_tag("dateIssued", _date()), _tag("publisher", _col("publisher")), _tag("edition", _col("edition"))), F.lit("</originInfo>"))
    body = F.concat(F.lit("<recordInfo><recordIdentifier>"), text.xml_escape(F.col("id")), F.lit("</recordIdentifier></recordInfo><titleInfo>"), inner(_tag("title", _col("title"))), F.lit("</titleInfo>"), F.array_join(name("creators", "creator"), ""), F.array_join(name("contributors", "contributor"), ""), inner(_tag("typeOfResource", formats.to_mods(F.col("format")))), F.lit('<genre authority="local">'), text.xml_escape(F.col("format")), F.lit("</genre>"), origin, F.array_join(ident, ""), F.lit("<location>"), F.array_join(_tags("url", F.col("links")), ""), F.lit("</location>"), inner(_tag("abstract", _col("abstract"))), F.array_join(F.transform("subjects", lambda s: F.concat(F.lit("<subject><topic>"), text.xml_escape(s), F.lit("</topic></subject>"))), ""), F.array_join(_tags("note", F.col("notes")), ""))
    return records.select("id", F.concat(F.lit("<mods>"), body, F.lit("</mods>")).alias("out"))


#: Leader 06, 07, 08 and the content, media and carrier codes of each record format.
MARC_PROFILES = {
    "Article": ("a", "b", " ", "txt", "n", "nc"), "Book": ("a", "m", " ", "txt", "n", "nc"), "Online book": ("a", "m", " ", "txt", "c", "cr"), "Book chapter": ("a", "a", " ", "txt", "n", "nc"), "Conference paper": ("a", "a", " ", "txt", "n", "nc"), "Serial": ("a", "s", " ", "txt", "n", "nc"), "Newspaper": ("a", "s", " ", "txt", "n", "nc"), "Video": ("g", "m", " ", "tdi", "v", "vd"), "Audio": ("i", "m", " ", "spw", "s", "sd"), "Image": ("k", "m", " ", "sti", "n", "nb"), "Map": ("e", "m", " ", "cri", "n", "nb"), "Score": ("c", "m", " ", "ntm", "n", "nc"), "Dataset": ("m", "m", " ", "cod", "c", "cr"), "Software": ("m", "m", " ", "cop", "c", "cr"), "Website": ("m", "i", " ", "txt", "c", "cr"), "Report": ("a", "m", " ", "txt", "n", "nc"), "Thesis": ("a", "m", " ", "txt", "n", "nc"), "Manuscript": ("t", "m", " ", "txt", "n", "nc"), "Archival collection": ("p", "c", "a", "txt", "n", "nz"), "Other": ("p", "m", " ", "xxx", "x", "zu"),
}


def marc_text(records: DataFrame) -> DataFrame:
    p = lambda i: formats.lookup(F.col("format"), {k: v[i] for k, v in MARC_PROFILES.items()}, MARC_PROFILES["Other"][i])
    esc = lambda v: F.replace(F.replace(text.plain_line(v), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    one = lambda prefix, v: F.when(v != "", F.array(F.concat(F.lit(prefix), esc(v)))).otherwise(F.array().cast("array<string>"))
    many = lambda prefix, vs, suffix="": F.transform(vs, lambda v: F.concat(F.lit(prefix), esc(v), F.lit(suffix)))
    b = "\\"
    other = F.transform(F.filter("identifiers", lambda i: ~i["scheme"].isin("isbn", "issn")), lambda i: F.concat(F.lit(f"=024  7{b}$a"), esc(i["value"]), F.lit("$2"), i["scheme"]))
    leader = F.concat(F.lit("00000n"), p(0), p(1), p(2), F.lit("a2200000 i 4500"))
    out = _joined(F.array(F.concat(F.lit("=LDR  "), leader)), one("=001  ", F.col("id")), one("=245  00$a", _col("title")), many(f"=720  {b}{b}$a", F.col("creators"), "$ecreator"), many(f"=720  {b}{b}$a", F.col("contributors"), "$econtributor"), many(f"=020  {b}{b}$a", ids_of("isbn")), many(f"=022  {b}{b}$a", ids_of("issn")), other, one(f"=250  {b}{b}$a", _col("edition")), one(f"=264  {b}1$c", _date()), one(f"=336  {b}{b}$b", p(3)), one(f"=337  {b}{b}$b", p(4)), one(f"=338  {b}{b}$b", p(5)), many(f"=500  {b}{b}$a", F.col("notes")), one(f"=520  {b}{b}$a", _col("abstract")), many(f"=650  {b}4$a", F.col("subjects")), F.array(F.concat(F.lit(f"=655  {b}7$a"), esc(F.col("format")), F.lit("$2local"))), one(f"=852  {b}{b}$b", _col("location")), many("=856  40$u", F.col("links")))
    return records.select("id", out.alias("out"))


def tabular(records: DataFrame, delimiter: str = ",") -> DataFrame:
    """The 36 columns of a versioned table, all strings: write with the csv writer (header, escape='"')."""
    have = set(records.columns)
    escape = (lambda v: text.tsv_escape(text.protect_cell(v))) if delimiter == "\t" else text.protect_cell

    def cell(c: str) -> Column:
        if c == VERSION:
            return F.lit("1")
        if c not in have:
            return F.lit("[]" if c in (*LISTS, "identifiers") else "true" if c == "public_visible" else "false" if c in ("suppressed", "requestable") else "")
        value = F.to_json(c) if c in (*LISTS, "identifiers") else F.coalesce(F.col(c).cast("string"), F.lit(""))
        return escape(value)

    return records.select(*[cell(c).alias(c) for c in HEADERS])


def packet_json(columns: list[str]) -> Column:
    """A record of these columns as native JSON, source evidence left out, nulls kept."""
    top = [c for c in ("id", "title", "creators", "contributors", "year", "format", "identifiers", "links", "availability", "edition", "location", "suppressed") if c in columns]
    meta = F.struct(*[c for c in ("issued", "publisher", "place", "language", "subjects", "genres", "abstract", "rights", "license", "series", "container_title", "volume", "issue", "pages", "extent", "coverage", "relations", "notes") if c in columns])
    return F.to_json(F.struct(*top, meta.alias("metadata")), {"ignoreNullFields": "false"})


def packet(records: DataFrame) -> DataFrame:
    """(id, out): native JSON records."""
    return records.select("id", packet_json(records.columns).alias("out"))


EXPORTS = {"ris": ris, "bibtex": bibtex, "csl-json": csl, "jsonld": jsonld, "dcxml": dublin_core, "modsxml": mods, "marc-text": marc_text, "packet-json": packet}


def export(records: DataFrame, fmt: str) -> DataFrame:
    """(id, out) in one of EXPORTS; tables are made by tabular()."""
    return EXPORTS[fmt](records)


def write_lines(exported: DataFrame, path: str, separator: str = "\n\n") -> None:
    exported.select("out").write.option("lineSep", separator).text(path)


ROOTS = {"marcxml": ("<collection>", "</collection>"), "dcxml": ('<records xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">', "</records>"), "modsxml": ("<modsCollection>", "</modsCollection>")}


def write_documents(exported: DataFrame, path: str, fmt: str, per_file: int = 1000) -> None:
    """XML files of about per_file records, each a document with one root."""
    before, after = ROOTS[fmt]
    parts = max(1, exported.count() // per_file)
    rows = exported.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.array_join(F.collect_list("out"), "\n").alias("body"))
    rows.select(F.concat(F.lit(before), "body", F.lit(after))).write.option("maxRecordsPerFile", 1).text(path)


def _ead_body(vs: Column, version: str) -> Column:
    """A component's own elements."""
    e = lambda table, before="", after="": F.array_join(F.flatten(F.array(*[_element(vs, n, x, before, after) for n, x in table.items()])), "")
    wrapped = lambda name, inner: F.when(inner != "", F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))).otherwise("")
    one = lambda field, before, after: F.array_join(F.transform(F.filter(vs, lambda x: x["field_id"] == field), lambda x: F.concat(F.lit(before), text.xml_escape(x["s"]), F.lit(after))), "")
    if version == "ead4":
        did = F.concat(F.lit("<identificationData>"), e({k: v for k, v in EAD4_DID.items() if k != "repository"}), one("language", "<languageOfMaterial><language>", "</language></languageOfMaterial>"), one("repository", '<otherIdentificationData localType="repository">', "</otherIdentificationData>"), F.lit("</identificationData>"))
        agents = wrapped("agents", one("creator", "<agent><label>", "</label><role>creator</role></agent>"))
        return F.concat(did, agents, wrapped("formsAvailable", one("digital_object_uri", '<formAvailable valueURI="', '"><label>Digital object</label></formAvailable>')), e(EAD4_TEXT, "<p>", "</p>"), wrapped("subjectHeadings", one("subjects", "<subject><term>", "</term></subject>")))
    named = ("<origination><name><part>", "</part></name></origination>") if version == "ead3" else ("<origination><name>", "</name></origination>")
    dao = ('<dao daotype="derived" href="', '"/>') if version == "ead3" else ('<dao xlink:type="simple" xlink:href="', '"/>')
    did = F.concat(F.lit("<did>"), e({k: v for k, v in EAD_DID.items() if k != "creator"}), one("creator", *named), one("language", "<langmaterial><language>", "</language></langmaterial>"), one("digital_object_uri", *dao), F.lit("</did>"))
    subjects = one("subjects", *(("<controlaccess><subject><part>", "</part></subject></controlaccess>") if version == "ead3" else ("<controlaccess><subject>", "</subject></controlaccess>")))
    return F.concat(did, e(EAD_TEXT, "<p>", "</p>"), subjects)


def ead_components(units: DataFrame, values: DataFrame, order: DataFrame) -> DataFrame:
    """(root, position, depth, closes, unit_id, level, vs): what ead_fragments() writes of any version; closes: how many components end
    behind this one, itself included.

    units: (unit_id, parent_id, level, published); values: (unit_id, field_id, value_index, s); order: hierarchy.preorder
    as (unit_id, root, depth, position)."""
    v = values.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("field_id", "value_index", "s"))).alias("vs"))
    ahead = running(order.select("unit_id", "root", "depth", "position"), ["root"], [-F.col("position")], earlier={"next": F.col("depth")})
    ahead = ahead.select("unit_id", "root", "position", "depth", (F.col("depth") - F.coalesce("next", F.lit(0)) + 1).cast("int").alias("closes"))
    rows = units.select("unit_id", "level").join(v, "unit_id", "left").join(ahead, "unit_id")
    vs = F.coalesce("vs", F.array().cast("array<struct<field_id:string,value_index:int,s:string>>"))
    return stage(rows.select("root", "position", "depth", "closes", "unit_id", "level", vs.alias("vs")), "components")  # each version reads this table


def ead_fragments(components: DataFrame, version: str = "ead2002") -> DataFrame:
    """(root, position, out): nested EAD components (version: ead2002, ead3, ead4) of ead_components(), a row each: its start tag, its own
    elements, and the end tags up to the next start tag. A document is its rows' texts in order of position; none is ever one row."""
    level = formats.level_ead4(F.col("level")) if version == "ead4" else formats.level_legacy(F.col("level"))
    top = "archDesc" if version == "ead4" else "archdesc"
    first, last = F.col("depth") == 0, F.col("closes") > F.col("depth")
    tag = F.concat(F.when(first, f"<ead><{top}").otherwise("<c"), F.lit(' id="'), "unit_id", F.lit('" level="'), level, F.lit('">'))
    end = F.concat(F.repeat(F.lit("</c>"), F.when(last, F.col("closes") - 1).otherwise(F.col("closes")).cast("int")), F.when(last, f"</{top}></ead>").otherwise(""))
    return components.select("root", "position", F.concat(tag, _ead_body(F.col("vs"), version), end).alias("out"))


def ead(units: DataFrame, values: DataFrame, order: DataFrame, version: str = "ead2002") -> DataFrame:
    """(root, out): each document of ead_fragments() as one text, for small ones."""
    rows = ead_fragments(ead_components(units, values, order), version)
    return rows.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "out"))), lambda x: x["out"]), "").alias("out"))


def ead_gate(units: DataFrame, values: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """(reason, n) of what keeps units (unit_id, parent_id) out of EAD: no-root, several-roots, fields outside the core."""
    roots = units.agg(F.count_if(F.col("parent_id").isNull()).alias("n")).select(F.when(F.col("n") == 0, "no-root").when(F.col("n") > 1, "several-roots").alias("reason"), "n").where("reason is not null")
    lost = not_preservable(values, core).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("not-preservable").alias("reason"), "n")
    return roots.unionByName(lost)


def _element(vs: Column, field: str, name: str, before: str = "", after: str = "") -> Column:
    return F.transform(F.filter(vs, lambda x: x["field_id"] == field), lambda x: F.concat(F.lit(f"<{name}>{before}"), text.xml_escape(x["s"]), F.lit(f"{after}</{name}>")))


def archive_table(units: DataFrame, values: DataFrame, order: DataFrame, profile: str) -> DataFrame:
    """An archival CSV (atom or aspace) as columns, parents before children; write after orderBy(path) as is."""
    fields = ATOM if profile == "atom" else ASPACE
    lists = values.groupBy("unit_id", "field_id").agg(text.encode_pipe_list(F.transform(F.array_sort(F.collect_list(F.struct("value_index", "s"))), lambda x: x["s"])).alias("cell"))
    wide = lists.groupBy("unit_id").pivot("field_id", list(fields.values())).agg(F.first("cell"))
    rows = units.join(wide, "unit_id", "left").join(order.select("unit_id", "depth", "path"), "unit_id")
    cells = [text.protect_cell(F.coalesce(f, F.lit(""))).alias(c) for c, f in fields.items()]
    if profile == "atom":
        head = [F.col("unit_id").alias("legacyId"), F.coalesce("parent_id", F.lit("")).alias("parentId"), formats.level_atom(F.col("level")).alias("levelOfDescription"), F.when(F.col("published"), "Published").otherwise("Draft").alias("publicationStatus")]
    else:
        head = [F.col("unit_id").alias("ref_id"), F.coalesce("parent_id", F.lit("")).alias("parent_ref_id"), (F.col("depth") + 1).alias("hierarchy"), F.col("level").alias("level"), F.when(F.col("published"), "1").otherwise("0").alias("publish")]
    return rows.select("path", *head, *cells)


def dctap(fields: DataFrame) -> DataFrame:
    """A schema as an application profile: shape, property, label, mandatory, repeatable, node type, datatype."""
    datatypes = {"integer": "xsd:integer", "decimal": "xsd:decimal", "boolean": "xsd:boolean", "date": "xsd:date", "date-time": "xsd:dateTime", "edtf": "edtf:EDTF", "uri": "xsd:anyURI", "language-code": "xsd:language", "media-type": "dcterms:MediaType", "checksum": "premis:messageDigest", "record-reference": "xsd:anyURI", "agent-reference": "xsd:anyURI"}
    iri = F.col("kind").isin("uri", "record-reference", "agent-reference")
    return fields.select(F.col("schema_id").alias("shapeID"), F.col("field_id").alias("propertyID"), F.col("required").alias("mandatory"), "repeatable", F.when(iri, "IRI").otherwise("Literal").alias("valueNodeType"), formats.lookup(F.col("kind"), datatypes, "xsd:string").alias("valueDataType"), F.array_join("vocabulary", "|").alias("valueConstraint"))


def not_preservable(values: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """Populated fields that EAD cannot keep: (unit_id, field_id) of fields outside the core."""
    return values.where(~F.col("field_id").isin(*core)).select("unit_id", "field_id").distinct()
