"""XML files of any size as a stream of tags: elements with their parents, and a closed profile of what may stand where.

Files are cut at every `<`, so one large document is read by many tasks. Where a tag stands follows from running state
over the file (operators.scan): the depth is a running sum, the parent the last element opened one level higher, the
sibling before the last one below the same parent. So neither a document nor a level of it is ever one task's work.

Comments and CDATA sections may hold `<`; the opening mark of the one inside the other is not supported. Documents with
a DTD are the hostility profile's affair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.functions import formats, text
from bibspark.operators.scan import running
from bibspark.operators.tables import stage
from bibspark.sources.xml import EAD4_DID, EAD4_TEXT, EAD_DID, EAD_TEXT

TAG = r"(?s)^(?:([A-Za-z_][\w.-]*):)?([A-Za-z_][\w.-]*)((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>(.*)$"
CLOSE = r"(?s)^/(?:[\w.-]+:)?([\w.-]+)\s*>(.*)$"
ATTRIBUTE = r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"


def tag_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, split, at, piece): what stands between two `<`, in file order by split and at. Large files are read in
    ranges, each a task."""
    lines = spark.read.option("lineSep", "<").option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))


def _outside(pieces: DataFrame) -> DataFrame:
    """Pieces that are not inside a comment or CDATA section; the text behind a section's end stays with it."""
    p = F.col("piece")
    opens = p.startswith("!--") & ~p.contains("-->") | p.startswith("![CDATA[") & ~p.contains("]]>")
    mark = F.when(opens, F.lit(True)).when(p.contains("-->") | p.contains("]]>"), F.lit(False))
    return running(pieces, ["path"], ["split", "at"], earlier={"inside": mark}).where(~F.coalesce("inside", F.lit(False))).drop("inside")


def elements(pieces: DataFrame) -> DataFrame:
    """(path, pos, kind, name, prefix, attributes, depth, parent_pos, parent, tail, after_text) of tag_stream().

    kind: open, empty, close or malformed. pos numbers a file's pieces; the root has depth 1 and no parent. For a close,
    parent is the element that its tail, the text behind the tag, belongs to; that of an open is its own. after_text: text stands between
    the tag that opened the parent and this one."""
    p = F.col("piece")
    tag = lambda k: F.regexp_extract(p, TAG, k)
    close = p.startswith("/")
    rows = _outside(pieces).where((p != "") & ~p.startswith("!") & ~p.startswith("?") & ((F.col("split") > 0) | ~F.trim(p).isin("", "﻿")))
    kind = F.when(close & p.rlike(CLOSE), "close").when(close | ~p.rlike(TAG), "malformed").when(tag(4) == "/", "empty").otherwise("open")
    rows = rows.select(
        "path", "split", "at", kind.alias("kind"), F.when(close, F.regexp_extract(p, CLOSE, 1)).otherwise(tag(2)).alias("name"), F.when(close, "").otherwise(tag(1)).alias("prefix"), F.when(close, "").otherwise(tag(3)).alias("attributes"), F.when(close, F.regexp_extract(p, CLOSE, 2)).otherwise(tag(5)).alias("tail")
    )
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    told = F.when(F.col("kind") != "malformed", (F.col("kind") == "open") & _said())
    rows = running(rows, ["path"], ["split", "at"], sums={"after": step}, earlier={"after_text": told}, place="pos").drop("split", "at")
    opened = F.col("kind") == "open"
    rows = rows.withColumn("depth", F.when(F.col("kind").isin("empty", "close"), F.col("after") + 1).otherwise(F.col("after")).cast("long"))
    asks = rows.withColumns({"_level": F.when(opened, F.col("after") - 1).otherwise(F.col("after")), "_known": F.lit(None).cast("struct<pos:bigint,name:string>"), "_answer": F.lit(0)})
    answers = rows.where(opened).withColumns({"_level": F.col("after"), "_known": F.struct("pos", "name"), "_answer": F.lit(1)})
    both = running(asks.unionByName(answers), ["path", "_level"], ["pos", "_answer"], earlier={"up": F.col("_known")}).where("_answer = 0")
    return both.select("path", "pos", "kind", "name", "prefix", "attributes", "depth", F.col("up.pos").alias("parent_pos"), F.col("up.name").alias("parent"), "tail", F.coalesce("after_text", F.lit(False)).alias("after_text"))


def _said() -> Column:
    return F.trim(F.translate("tail", "\r\n\t", "   ")) != ""


def attributes(rows: DataFrame) -> DataFrame:
    """(path, pos, name, attribute, value) of elements()."""
    a = F.col("attributes")
    pairs = F.arrays_zip(*[F.regexp_extract_all(a, F.lit(ATTRIBUTE), F.lit(k)).alias(n) for k, n in enumerate(("attribute", "double", "single"), 1)])
    return rows.where("kind in ('open', 'empty')").select("path", "pos", "name", F.explode(pairs).alias("p")).select("path", "pos", "name", "p.attribute", text.xml_unescape(F.concat("p.double", "p.single")).alias("value"))


@dataclass(frozen=True)
class Shape:
    """What an element may hold: children (in this order, if ordered), those that it needs exactly once, attributes, and
    text beside children (mixed)."""

    children: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    ordered: bool = False
    once: tuple[str, ...] = ()
    mixed: bool = False


Profile = dict[str, Shape]


def ead_profile(version: str = "ead2002") -> Profile:
    """The elements that the crosswalk of EAD reads and writes, built from its tables of fields."""
    if version == "ead4":
        top, did, body, unit = "archDesc", EAD4_DID, EAD4_TEXT, "identificationData"
        inner = {"agents": ("agent",), "agent": ("label", "role"), "formsAvailable": ("formAvailable",), "formAvailable": ("label",), "subjectHeadings": ("subject",), "subject": ("term",), "languageOfMaterial": ("language",), "unitDate": ("textualDate",), "extent": ("quantity",)}
        more, extra = ("agents", "formsAvailable", "subjectHeadings"), ("languageOfMaterial",)
        own = {"language": ("languageCode",), "formAvailable": ("valueURI", "href"), "otherDescription": ("localType",), "otherIdentificationData": ("localType",)}
    else:
        top, did, body, unit = "archdesc", EAD_DID, EAD_TEXT, "did"
        names = ("name", "persname", "famname", "corpname")
        inner = {"origination": names, "physdesc": ("extent",), "langmaterial": ("language",), "repository": ("corpname", "name"), "controlaccess": ("subject", "genreform", "geogname", "occupation", "function", *names)}
        more, extra = ("controlaccess",), ("langmaterial", "dao")
        own = {"language": ("langcode",), "dao": ("daotype", "href", "xlink:type", "xlink:href")}
        if version == "ead3":
            inner |= {k: ("part",) for k in inner["controlaccess"]}
    held = (unit, *body.values(), *more, "c")
    known = ("id", "level", "otherlevel", "audience")
    out = {"ead": Shape(("control", "eadheader", top), once=(top,)), top: Shape((*held, "dsc", "descriptionOfComponents"), known), "c": Shape(held, known), "dsc": Shape(("c",), ("type",)), "descriptionOfComponents": Shape(("c",))}
    out[unit] = Shape((*dict.fromkeys(did.values()), *extra))
    for e in body.values():
        out[e] = Shape(("head", "p"), ("localtype",) if e == "odd" else own.get(e, ()), True, ("p",))
    for e in (*did.values(), *extra, *more):
        out.setdefault(e, Shape(inner.get(e, ()), own.get(e, ())))
    for names in inner.values():
        for e in names:
            out.setdefault(e, Shape(inner.get(e, ()), own.get(e, ())))
    return out | {"head": Shape(), "p": Shape()}


def _table(profile: Profile, member: str) -> Column:
    return F.create_map(*[F.lit(x) for k, s in profile.items() for x in (k, list(getattr(s, member)))]) if profile else F.create_map()


def structure_rejects(rows: DataFrame, profile: Profile, namespaces: tuple[str, ...] = ()) -> DataFrame:
    """(path, pos, problem, detail) of elements() against a profile.

    Problems: malformed; namespace (a prefix that the root does not declare, or a declaration outside `namespaces`, if any
    are given); element (unknown); child (not allowed below its parent); order (before a sibling it has to follow); count
    (a child needed once is missing or repeated); attribute; mixed-text."""
    rows = stage(rows, "elements")  # each rule reads its columns of this table; parents are not found anew for each
    children, allowed = _table(profile, "children"), _table(profile, "attributes")
    is_in = lambda member: F.col("name").isin(*[k for k, s in profile.items() if getattr(s, member)])
    own = rows.where("kind in ('open', 'empty')")
    found = [rows.where("kind = 'malformed'").select("path", "pos", F.lit("malformed").alias("problem"), F.lit("").alias("detail"))]
    declared = attributes(own.where("depth = 1")).where("attribute = 'xmlns' or attribute like 'xmlns:%'")
    prefixes = declared.groupBy(F.col("path").alias("of")).agg(F.collect_set(F.regexp_replace("attribute", "^xmlns:?", "")).alias("prefixes"))  # a row a file
    strange = own.where("prefix not in ('', 'xml')").join(prefixes, F.col("path") == F.col("of"), "left").where("not coalesce(array_contains(prefixes, prefix), false)")
    found.append(strange.select("path", "pos", F.lit("namespace"), "prefix"))
    if namespaces:
        found.append(declared.where(~F.col("value").isin(*namespaces)).select("path", "pos", F.lit("namespace"), "value"))
    known = F.col("name").isin(*profile)
    found.append(own.where(~known).select("path", "pos", F.lit("element"), "name"))
    rank = F.array_position(F.try_element_at(children, F.col("parent")), F.col("name"))
    below = own.where(known & F.col("parent").isNotNull() & F.col("parent").isin(*profile)).withColumn("rank", rank)
    found.append(below.where("rank = 0").select("path", "pos", F.lit("child"), F.concat_ws(" in ", "name", "parent")))
    ordered = below.where(F.col("parent").isin(*[k for k, s in profile.items() if s.ordered]) & (F.col("rank") > 0))
    siblings = running(ordered.select("path", "pos", "parent_pos", "name", "rank"), ["path", "parent_pos"], ["pos"], earlier={"before": F.col("rank")})
    found.append(siblings.where("rank < before").select("path", "pos", F.lit("order"), "name"))
    once = own.where(is_in("once")).select("path", "pos", F.explode(F.try_element_at(_table(profile, "once"), F.col("name"))).alias("child"))
    needed = {c for s in profile.values() for c in s.once}
    counts = own.where(F.col("name").isin(*needed)).groupBy("path", F.col("parent_pos").alias("pos"), F.col("name").alias("child")).agg(F.count("*").alias("n"))
    found.append(once.join(counts, ["path", "pos", "child"], "left").where("coalesce(n, 0) <> 1").select("path", "pos", F.lit("count"), "child"))
    a = attributes(own.where(known)).where("attribute <> 'xmlns' and attribute not like 'xmlns:%'")
    found.append(a.where(~F.array_contains(F.try_element_at(allowed, F.col("name")), F.col("attribute"))).select("path", "pos", F.lit("attribute"), F.concat_ws(" of ", "attribute", "name")))
    mixed = [k for k, s in profile.items() if s.mixed]
    beside = F.col("kind").isin("close", "empty") & _said() | F.col("kind").isin("open", "empty") & F.col("after_text")  # text behind or before a child
    both = rows.where(beside & F.col("parent_pos").isNotNull()).where(~F.col("parent").isin(*mixed) if mixed else F.lit(True))
    found.append(both.select("path", F.col("parent_pos").alias("pos"), F.lit("mixed-text"), F.col("parent").alias("name")).distinct())  # of faults alone
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


COMPONENT = r"^(archdesc|archDesc|c|c0[1-9]|c1[0-2])$"


def read_ead_files(spark: SparkSession, path: str, glob: str = "*.xml") -> tuple[DataFrame, DataFrame]:
    """(units, values) of EAD files as read_ead() gives them, for documents of any size.

    A unit's parent is the last component opened one component level higher; a value belongs to the last component opened
    at the level that is reached where it stands, and is the text of one element (and what stands below it, in order)."""
    rows = elements(tag_stream(spark, path, glob)).where("kind <> 'malformed'")
    unit = F.col("name").rlike(COMPONENT)
    step = F.when(unit & (F.col("kind") == "open"), 1).when(unit & (F.col("kind") == "close"), -1).otherwise(0)
    rows = running(rows, ["path"], ["pos"], sums={"level_now": step})
    attr = lambda name: F.coalesce(*[F.nullif(F.regexp_extract("attributes", rf"""\b{n}\s*=\s*["']([^"']*)["']""", 1), F.lit("")) for n in name], F.lit(""))
    begins = unit & F.col("kind").isin("open", "empty")
    rows = rows.withColumn("of_level", F.col("level_now") + F.when(begins & (F.col("kind") == "empty"), 1).otherwise(0))
    ids = F.coalesce(F.nullif(attr(["id"]), F.lit("")), F.concat(F.lit("c"), F.col("pos").cast("string")))
    asks = rows.withColumns({"_level": F.when(begins, F.col("of_level") - 1).otherwise(F.col("of_level")), "_known": F.lit(None).cast("string"), "_answer": F.lit(0)})
    answers = rows.where(begins & (F.col("kind") == "open")).withColumns({"_level": F.col("of_level"), "_known": ids, "_answer": F.lit(1)})
    placed = running(asks.unionByName(answers), ["path", "_level"], ["pos", "_answer"], earlier={"above": F.col("_known")}).where("_answer = 0")
    units = placed.where(begins).select("path", F.col("pos").alias("position"), ids.alias("unit_id"), F.col("above").alias("parent_id"), F.col("of_level").alias("depth"), formats.level_in(attr(["level"]), attr(["otherlevel", "otherLevel"])).alias("level"), (attr(["audience"]) != "internal").alias("published"))
    fields = {e: f for table in (EAD_DID, EAD_TEXT, EAD4_DID, EAD4_TEXT) for f, e in table.items()} | {"controlaccess": "subjects", "subject": "subjects", "langmaterial": "language", "languageOfMaterial": "language"}
    field = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    own = F.try_element_at(field, F.col("name"))
    # texts below a field's element belong to it: the last field element opened, as long as it is not closed
    opened = placed.withColumn("field", F.when(F.col("kind") == "open", own)).withColumn("shut", (F.col("kind") == "close") & own.isNotNull())
    mark = F.when(F.col("field").isNotNull(), F.struct(F.col("field").alias("field"), "pos")).when(F.col("shut"), F.struct(F.lit("").alias("field"), "pos"))
    said = running(opened, ["path"], ["pos"], earlier={"before": mark})
    here = F.when(F.col("field").isNotNull(), F.struct(F.col("field").alias("field"), "pos")).when(~F.col("shut"), F.col("before"))
    said = said.select("path", "pos", F.col("above").alias("unit_id"), here.alias("h"), "tail").where("h.field <> '' and trim(tail) <> ''")
    joined = said.groupBy("path", "unit_id", F.col("h.field").alias("field_id"), F.col("h.pos").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tail"))), lambda x: x["tail"]), " ").alias("s"))
    plain = text.xml_unescape(F.trim(F.regexp_replace("s", r"\s+", " ")))
    numbered = running(joined, ["path", "unit_id", "field_id"], ["at"], place="n")
    return units, numbered.select("path", "unit_id", "field_id", (F.col("n") - 1).cast("int").alias("value_index"), plain.alias("s")).where("s <> ''")
