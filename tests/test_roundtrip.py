"""Export, ingest again, compare: every exchange format keeps the fields that it can carry."""

import pytest
from pyspark.sql import functions as F

from bibspark.functions.formats import RECORD_FORMATS
from bibspark.operators import hierarchy
from bibspark.plans import crosswalk
from bibspark.sources import bibtex, jsons, tabular, tagged, xml
from bibspark.sources.canonical import IDENTIFIER, finish


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for i, f in enumerate(RECORD_FORMATS):
        rows.append(("p", i + 1, f"R{i}", f"Title {i} & <more> $5", [f"Doe, Jane {i}", "Roe"], [f"Ed {i}"], ["s one", "s two"], "2019-0" + str(i % 9 + 1), f, [("isbn", "9780306406157"), ("doi", f"10.1234/x{i}")], [f"https://example.org/{i}"], "2nd", "An abstract; with = signs"))
    df = spark.createDataFrame(rows, f"path string, ordinal int, id string, title string, creators array<string>, contributors array<string>, subjects array<string>, issued string, format string, identifiers {IDENTIFIER}, links array<string>, edition string, abstract string")
    return finish(df, "test").cache()


def texts(spark, exported, joiner):
    parts = [r.out for r in exported.orderBy("id").collect()]
    return spark.createDataFrame([("f", joiner.join(parts))], "path string, text string")


def check(before, after, fields, expected=20):
    a = {r.id: r for r in before.collect()}
    b = {r.id: r for r in after.collect()}
    assert len(b) == expected
    for i, r in b.items():
        for f in fields:
            x, y = a[i][f], r[f]
            if isinstance(x, list) and x and not isinstance(x[0], str):
                x, y = {tuple(v) for v in x}, {tuple(v) for v in y}
            assert x == y, (i, f, x, y)


KEPT = ["title", "creators", "identifiers", "links", "issued", "format"]


def test_ris(spark, records):
    files = texts(spark, crosswalk.ris(records), "\n\n")
    assert tagged.ris_quarantine(files).count() == 0
    check(records, tagged.read_ris(files), [*KEPT, "contributors", "subjects", "edition", "abstract"])


def test_ris_rejects(spark):
    bad = {"untagged": "TY  - BOOK\nhello\nER  - \n", "open": "TY  - BOOK\nTI  - x\n", "two": "TY  - BOOK\nTY  - MAP\nER  - \n", "blank": "TY  - BOOK\n\nTI  - x\nER  - \n", "good": "TY  - BOOK\nTI  - x\nER  - \n"}
    files = spark.createDataFrame(list(bad.items()), "path string, text string")
    got = {r.path: r.problem for r in tagged.ris_quarantine(files).collect()}
    assert got == {"untagged": "untagged-line", "open": "missing-end", "two": "type-first-once", "blank": "blank-inside"}
    assert tagged.read_ris(files).count() == 1


def test_marc_text(spark, records):
    files = texts(spark, crosswalk.marc_text(records), "\n\n")
    assert tagged.marc_quarantine(files).collect() == []
    check(records, tagged.read_marc_text(files), [*KEPT, "contributors", "subjects", "edition"])


def test_marc_rejects(spark):
    ldr = "=LDR  00000nam a2200000 i 4500"
    bad = {"leader": "=LDR  x\n=001  a", "twice": f"{ldr}\n=001  a\n=001  b", "line": f"{ldr}\nwhat", "sub": f"{ldr}\n=245  00title", "a": f"{ldr}\n=020  \\\\$ax$ay"}
    files = spark.createDataFrame(list(bad.items()), "path string, text string")
    got = {r.path: r.problem for r in tagged.marc_quarantine(files).collect()}
    assert got == {"leader": "bad-leader", "twice": "repeated-control", "line": "malformed-line", "sub": "no-subfield", "a": "repeated-a"}


def test_bibtex(spark, records):
    files = texts(spark, crosswalk.bibtex(records), "\n\n")
    assert bibtex.bibtex_quarantine(files).collect() == []
    check(records, bibtex.read_bibtex(files), ["title", "creators", "identifiers", "links", "format", "subjects"])


def test_bibtex_rejects(spark):
    bad = {"macro": "@string{x = {y}}", "cat": "@book{k, title = {a} # {b}}", "dup": "@book{k, title = {a}, title = {b}}", "open": "@book{k, title = {a}", "good": "@book{k, title = {A {B} c}, author = {X and Y}}"}
    files = spark.createDataFrame(list(bad.items()), "path string, text string")
    got = {r.path: r.problem for r in bibtex.bibtex_quarantine(files).collect()}
    assert set(got) == {"macro", "cat", "dup", "open"} and got["dup"] == "duplicate-field"
    r = bibtex.read_bibtex(files).first()
    assert (r.title, r.creators) == ("A B c", ["X", "Y"])


def test_csl(spark, records):
    files = texts(spark, crosswalk.csl(records), ",\n").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    check(records, jsons.read_csl(files), [*KEPT, "contributors", "subjects", "abstract"])


def test_jsonld(spark, records):
    files = texts(spark, crosswalk.jsonld(records), ",\n").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    check(records, jsons.read_jsonld(files), [*KEPT, "contributors", "subjects", "abstract"])


def test_packet(spark, records):
    files = texts(spark, crosswalk.packet(records), ",\n").withColumn("text", F.concat(F.lit('{"format_version": 1, "records": ['), "text", F.lit("]}")))
    check(records, jsons.read_packet(files), [*KEPT, "contributors", "subjects", "abstract", "edition"])
    odd = spark.createDataFrame([("f", '{"records": [{"id": "a", "extra": 1}]}')], "path string, text string")
    assert [r.key for r in jsons.packet_unknown_keys(odd).collect()] == ["extra"]


@pytest.mark.parametrize("sep", [",", "\t"])
def test_tables(spark, records, tmp_path, sep):
    out = str(tmp_path / "t")
    crosswalk.tabular(records, sep).coalesce(1).write.option("header", True).option("escape", '"').option("sep", sep).csv(out)
    check(records, tabular.read_catalog_table(spark, out, sep), [*KEPT, "contributors", "subjects", "abstract", "edition"])


def test_dublin_core(spark, records, tmp_path):
    out = str(tmp_path / "dc")
    body = "<records>" + "".join(r.out for r in crosswalk.dublin_core(records).collect()) + "</records>"
    spark.createDataFrame([(body,)], "out string").coalesce(1).write.text(out)
    check(records, xml.read_dc(spark, out), ["title", "creators", "links", "issued", "format", "subjects"])


def test_mods(spark, records, tmp_path):
    out = str(tmp_path / "mods")
    body = "<modsCollection>" + "".join(r.out for r in crosswalk.mods(records).collect()) + "</modsCollection>"
    spark.createDataFrame([(body,)], "out string").coalesce(1).write.text(out)
    check(records, xml.read_mods(spark, out), [*KEPT, "contributors", "subjects", "abstract"])


def test_marcxml(spark, tmp_path):
    body = """<collection xmlns="http://www.loc.gov/MARC21/slim"><record><leader>00000nam a2200000 i 4500</leader><controlfield tag="001">m1</controlfield>
<datafield tag="245" ind1="0" ind2="0"><subfield code="a">Main</subfield><subfield code="b">rest</subfield></datafield>
<datafield tag="020" ind1=" " ind2=" "><subfield code="a">9780306406157 (pbk.)</subfield></datafield>
<datafield tag="999" ind1=" " ind2=" "><subfield code="s">suppressed</subfield></datafield></record></collection>"""
    (tmp_path / "m.xml").write_text(body)
    r = xml.read_marcxml(spark, str(tmp_path / "m.xml")).first()
    assert (r.id, r.title, r.suppressed, r.format) == ("m1", "Main rest", True, "Book")
    assert [tuple(i) for i in r.identifiers] == [("isbn", "9780306406157")]


def test_ead_roundtrip(spark):
    text = """<ead><archdesc id="a" level="fonds"><did><unitid>F1</unitid><unittitle>Fonds &amp; co</unittitle></did><scopecontent><p>All of it</p></scopecontent>
<c id="b" level="series"><did><unittitle>S1</unittitle></did><c id="d" level="file"><did><unittitle>File</unittitle></did></c></c><c id="e" level="series" audience="internal"><did><unittitle>S2</unittitle></did></c></archdesc></ead>"""
    files = spark.createDataFrame([("f", text)], "path string, text string")
    units, values = xml.read_ead(files)
    got = {r.unit_id: (r.parent_id, r.level, r.published) for r in units.collect()}
    assert got == {"a": (None, "fonds", True), "b": ("a", "series", True), "d": ("b", "file", True), "e": ("a", "series", False)}
    order = hierarchy.preorder(units.select(F.col("unit_id").alias("id"), "parent_id")).withColumnRenamed("id", "unit_id")
    out = crosswalk.ead(units, values, order).first().out
    again, values2 = xml.read_ead(spark.createDataFrame([("f", out)], "path string, text string"))
    assert {r.unit_id: r.parent_id for r in again.collect()} == {k: v[0] for k, v in got.items()}
    assert {(r.unit_id, r.field_id, r.s) for r in values.where("s not like '%amp%'").select("unit_id", "field_id", "s").collect()} <= {(r.unit_id, r.field_id, r.s) for r in values2.collect()}


def test_archive_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ref_id,hierarchy,level,title,unit_id,publish,Odd Column\nr1,1,fonds,Top,F1,1,x\nr2,2,series,Ser,,1,\nr3,3,file,Fi,,0,\nr4,2,series,Ser2,,1,\nr5,4,item,It,,1,\n")
    units, values, fields = tabular.read_archive_table(spark, str(tmp_path / "a.csv"), "aspace")
    got = {r.unit_id: (r.parent_id, r.depth_problem) for r in units.collect()}
    assert got["r2"] == ("r1", None) and got["r3"] == ("r2", None) and got["r4"] == ("r1", None) and got["r5"][1] == "skipped-level"
    assert ("r1", "odd_column", "x") in {(r.unit_id, r.field_id, r.s) for r in values.collect()}
    assert "odd_column" in {r.field_id for r in fields.collect()}


def test_marc_texts_are_parsed_once(spark):
    """Records are put together from stored subfields, and files are named once, however often they are read."""
    from pyspark.sql import functions as F

    from bibspark.plans import roundtrip_queries
    from bibspark.sources import tagged

    files = roundtrip_queries._as_files(spark.range(1).select(F.lit("=LDR  00000nam a2200000 i 4500\n=001  a\n=245  00$at\n=720  \\\\$ax$ecreator\n").alias("out")))
    assert "monotonically" not in files._jdf.queryExecution().optimizedPlan().toString()
    back = tagged.read_marc_text(files)
    assert [(r.id, r.title, r.creators) for r in back.collect()] == [("a", "t", ["x"])]
    assert "regexp_extract_all" not in back._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_one_finding_aid_are_several_tasks_work(spark):
    """One text of many components: its parts are cut once and dealt; fields of other names are not searched, prefixes count."""
    inner = "".join(f'<e:c id="u{i}" level="file"><did><unittitle>T &lt;{i}&gt;</unittitle><e:origination><name>N {i}</name></e:origination></did></e:c>' for i in range(500))
    body = f'<ead><archdesc id="top" level="fonds"><did><unittitle>All</unittitle></did>{inner}</archdesc></ead>'
    units, values = xml.read_ead(spark.createDataFrame([("f", body)], "path string, text string"))
    assert {(r.unit_id, r.parent_id) for r in units.collect()} == {("top", None)} | {(f"u{i}", "top") for i in range(500)}
    want = {("top", "title", "All")} | {(f"u{i}", "title", f"T <{i}>") for i in range(500)} | {(f"u{i}", "creator", f"N {i}") for i in range(500)}
    assert {(r.unit_id, r.field_id, r.s) for r in values.collect()} == want
    assert values.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_ead_text_behind_components(spark):
    """What stands behind a component's children, or behind an empty one, is its own, numbered after what stands before them."""
    body = (
        '<ead><archdesc id="a" level="fonds"><did><unittitle>A</unittitle></did><odd><p>first</p></odd><dsc><c id="b" level="series"><c id="x" level="file"/>'
        '<odd><p>of b</p></odd></c><c id="d" level="file"><did><unittitle>D</unittitle></did></c></dsc><odd><p>second</p></odd><scopecontent><p>late</p></scopecontent></archdesc></ead>'
    )
    units, values = xml.read_ead(spark.createDataFrame([("f", body)], "path string, text string"))
    assert {(r.unit_id, r.parent_id, r.depth) for r in units.collect()} == {("a", None, 1), ("b", "a", 2), ("x", "b", 3), ("d", "a", 2)}
    assert {tuple(r)[1:] for r in values.select("path", "unit_id", "field_id", "value_index", "s").collect()} == {
        ("a", "title", 0, "A"), ("a", "note", 0, "first"), ("a", "note", 1, "second"), ("a", "scope_content", 0, "late"), ("b", "note", 0, "of b"), ("d", "title", 0, "D")
    }


def test_ead_fragments(spark):
    """A document is many rows, whose texts in order are the document; they are read as the whole text is."""
    rows = [("r", None, "fonds"), ("a", "r", "series"), ("b", "a", "file"), ("c", "r", "series"), ("z", "gone", "item")]
    units = spark.createDataFrame(rows, "unit_id string, parent_id string, level string").withColumn("published", F.lit(True))
    values = units.select("unit_id", F.lit("title").alias("field_id"), F.lit(0).alias("value_index"), F.concat(F.lit("T "), "unit_id").alias("s"))
    order = hierarchy.preorder(units.select(F.col("unit_id").alias("id"), "parent_id")).withColumnRenamed("id", "unit_id")
    made = crosswalk.ead_components(units, values, order)
    parts = crosswalk.ead_fragments(made, "ead4")
    assert parts.count() == 5
    got = {}
    for r in parts.orderBy("position").collect():
        got[r.root] = got.get(r.root, "") + r.out
    c = lambda i, level, inner="": f'<c id="{i}" level="{level}"><identificationData><unitTitle>T {i}</unitTitle></identificationData>{inner}</c>'
    assert got["r"] == ("<ead>" + c("r", "fonds", c("a", "series", c("b", "file")) + c("c", "series")) + "</ead>").replace('<c id="r"', '<archDesc id="r"').replace("</c></ead>", "</archDesc></ead>")
    read, told = xml.read_ead_fragments(parts.select(F.col("root").alias("path"), F.col("position").alias("at"), F.col("out").alias("text")))
    assert {(r.unit_id, r.parent_id, r.level) for r in read.collect()} == {(i, p if i != "z" else None, lev) for i, p, lev in rows}
    assert {(r.unit_id, r.s) for r in told.collect()} == {(i, f"T {i}") for i, *_ in rows}


def test_ead_versions_hold_items(spark):
    from bibspark import registry

    made = registry.QUERIES["ead_versions"](spark, "/root/testdata/sf0.001")
    assert made.where("level = 'item'").count() == 3 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
