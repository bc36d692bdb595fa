"""Scalar expressions on small tables of cases."""

import pytest
from pyspark.sql import functions as F

from bibspark.functions import dates, formats, identity, text
from bibspark.operators import lists, rules
from bibspark.sources import files, tabular


def values(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def table(spark, f, cases):
    assert dict(zip(cases, values(spark, f, list(cases)), strict=True)) == cases


def test_dates(spark):
    table(spark, dates.is_calendar_date, {"2024-02-29": True, "2023-02-29": False, "2023-2-3": False, "2023-04-31": False, "0001-01-01": True, "": False})
    table(spark, dates.is_instant, {"2024-01-01T00:00:00Z": True, "2024-01-01T00:00:00.5Z": True, "2024-01-01T24:00:00Z": False, "2024-01-01T00:00:00": False, "2024-13-01T00:00:00Z": False})
    table(spark, dates.is_edtf, {"2024": True, "19XX": True, "2024-XX": True, "2024-02-30": False, "2024-13": False, "2024/2025": True, "2024/..": True, "../2024": False, "2024?": True, "[2024,2025-01]": True, "{2024}": False, "[2024, 2025]": False, "2024-XX-01": False, "": False, "1/2/3": False})


def test_identifiers(spark):
    table(spark, identity.is_isbn, {"9780306406157": True, "9780306406158": False, "0306406152": True, "080442957X": True, "08044295X7": False, "": False})
    table(spark, identity.doi_from_carrier, {"10.1234/Ab": "10.1234/ab", "doi: 10.1234/ab": "10.1234/ab", "https://doi.org/10.1234/ab": "10.1234/ab", "https://dx.doi.org/10.1234%2Fab": "10.1234/ab", "https://example.org/10.1234/ab": None, "10.12/x": None, "": None})
    table(spark, identity.without_qualifier, {"123 (pbk.)": "123", "123": "123"})
    table(spark, identity.is_marc_leader, {"00000nam a2200000 i 4500": True, "00000xam a2200000 i 4500": False, "short": False})


def test_urls(spark):
    table(
        spark,
        identity.url_problem,
        {
            "https://example.org/a": None, "http://example.org": "scheme", "nonsense": "malformed", "https://u:p@example.org/": "credentials", "https://example.org./": "trailing-dot", "https://localhost/": "private-host", "https://x.internal/": "private-host", "https://127.0.0.1/": "private-ipv4", "https://8.8.8.8/": None,
            "https://[2606:4700::1]/": None, "https://[::1]/": "private-ipv6", "https://[2001:db8::1]/": "private-ipv6", "https://[3fff::1]/": "private-ipv6", "https://intranet/": "single-label", "https://example.org/?access_key=1": "secret", "https://example.org/?a=token": None, "https://" + "a" * 2050: "length",
        },
    )
    assert values(spark, lambda v: identity.url_problem(v, template=True), ["https://example.org/{id}/x"]) == [None]


def test_text(spark):
    table(spark, text.spreadsheet_class, {"=1": "active-risk", " +1": "active-risk", "'=1": "protected", "a": "safe", "'": "safe", "": "safe"})
    table(spark, lambda v: text.unprotect_cell(text.protect_cell(v)), {"=1": "=1", "x": "x", "'=1": "'=1"})
    table(spark, lambda v: text.tsv_unescape(text.tsv_escape(v)), {"a\tb\\n\r\n": "a\tb\\n\r\n", "\\\\t": "\\\\t"})
    table(spark, text.title_key, {"Résumé, Part 1": "re sume part 1", "  ": "", "漢字": ""})
    table(spark, text.strict_boolean, {"Yes": True, "0": False, "maybe": None, "": None})
    table(spark, text.is_checksum, {"md5:" + "a" * 32: True, "sha256:" + "A" * 64: True, "md5:00": False})
    table(spark, text.is_media_type, {"text/html": True, "text/html; charset=utf-8": True, "text": False})
    assert values(spark, lambda v: text.decode_pipe_list(text.encode_pipe_list(v)), [["a|b", "c\\d"], ["x"]], "array<string>") == [["a|b", "c\\d"], ["x"]]
    assert values(spark, text.json_list, ['["a","b\\"c"]', "[1]", "x", "[]"]) == [["a", 'b"c'], None, None, []]


def test_formats(spark):
    table(spark, formats.format_from_ris, {"JOUR": "Article", "conf": "Conference paper", "X": "Other"})
    table(spark, formats.exact_format, {" online BOOK ": "Online book", "zine": None})
    table(spark, lambda v: formats.level_in(v, F.lit("")), {"Record group": "record-group", "recordgrp": "record-group", "Subfonds": "subseries", "shelf": None, "": "other", "Series of description": "series"})
    assert {r[0] for r in spark.createDataFrame([(f,) for f in formats.RECORD_FORMATS], "f string").select(formats.format_from_ris(formats.to_ris(F.col("f"))).alias("x"), "f").where("x <> f and f <> 'Archival collection'").collect()} <= {"Other"}


def test_profiles(spark):
    df = spark.createDataFrame([("<a x='1'><b><c/></b></a>",), ("<!DOCTYPE a><a/>",)], "text string")
    got = [(r.elements, r.attributes, r.max_depth, r.dtd) for r in files.xml_profile(df).collect()]
    assert got == [(3, 1, 3, False), (1, 0, 1, True)]
    df = spark.createDataFrame([('{"a": [1, {"b": 2}]}',), ('{"a": 1, "a": 2}',), ("{",)], "text string")
    assert [(r.valid, r.depth) for r in files.json_profile(df).collect()] == [(True, 3), (False, 1), (False, 1)]


def test_intake(spark):
    rows = [("a/x.ris", 5, bytearray(b"\xef\xbb\xbfTY")), ("b.ris", 0, bytearray(b"")), ("c.ris", 2, bytearray(b"\xff\xfe")), ("d.ris", 3, bytearray(b"a\x01b")), ("e.pdf", 1, bytearray(b"x")), ("f.ris", 1 << 30, bytearray(b"x"))]
    got = {r.name: r.block for r in files.intake(spark.createDataFrame(rows, "path string, length long, content binary"), most=5 << 20).collect()}
    assert got == {"x.ris": None, "b.ris": "FILE_EMPTY", "c.ris": "UTF8_INVALID", "d.ris": "CONTROL_CHARACTER", "e.pdf": "FORMAT_UNSUPPORTED", "f.ris": "FILE_TOO_LARGE"}
    kept = files.capture(spark.createDataFrame(rows[:1], "path string, length long, content binary"))
    assert files.preservation_mismatches(kept).count() == 0
    assert files.preservation_mismatches(kept.withColumn("content", F.lit(b"othe"))).first().problem == "length"


def test_headers():
    assert tabular.header_problems(["id", "Title", "title", "", "colour"]) == ["empty", "duplicate:title", "unknown:colour"]


@pytest.mark.parametrize(("page", "expected"), [(0, (1, 10)), (2, (21, 25)), (99, (21, 25)), (-5, (1, 10))])
def test_pages(spark, page, expected):
    rows = lists.page(spark.range(25), ["id"], page, 10).collect()
    assert (rows[0].start, rows[0].end) == expected and len(rows) == expected[1] - expected[0] + 1


def test_user_rule(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    found = rules.row_findings(df, F.col("id"), [rules.Rule("V_BAD", "notice", rules.once(F.col("v") == "x", F.col("v")))])
    assert [tuple(r) for r in found.collect()] == [("notice", "V_BAD", "a", "x")]


def test_unknown_keys(spark):
    assert values(spark, lambda v: rules.unknown_keys(v, ["a"]), ['{"a":1,"c":2,"b":3}', "nope"]) == [["b", "c"], []]


def test_encodings_do_not_collide(spark):
    """Separators, lengths and nulls inside values give different digests."""
    from bibspark.functions import digest
    from bibspark.operators import ledger

    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), ("\x00", None), (None, "\x00"), ("", None), (None, ""), ("-", None), ("1:a", "b"), ("a", "1:b"), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(digest.row_digest(["x", "y"]).alias("d")).distinct().count() == len(rows)
    one, two = (digest.table_digest(d, ["x", "y"]).first() for d in (df, df.repartition(5).orderBy("y")))
    assert one == two and one.rows == len(rows)
    assert digest.table_digest(df.union(df.limit(1)), ["x", "y"]).first().digest != one.digest
    assert digest.table_digest(df.limit(0), ["x", "y"]).first().rows == 0
    e = spark.createDataFrame([("l", 1, "i", "a", "b\x1fc", "d"), ("l", 1, "i", "a\x1fb", "c", "d")], "ledger_id string, sequence long, instant string, action string, target string, state_digest string").withColumn("previous_hash", F.lit("GENESIS"))
    assert e.select(ledger.event_hash().alias("h")).distinct().count() == 2


def test_pages_of_any_size(spark):
    from bibspark.operators import lists

    rows = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000)
    got = lists.page(rows, ["v"], 2, 300)
    assert sorted(r.v for r in got.collect()) == list(range(600, 900)) and got.first().total == 1000
    assert sorted(r.v for r in lists.page(rows, ["v"], 99, 300).collect()) == list(range(900, 1000))
    assert lists.page(rows.limit(0), ["v"], 3).count() == 0


def test_deep_parents(spark):
    """Parents below 32 levels, from depth columns and from nested components."""
    from bibspark.operators import hierarchy
    from bibspark.sources import xml

    rows = [("p", i, f"u{i}", i) for i in range(1, 45)] + [("p", 45, "v", 40), ("q", 1, "w", 2)]
    got = {r.unit_id: r.up for r in hierarchy.parents_by_depth(spark.createDataFrame(rows, "path string, ordinal int, unit_id string, depth int"), "path", "ordinal", "depth", "unit_id", "up").collect()}
    assert got == {**{f"u{i}": f"u{i - 1}" if i > 1 else None for i in range(1, 45)}, "v": "u39", "w": None}
    body = '<ead><archDesc id="r" level="fonds"><identificationData><unitId>R</unitId><unitTitle>T &amp; t</unitTitle></identificationData>' + "".join(f'<c id="c{i}" level="series">' for i in range(40)) + "</c>" * 40 + "</archDesc></ead>"
    units, values = xml.read_ead(spark.createDataFrame([("f", body)], "path string, text string"))
    assert {r.unit_id: r.parent_id for r in units.collect()} == {"r": None, "c0": "r", **{f"c{i}": f"c{i - 1}" for i in range(1, 40)}}
    assert {(r.field_id, r.s) for r in values.collect()} == {("reference_code", "R"), ("title", "T & t")}


def test_ragged_rows(spark, tmp_path):
    from bibspark.sources import tabular

    (tmp_path / "t.csv").write_text('id,title,format\n1,"One, ""a""",Book\n2,Two\n3,"Three\nlines",Map\n4,Four,Map,extra\n')
    assert sorted(r.id for r in tabular.read_catalog_table(spark, str(tmp_path / "t.csv")).collect()) == ["1", "3"]
    files = spark.createDataFrame([("t", (tmp_path / "t.csv").read_text()), ("ok", "a,b\n1,2\n"), ("none", "")], "path string, text string")
    assert [(r.path, r.line, r.problem) for r in tabular.csv_rejects(files).where("path = 't'").orderBy("line").collect()] == [("t", 3, "ragged"), ("t", 5, "ragged")]
    assert tabular.csv_rejects(files).where("path = 'ok'").count() == 0


def test_catalog_is_dealt_over_all_cores(spark):
    """The parts are one small file, whose records are many tasks' work."""
    from bibspark.plans import views

    assert views.catalog(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_orphans_need_no_hash_table(spark):
    from bibspark.operators import hierarchy

    units = spark.createDataFrame([("a", None), ("b", "a"), ("b", "a"), ("c", "x")], "id string, parent_id string")
    found = hierarchy.orphans(units)
    assert [tuple(r) for r in found.collect()] == [("c", "x")]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
