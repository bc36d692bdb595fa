"""Snapshots, ledgers, services, packages and reports on small tables."""

from pyspark.sql import functions as F

from bibspark.operators import fields, hierarchy, interop, ledger, lists, rules, services, snapshots, workspace
from bibspark.plans import dictionaries, reports
from bibspark.sources import packages

VALUES = "unit_id string, schema_id string, field_id string, value_index int, s string, n double, b boolean"


def test_sample_findings(spark):
    got = {(r.code, r.record_id) for r in rules.catalog_findings(dictionaries.sample_catalog(spark)).collect()}
    assert got == {("SUPPRESSION_LEAK", "S-1"), ("REQUEST_MISMATCH", "S-2"), ("FORMAT_CONFLICT", "S-3"), ("IDENTIFIER_DUPLICATE", "S-1"), ("TITLE_DUPLICATE", "S-4")}


def test_services(spark):
    d = dictionaries.service_fields(spark)
    assert d.select("schema_id").distinct().count() == 16 and len(dictionaries.AREAS) == 8
    t = dictionaries.service_template(spark, "accession", "s1").withColumns({"created_at": F.lit("2024-01-02"), "updated_at": F.lit("2024-01-01"), "title": F.lit("T")})
    bad = t.unionByName(t.withColumns({"id": F.lit("s2"), "kind": F.lit("nothing"), "state": F.lit("gone")}))
    assert {(r.id, r.problem) for r in services.record_problems(bad, d).collect()} == {("s1", "instants"), ("s2", "instants"), ("s2", "unknown-kind"), ("s2", "state")}
    v = spark.createDataFrame([("s1", "accession", "received_on", 0, "2024-02-30", None, None), ("s1", "accession", "extent", 0, "=1", None, None), ("s1", "accession", "extent", 1, "2", None, None)], VALUES)
    assert {(r.field_id, r.problem) for r in services.value_problems(v, d).collect()} == {("received_on", "shape"), ("extent", "repeat")}
    long = services.long_table(bad, v, d)
    assert {(r.id, r.field_id, r.value) for r in long.collect()} == {("s1", "received_on", "2024-02-30"), ("s1", "extent", "'=1"), ("s1", "extent", "2"), ("s2", "", "")}
    assert {r.area: r.records for r in services.rollup(t, d).collect()}["special-collections"] == 1
    assert services.states(t).first().review_or_due == 1 and services.to_json(t, v).count() == 1
    assert {r.field_id for r in fields.missing_required(t.select(F.col("id").alias("unit_id"), F.col("kind").alias("schema_id")), v, d).collect()} == {"accession_number", "source_type"}


def test_schema_rules(spark):
    t = dictionaries.archive_template(spark, "x", "dacs")
    assert fields.schema_problems(t).count() == 0 and dictionaries.archive_template(spark, "x", "blank").count() == 2
    worse = t.withColumn("map_ead", F.when(F.col("field_id") == "dates", "UnitTitle").otherwise(F.col("map_ead"))).withColumn("kind", F.when(F.col("field_id") == "note", "odd").otherwise(F.col("kind")))
    assert {(r.problem, r.detail) for r in fields.schema_problems(worse.unionByName(worse.where("field_id = 'title'"))).collect()} >= {("duplicate-mapping", "ead:unittitle"), ("unknown-kind", "note"), ("duplicate-field", "title")}
    units = spark.createDataFrame([("u", "x")], "unit_id string, schema_id string")
    assert workspace.schema_changes(t, t.where("field_id <> 'note'"), units).first().change == "refused-structure"
    assert workspace.schema_changes(t, t.withColumn("label", F.lit("l")), units).first().change == "labels"


def test_unit_rules(spark):
    schemas = spark.createDataFrame([("x", 2, "description")], "schema_id string, version int, record_type string")
    rows = [("a", "x", 2, None, "fonds", "en", "1", "2"), ("b", "x", 1, "b", "shelf", "??", "2", "1"), ("a", "y", 1, None, "fonds", "en", "1", "1")]
    u = spark.createDataFrame(rows, "unit_id string, schema_id string, schema_version int, parent_id string, level string, language string, created_at string, updated_at string")
    assert {(r.unit_id, r.problem) for r in fields.unit_problems(u, schemas, ("fonds",)).collect()} == {("b", "schema-version"), ("b", "level"), ("b", "self-parent"), ("b", "language"), ("b", "instants"), ("a", "schema-missing"), ("a", "duplicate-id")}
    v = spark.createDataFrame([("a", "x", "reference_code", 0, "R", None, None), ("b", "x", "reference_code", 0, "R", None, None)], VALUES)
    assert fields.duplicate_reference_codes(v).first().n == 2


def test_depth_limit(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i - 1:02}" if i else None) for i in range(35)], "id string, parent_id string")
    assert [(r.id, r.problem) for r in hierarchy.hierarchy_findings(chain).collect()] == [("n33", "too-deep"), ("n34", "too-deep")] or {r.id for r in hierarchy.hierarchy_findings(chain).collect()} == {"n33", "n34"}


def test_ledger_life(spark):
    w = workspace.empty_workspace(spark, "w", "2024-01-01T00:00:00Z")
    audit = w["audit"]
    audit = audit.unionByName(workspace.next_event(audit, "import", "f", F.lit("d1"), "2024-01-02T00:00:00Z")).cache()
    assert ledger.verify_ledgers(audit, spark.createDataFrame([("w", "d1")], "ledger_id string, digest string")).first().valid
    assert ledger.chain_breaks(audit.withColumn("target", F.lit("edited"))).count() >= 1
    revisions = w["revision"].unionByName(workspace.next_revision(w["revision"], "rev-2", "import", F.lit("d1"))).cache()
    assert ledger.lineage_problems(revisions).count() == 0
    f = workspace.fork(revisions, audit, "copy", "2024-01-03T00:00:00Z")
    e = f["audit"].select(workspace.prior_terminal(F.col("target")).alias("h"), "ledger_id").first()
    assert e.h == audit.where("sequence = 2").first().hash and e.ledger_id == "w/copy"
    one = ledger.checkpoints(audit)
    assert [r.status for r in ledger.verify_checkpoints(one, audit).collect()] == ["matches"]
    assert [r.status for r in ledger.verify_checkpoints(one, audit.where("sequence = 1")).collect()] == ["rolled-back"]
    problems = workspace.snapshot_problems(revisions, audit, {"t": spark.createDataFrame([(1,), (1,)], "id int")}, {"t": "id"})
    assert [(r.part, r.id, r.problem) for r in problems.collect()] == [("t", "1", "duplicate-key")]


def test_topology_and_policy(spark):
    rows = [("l", "d1", None, 1, 1), ("l", "d2", "d1", 2, 2), ("f", "d1", None, 1, 1), ("f", "d2", "d1", 2, 2), ("f", "d3", "d1", 2, 2), ("g", "d1", None, 1, 1), ("g", "d3", "d2", 3, 3)]
    t = hierarchy.topology(spark.createDataFrame(rows, "lineage_id string, digest string, predecessor_digest string, sequence long, audit_count long"))
    assert {r.lineage_id: r.status for r in t.collect()} == {"l": "valid-prefix", "f": "forked", "g": "gap"}
    terminals = spark.createDataFrame([("l", "d2", 2), ("f", "d2", 2), ("g", "d3", 3)], "lineage_id string, digest string, sequence long")
    anchors = spark.createDataFrame([("l", "d2", 2), ("f", "d2", 2), ("g", "d3", 3), ("u", "x", 1)], "lineage_id string, digest string, sequence long")
    assert {r.lineage_id: r.status for r in workspace.compare_external(t, terminals, anchors).collect()} == {"l": "trusted-match", "f": "fork", "g": "gap", "u": "indeterminate"}
    a = spark.createDataFrame([("l", 1, 1, 1, "a"), ("l", 2, 2, 3, "b"), ("l", 4, 3, 3, "c")], "lineage_id string, sequence long, generation long, audit_count long, digest string")
    assert ledger.progression_problems(a).count() == 1 and workspace.witnesses(a, "o").where("predecessor_digest is null").count() == 1
    now = spark.createDataFrame([("s", "d", 3, "o"), ("t", "d", 3, "o"), ("v", "x", 1, "o")], "id string, digest string, audit_count int, origin string")
    claims = spark.createDataFrame([("s", "d", 3, "o"), ("t", "d", 3, "p"), ("v", "d", 3, "o")], "id string, digest string, audit_count int, origin string")
    assert {r.id: r.status for r in workspace.recovery_reviews(now, claims).collect()} == {"s": "matches", "t": "other-origin", "v": "behind"}


def test_packages(spark):
    schemas = spark.createDataFrame([("x", 1)], "schema_id string, version int")
    f = dictionaries.archive_template(spark, "x", "blank")
    u = spark.createDataFrame([("a", None, "fonds", True, "x"), ("b", "a", "item", False, "x")], "id string, parent_id string, level string, published boolean, schema_id string")
    v = spark.createDataFrame([("a", "x", "title", 0, "T", None, None)], VALUES)
    out = packages.archive_packages(schemas, f, u, v).select(F.lit("p").alias("path"), F.col("out").alias("text"))
    back = packages.read_packages(out)
    assert {tuple(r) for r in back["units"].select("id", "parent_id", "level", "published", "schema_id").collect()} == {tuple(r) for r in u.collect()}
    assert back["values"].first().s == "T" and back["fields"].count() == 2
    lines = packages.snapshot_lines({"unit": u, "schema": schemas})
    assert snapshots.same_rows(packages.read_snapshot(lines, "unit", "id string, parent_id string, level string, published boolean, schema_id string"), u).first().equal
    assert packages.damaged_lines(lines.withColumn("line", F.concat("line", F.lit(" ")))).count() == 2
    one, two = workspace.state_digest({"u": u}).first().digest, workspace.state_digest({"u": u.repartition(5)}).first().digest
    assert one == two != workspace.state_digest({"u": u.limit(1)}).first().digest


def test_evidence_parts(spark):
    files = spark.createDataFrame([("f", '<ead><eadid url="x">ID1</eadid><agencyname>Ag</agencyname></ead>'), ("g", "<ead/>")], "path string, text string")
    assert {r.path: (r.document_id, r.agency, r.problem) for r in packages.ead_identity(files).collect()} == {"f": ("ID1", "Ag", None), "g": (None, None, "no-document-id")}
    assert [(r.code, r.value) for r in packages.attribute_evidence(files, ["eadid"]).collect()] == [("eadid@url", "x")]
    d = workspace.record_decisions(spark.createDataFrame([("catalog", "s", ["a"], "admit")], "source_kind string, source_sha string, entity_ids array<string>, decision string"), "t")
    cols = ["source_kind", "source_sha", "entity_ids", "decision", "instant"]
    assert workspace.broken_seals(d, cols).count() == 0 and workspace.broken_seals(d.withColumn("decision", F.lit("reject")), cols).count() == 1


def test_snapshots(spark):
    s = spark.createDataFrame([("a", 1, True, "d", "d"), ("a", 2, True, "x", "y"), ("b", 1, True, "d", "d"), ("b", 2, False, None, "y"), ("c", 5, True, "d", "d")], "id string, generation int, available boolean, digest string, header_digest string")
    assert {r.id: (r.generation, r.state) for r in snapshots.choose_active(s).collect()} == {"a": (None, "stopped"), "b": (1, "fallback"), "c": (5, "active")}
    derived = spark.createDataFrame([("r", "d", True), ("q", "e", True), ("p", "x", False), ("o", "x", True)], "name string, input_digest string, saved boolean")
    present = spark.createDataFrame([("r", "d"), ("q", "d"), ("p", "x")], "name string, digest string")
    assert {r.name: r.state for r in ledger.freshness(derived, present).collect()} == {"r": "current", "q": "stale", "p": "unsaved", "o": "not-saved"}


def test_reports(spark):
    c = dictionaries.sample_catalog(spark)
    f = rules.catalog_findings(c)
    assert reports.findings_report(f).first().severity == "error"
    assert reports.severity_rollup(f).where("severity is null").first().findings == f.count()
    gate = lists.export_gate(spark.createDataFrame([(False, False, 0, 0, True)], "synthetic boolean, blocked_evidence boolean, errors int, warnings int, ledger_valid boolean"))
    assert reports.public_projection(c, gate).count() == 5
    shut = lists.export_gate(spark.createDataFrame([(True, False, 0, 0, True)], "synthetic boolean, blocked_evidence boolean, errors int, warnings int, ledger_valid boolean"))
    assert reports.public_projection(c, shut).count() == 0
    assert {r.table: r.rows for r in reports.inventory({"c": c, "f": f}).collect()}["c"] == 6


def test_interop(spark):
    obs = spark.createDataFrame([("c1", "p", "a", "a", "a", "a", "unchanged", "none"), ("c2", "p", "a", "a", "a", "b", "unchanged", "none")], "case_id string, path string, expected string, displayed string, underlying string, reexported string, transformation string, finding string")
    assert [(r.case_id, r.problem) for r in interop.observation_problems(obs).collect()] == [("c2", "unchanged-differs")]
    report = spark.createDataFrame([("c1", "p", "loss")], "case_id string, path string, finding string")
    assert [r.side for r in interop.report_mismatches(report, obs).collect()] == ["report"]


def test_corrections(spark):
    c = dictionaries.sample_catalog(spark).withColumn("creators", F.array(F.lit("x")))
    changes = spark.createDataFrame([("S-1", "Better", None), ("S-6", "Fixed", True), ("S-9", "None", None), ("S-4", None, None)], "id string, title string, suppressed boolean")
    after, refused = workspace.correct_records(c, changes)
    assert {r.id: r.reason for r in refused.collect()} == {"S-1": "SUPPRESSION_LEAK", "S-6": "SUPPRESSION_LEAK", "S-9": "no-record"}
    ok = spark.createDataFrame([("S-6", "Fixed")], "id string, title string")
    assert {r.id: r.title for r in workspace.correct_records(c, ok)[0].collect()}["S-6"] == "Fixed"
    assert after.count() == 6
    config = spark.createDataFrame([("", "", "")], "resolver_base string, proxy_prefix string, member_code string")
    new, problems = workspace.change_config(config, {"member_code": "!"})
    assert problems.first().code == "MEMBER_CODE_INVALID" and new.first().member_code == ""
    assert workspace.change_config(config, {"resolver_base": "https://example.org/{id}"})[0].first().resolver_base.startswith("https")
    same = workspace.same_review(config.withColumn("id", F.lit(1)), config.withColumn("id", F.lit(1)), "id", ["member_code"])
    assert same.first().same


def test_all_members_of_a_hot_claim(spark):
    from bibspark.operators import rules

    claims = spark.createDataFrame([*((f"r{i:03}", "hot") for i in range(300)), ("a", "once"), ("b", None), ("c", ""), ("d", "")], "id string, claim string")
    got = {(r.claim, r.n, r.id) for r in rules.duplicate_rows(claims, "claim", "id").collect()}
    assert got == {("hot", 300, f"r{i:03}") for i in range(300)}


def test_topology_statuses(spark):
    """Late start, two roots, scopes, repeats, conflicts, and heads against terminals."""
    rows = [
        ("late", "a", None, 5, 1, "x"), ("roots", "a", None, 1, 1, "x"), ("roots", "b", None, 1, 1, "x"), ("scope", "a", None, 1, 1, "x"), ("scope", "b", "a", 2, 2, "y"), ("twice", "a", None, 1, 1, "x"), ("twice", "a", None, 1, 1, "x"),
        ("other", "a", None, 1, 1, "x"), ("other", "a", None, 1, 9, "x"), ("none", "b", "a", 2, 2, "x"), *((n, d, p, s, s, "x") for n in ("same", "short", "wrong", "free") for d, p, s in (("a", None, 1), ("b", "a", 2))),
    ]
    w = spark.createDataFrame(rows, "lineage_id string, digest string, predecessor_digest string, sequence long, audit_count long, origin_scope string")
    t = spark.createDataFrame([("same", "b", 2), ("short", "c", 3), ("wrong", "x", 2), ("absent", "x", 1)], "lineage_id string, digest string, sequence long")
    got = {r.lineage_id: r.status for r in hierarchy.topology(w, t).collect()}
    assert got == {"late": "gap", "roots": "forked", "scope": "boundary", "twice": "invalid", "other": "terminal-conflict", "none": "gap", "same": "corroborated", "short": "truncated", "wrong": "terminal-conflict", "free": "valid-prefix", "absent": "no-evidence"}
