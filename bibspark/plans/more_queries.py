"""More registered queries: imports, exports and round trips, profiles, roll-ups, services and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibspark.functions import formats
from bibspark.operators import fields, hierarchy, rules, services, snapshots, tables, workspace
from bibspark.plans import crosswalk, dictionaries, reports, views
from bibspark.plans.queries import FINDING, MARK, _mark, n, query
from bibspark.plans.views import table
from bibspark.sources import files, jsons, packages, tagged
from bibspark.sources.canonical import finish
from bibspark.sources.xml import unexpected_paths
from bibspark.streaming import intake


@query(
    "import_apply",
    """SELECT i.id, CASE WHEN e.id IS NULL AND c.id IS NULL AND s.id IS NULL THEN 'applied' ELSE 'not-applied' END AS outcome,
    CASE WHEN e.id IS NOT NULL THEN 'validation-failed' WHEN c.id IS NOT NULL THEN 'id-conflict' WHEN s.id IS NOT NULL THEN 'claim-conflict' ELSE 'accepted' END AS reason
    FROM (SELECT id FROM catalog WHERE k % 2 = 0) i
    LEFT JOIN (SELECT DISTINCT record_id AS id FROM finding WHERE severity = 'error') e ON e.id = i.id
    LEFT JOIN (SELECT DISTINCT id FROM catalog WHERE k % 2 = 1) c ON c.id = i.id
    LEFT JOIN (SELECT DISTINCT a.id FROM claim a JOIN claim b ON a.claim = b.claim WHERE a.k % 2 = 0 AND b.k % 2 = 1) s ON s.id = i.id""",
    *FINDING,
)
def import_apply(spark, d):
    c = views.catalog(spark, d)
    return snapshots.apply_import(c.where("k % 2 = 0"), c.where("k % 2 = 1"), rules.catalog_findings(c))


@query("findings_rollup", "SELECT severity, code, count(*) AS findings FROM finding GROUP BY ROLLUP (severity, code)", *FINDING)
def findings_rollup(spark, d):
    return reports.severity_rollup(rules.catalog_findings(views.catalog(spark, d)))


RIS_OUT = """concat_ws(chr(10), 'TY  - ' || CASE format WHEN 'Book' THEN 'BOOK' WHEN 'Article' THEN 'JOUR' WHEN 'Video' THEN 'VIDEO' WHEN 'Map' THEN 'MAP' WHEN 'Online book' THEN 'EBOOK' ELSE 'GEN' END,
 'M3  - ' || format, 'ID  - ' || id, CASE WHEN title <> '' THEN 'TI  - ' || title END, 'AU  - ' || creator, CASE WHEN doi IS NOT NULL THEN 'DO  - ' || doi END, 'SN  - ' || isbn, CASE WHEN isbn2 IS NOT NULL THEN 'SN  - ' || isbn2 END, 'UR  - ' || link, 'ER  - ')"""


def _records(spark, d):
    return finish(views.catalog(spark, d).select(F.concat(F.lit("f"), "k").alias("path"), F.lit(1).alias("ordinal"), "k", "id", "title", "creators", "format", "identifiers", "links"), "catalog")


@query("ris_export", f"SELECT id, {RIS_OUT} AS out FROM catalog", "catalog")
def ris_export(spark, d):
    return crosswalk.ris(_records(spark, d))


@query("ris_roundtrip", "SELECT id, title, format, creator, (CASE WHEN doi IS NULL THEN 0 ELSE 1 END + CASE WHEN isbn2 IS NULL THEN 1 ELSE 2 END) AS identifiers, link FROM catalog", "catalog")
def ris_roundtrip(spark, d):
    sent = _records(spark, d)
    text = crosswalk.ris(sent.withColumn("id", F.concat_ws("\x1f", "path", "id"))).select(F.regexp_extract("id", "^([^\x1f]*)", 1).alias("path"), F.regexp_replace("out", "(?m)^ID  - [^\x1f]*\x1f", "ID  - ").alias("text"))
    back = tagged.read_ris(text)
    return back.select("id", "title", "format", F.get("creators", F.lit(0)).alias("creator"), F.size("identifiers").alias("identifiers"), F.get("links", F.lit(0)).alias("link"))


@query("packet_roundtrip", "SELECT id, title, format, creator, (CASE WHEN doi IS NULL THEN 0 ELSE 1 END + CASE WHEN carrier IS NULL THEN 0 ELSE 1 END + CASE WHEN isbn2 IS NULL THEN 1 ELSE 2 END) AS identifiers FROM catalog", "catalog")
def packet_roundtrip(spark, d):
    text = crosswalk.packet(_records(spark, d)).select(F.col("id").alias("path"), F.concat(F.lit('{"format_version": 1, "records": ['), "out", F.lit("]}")).alias("text"))
    back = jsons.read_packet(text)
    return back.select("id", "title", "format", F.get("creators", F.lit(0)).alias("creator"), F.size("identifiers").alias("identifiers"))


@query("csl_export", "SELECT id, CASE format WHEN 'Article' THEN 'article-journal' WHEN 'Book' THEN 'book' WHEN 'Online book' THEN 'book' WHEN 'Video' THEN 'motion_picture' WHEN 'Map' THEN 'map' ELSE 'document' END AS type, isbn, link AS url FROM catalog", "catalog")
def csl_export(spark, d):
    out = crosswalk.csl(_records(spark, d))
    return out.select("id", *[F.get_json_object("out", f"$.{k}").alias(a) for k, a in (("type", "type"), ("ISBN", "isbn"), ("URL", "url"))])


@query("html_profile", r"""SELECT page_id, len(regexp_extract_all(html, '<[A-Za-z_][^<>]*>')) AS elements, regexp_matches(html, '(?i)<!DOCTYPE|<!ENTITY') AS dtd FROM pages""")
def html_profile(spark, d):
    return files.xml_profile(table(spark, d, "pages"), "html").select("page_id", "elements", "dtd")


@query("html_elements", r"""SELECT name, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z_][A-Za-z0-9_:.-]*)', 1)) AS name FROM pages) GROUP BY name""")
def html_elements(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([A-Za-z_][A-Za-z0-9_:.-]*)"), F.lit(1))).alias("name"))
    return p.groupBy("name").agg(n("n"), F.count_distinct("page_id").alias("pages"))


@query("html_unexpected", r"""SELECT page_id AS path, name AS element FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([A-Za-z_][A-Za-z0-9_:.-]*)', 1)) AS name FROM pages) WHERE name NOT IN ('html', 'head', 'body', 'title', 'p', 'a', 'div')""")
def html_unexpected(spark, d):
    return unexpected_paths(table(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text")), ["html", "head", "body", "title", "p", "a", "div"])


@query("json_profile", "SELECT event_id, event_id % 13 <> 0 AS valid, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS depth, CASE WHEN event_id % 13 <> 0 THEN 1 ELSE 2 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS keys FROM events")
def json_profile(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "k": 1}'))).otherwise(F.col("props")).alias("text"))
    e = e.withColumn("text", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"a": '), "text", F.lit("}"))).otherwise(F.col("text")))
    return files.json_profile(e).select("event_id", "valid", "depth", "keys")


@query("preservation_check", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 17 = 0 THEN 'length' ELSE 'digest' END AS problem FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0")
def preservation_check(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    kept = files.capture(x.select("path", "content", F.octet_length("content").cast("long").alias("length"))).join(x.select("path", "k"), "path")
    return files.preservation_mismatches(kept.withColumns({"length": F.when(F.col("k") % 17 == 0, F.col("length") + 1).otherwise(F.col("length")), "sha256": F.when(F.col("k") % 19 == 0, "no").otherwise(F.col("sha256"))}))


@query("repeated_sources", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_sources(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(n("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(
    "service_problems",
    """SELECT id, problem FROM (SELECT 'O' || o_orderkey AS id, unnest(list_filter([CASE WHEN o_orderkey % 50 = 3 THEN 'unknown-kind' END, CASE WHEN o_orderkey % 40 = 7 AND o_orderkey % 50 <> 3 THEN 'area' END, CASE WHEN o_orderkey % 30 = 1 THEN 'state' END, CASE WHEN o_orderkey % 60 = 5 THEN 'title' END], lambda x: x IS NOT NULL)) AS problem FROM orders)""",
)
def service_problems(spark, d):
    return services.record_problems(_services(spark, d), dictionaries.service_fields(spark))


def _services(spark, d):
    k = F.col("o_orderkey")
    state = F.when(k % 30 == 1, "lost").when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "due").otherwise("blocked")
    kind = F.when(k % 50 == 3, "odd").when(k % 2 == 0, "accession").otherwise("metadata-job")
    area = F.when(k % 40 == 7, "discovery").when(k % 2 == 0, "special-collections").otherwise("technical-services")
    when = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select(F.concat(F.lit("O"), k).alias("id"), kind.alias("kind"), area.alias("area"), F.when(k % 60 == 5, " x").otherwise(F.col("o_orderpriority")).alias("title"), state.alias("state"), F.lit("clerk").alias("owner_role"), F.lit("ils").alias("system"), F.lit("internal").alias("sensitivity"), when.alias("created_at"), when.alias("updated_at"))


@query("service_states", "SELECT count(*) FILTER (o_orderkey % 30 <> 1 AND o_orderstatus NOT IN ('F', 'O')) AS blocked, count(*) FILTER (o_orderkey % 30 <> 1 AND o_orderstatus = 'O') AS review_or_due FROM orders")
def service_states(spark, d):
    return services.states(_services(spark, d))


@query(
    "service_rollup",
    """WITH a(area, kinds) AS (VALUES ('collections', 'collection-fund, collection-policy'), ('electronic-resources', 'license-obligation, resource-entitlement'), ('discovery', 'discovery-profile, link-routing'), ('preservation', 'condition-assessment, preservation-action'),
    ('technical-services', 'acquisition-order, metadata-job'), ('special-collections', 'accession, processing-plan'), ('data-services', 'data-management-plan, dataset-custody'), ('rare-materials', 'conservation-treatment, copy-provenance')),
    r AS (SELECT CASE WHEN o_orderkey % 40 = 7 THEN 'discovery' WHEN o_orderkey % 2 = 0 THEN 'special-collections' ELSE 'technical-services' END AS area FROM orders)
    SELECT a.area, a.kinds, count(r.area) AS records FROM a LEFT JOIN r ON r.area = a.area GROUP BY ALL""",
)
def service_rollup(spark, d):
    return services.rollup(_services(spark, d), dictionaries.service_fields(spark))


@query("unit_problems", "SELECT id AS unit_id, unnest(CASE WHEN parent_id IS NULL AND level = 'fonds' THEN ['schema-version'] WHEN level = 'other' THEN ['language'] ELSE ['level'] END) AS problem FROM unit WHERE level IN ('fonds', 'series', 'other')", "unit")
def unit_problems(spark, d):
    u = views.units(spark, d).select(F.col("id").alias("unit_id"), F.lit("x").alias("schema_id"), F.when(F.col("level") == "fonds", 1).otherwise(2).alias("schema_version"), "parent_id", F.when(F.col("level") == "series", "shelf").otherwise(F.col("level")).alias("level"), F.when(F.col("level") == "other", "?").otherwise("en").alias("language"), F.lit("1").alias("created_at"), F.lit("1").alias("updated_at"))
    schemas = spark.createDataFrame([("x", 2, "description")], "schema_id string, version int, record_type string")
    return fields.unit_problems(u, schemas, formats.LEVELS)


@query("reference_codes", "SELECT s, count(DISTINCT unit_id) AS n FROM value WHERE field_id = 'segment' GROUP BY s HAVING count(DISTINCT unit_id) > 1", "value")
def reference_codes(spark, d):
    v = views.values(spark, d).where("field_id = 'segment'").withColumn("field_id", F.lit("reference_code"))
    return fields.duplicate_reference_codes(v).select("s", "n")


@query("value_report", "SELECT unit_id, field_id, CASE field_id WHEN 'title' THEN 'text' WHEN 'segment' THEN 'controlled-term' WHEN 'since' THEN 'date' WHEN 'checksum' THEN 'checksum' WHEN 'active' THEN 'boolean' WHEN 'balance' THEN 'decimal' WHEN 'count' THEN 'integer' END AS kind, coalesce(s, CAST(CAST(round(n * 100) AS BIGINT) AS VARCHAR), b::VARCHAR) AS shown FROM value", "value")
def value_report(spark, d):
    shown = reports.value_table(views.values(spark, d), views.fields(spark))
    cents = F.when(F.col("kind").isin("decimal", "integer"), F.round(F.col("shown").cast("double") * 100).cast("long").cast("string"))  # engines write doubles differently
    return shown.select("unit_id", "field_id", "kind", F.coalesce(cents, "shown").alias("shown"))


@query("unit_labels", "SELECT u.id, coalesce(v.s, u.id) AS label FROM unit u LEFT JOIN (SELECT unit_id, s FROM value WHERE field_id = 'title') v ON v.unit_id = u.id", "unit", "value")
def unit_labels(spark, d):
    return reports.display_labels(views.units(spark, d), views.values(spark, d))


@query("archive_import", "SELECT kind, id, outcome, reason FROM (SELECT 'unit' AS kind, u.id, CASE WHEN level = 'series' OR level = 'other' OR (parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM unit)) THEN 'not-applied' ELSE 'applied' END AS outcome, CASE WHEN level = 'series' THEN 'id-conflict' WHEN level = 'other' OR (parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM unit)) THEN 'hierarchy' ELSE 'accepted' END AS reason FROM unit u) UNION ALL SELECT 'schema', s_suppkey::VARCHAR, CASE WHEN s_suppkey % 3 = 0 THEN 'not-applied' ELSE 'applied' END, CASE WHEN s_suppkey % 3 = 0 THEN 'id-conflict' ELSE 'accepted' END FROM supplier", "unit")
def archive_import(spark, d):
    u = views.units(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("schema_id"))
    return workspace.import_archive(s, u, s.where("cast(schema_id as long) % 3 = 0"), u.where("level = 'series'"))


@query("snapshot_packages", "SELECT 'orders' AS table, count(*) AS lines, count(*) FILTER (id % 7 = 0) AS damaged FROM snap_a", "snap_a")
def snapshot_packages(spark, d):
    a = views.snapshot(spark, d, "a")
    lines = packages.snapshot_lines({"orders": a})
    touched = lines.withColumn("line", F.when(F.get_json_object("line", "$.id").cast("long") % 7 == 0, F.concat("line", F.lit(" "))).otherwise(F.col("line")))
    total = touched.groupBy("table").agg(n("lines"))
    return total.join(packages.damaged_lines(touched), "table")


@query("snapshot_choice", "SELECT o_custkey AS id, max(o_orderkey) AS newest, CASE WHEN max(o_orderkey) % 5 = 0 THEN 'stopped' ELSE 'active' END AS state FROM orders GROUP BY 1")
def snapshot_choice(spark, d):
    o = table(spark, d, "orders")
    s = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("generation"), F.lit(True).alias("available"), F.lit("d").alias("digest"), F.when(F.col("o_orderkey") % 5 == 0, "e").otherwise("d").alias("header_digest"))
    newest = s.groupBy("id").agg(F.max("generation").alias("newest"))
    return newest.join(snapshots.choose_active(s).select("id", "state"), "id")


@query("next_audit_event", "SELECT ledger_id, count(*) + 1 AS sequence, max_by(hash, sequence) AS previous_hash FROM ledger GROUP BY ledger_id", "ledger")
def next_audit_event(spark, d):
    return workspace.next_event(views.ledgers(spark, d), "export", "report", F.lit("d"), "2024-01-01T00:00:00Z").select("ledger_id", "sequence", "previous_hash")


@query("continuity_status", "SELECT ledger_id AS lineage_id, CASE WHEN count(*) >= 50 THEN 'gap' WHEN count(*) % 3 = 0 THEN 'rollback' ELSE 'trusted-match' END AS status FROM ledger GROUP BY ledger_id", "ledger")
def continuity_status(spark, d):
    e = views.ledgers(spark, d)
    previous = F.lag("instant").over(views.Window.partitionBy("ledger_id").orderBy("sequence"))
    w = e.select(F.col("ledger_id").alias("lineage_id"), F.col("instant").alias("digest"), F.when(F.col("sequence") % 50 == 0, F.concat(F.lit("lost-"), "instant")).otherwise(previous).alias("predecessor_digest"), "sequence", F.col("sequence").alias("audit_count"))
    last = w.groupBy("lineage_id").agg(F.max("sequence").alias("sequence"), F.max_by("digest", "sequence").alias("digest"))
    anchors = last.withColumn("sequence", F.when(F.col("sequence") % 3 == 0, F.col("sequence") - 1).otherwise(F.col("sequence")))
    return workspace.compare_external(hierarchy.topology(w), last, anchors)


# --- streams ---------------------------------------------------------------------------------------------------------------


def _run(stream, tag: str):
    """Process what is there, then read the sink; both stand in the shared folder."""
    spark = stream.sparkSession
    base = tables.new_folder(spark, "stream")
    q = stream.writeStream.format("parquet").option("path", f"{base}/{tag}").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/{tag}")


def _events(spark, d):
    known = table(spark, d, "events")
    return spark.readStream.schema(known.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet")


@query("stream_findings_window", "SELECT start, code, count(*) AS findings FROM (SELECT date_trunc('hour', ts) AS start, event_type AS code FROM events) WHERE start + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 1 hour FROM events) GROUP BY start, code")
def stream_findings_window(spark, d):
    found = _events(spark, d).select(F.col("ts").cast("timestamp"), F.lit("notice").alias("severity"), F.col("event_type").alias("code"))
    return _run(intake.findings_per_window(found), "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "code", "findings")


@query("stream_dedupe", "SELECT count(DISTINCT user_id || event_type) AS n FROM events")
def stream_dedupe(spark, d):
    arrivals = _events(spark, d).select(F.col("ts").cast("timestamp").alias("arrived"), F.sha2(F.concat(F.col("user_id").cast("string"), "event_type"), 256).alias("sha256"))
    return _run(intake.without_repeats(arrivals, "3650 days"), "once").agg(n("n"))


@query("stream_conflicts", "SELECT event_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def stream_conflicts(spark, d):
    current = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    ok, _ = intake.new_records(_events(spark, d), current, "user_id")
    return _run(ok.select(F.col("event_id").alias("id")), "accepted")


@query("stream_chain_verify", f"SELECT ledger_id, sequence, CASE WHEN bad THEN 'link' ELSE 'content' END AS problem FROM (SELECT ledger_id, sequence, previous_hash <> coalesce(lag(hash) OVER (PARTITION BY ledger_id ORDER BY sequence), 'GENESIS') AS bad, hash <> {MARK} AS touched FROM ledger) WHERE bad OR touched", "ledger")
def stream_chain_verify(spark, d):
    batch = views.ledgers(spark, d)
    base = tables.new_folder(spark, "ledger")
    batch.write.parquet(base)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _run(intake.verify_ledger_stream(spark.readStream.schema(batch.schema).parquet(base), _mark()), "verdicts")
    finally:
        spark.conf.set(provider, before)


