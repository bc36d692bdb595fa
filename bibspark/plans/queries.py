"""Registered queries of the reference's operators over the views, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibspark.functions import dates, digest, formats, identity, text
from bibspark.operators import evidence, fields, hierarchy, interop, ledger, lists, rules, snapshots
from bibspark.plans import reports, views
from bibspark.plans.views import oracle, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    """Register a query, and its oracle over the views it needs."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql, *needs)
        return f

    return add


FINDING = ("catalog", "claim", "isbn_ok", "problem", "finding")
n = lambda c: F.count("*").alias(c)

# --- rules ---------------------------------------------------------------------------------------------------------


@query("findings_by_code", "SELECT severity, code, count(*) AS findings, count(DISTINCT record_id) AS records FROM finding GROUP BY ALL", *FINDING)
def findings_by_code(spark, d):
    return rules.by_code(rules.catalog_findings(views.catalog(spark, d)))


@query("findings_detail", "SELECT severity, code, record_id, detail, row_number() OVER (PARTITION BY code, record_id, detail ORDER BY severity) AS occurrence, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank FROM finding", *FINDING)
def findings_detail(spark, d):
    found = rules.with_finding_ids(rules.catalog_findings(views.catalog(spark, d)))
    return found.select("severity", "code", "record_id", "detail", "occurrence", formats.severity_rank(F.col("severity")).alias("severity_rank"))


@query(
    "review_outcome",
    """SELECT file, n AS records, errors, warnings, errors > 0 OR n = 0 AS blocked FROM (
    SELECT c.file, count(DISTINCT c.k) AS n, count(*) FILTER (f.severity = 'error') AS errors, count(*) FILTER (f.severity = 'warning') AS warnings FROM catalog c LEFT JOIN rowfinding f ON c.k = f.k GROUP BY c.file)""",
    "catalog", "isbn_ok", "rowfinding",
)
def review_outcome(spark, d):
    c = views.catalog(spark, d)
    rows = c.withColumn("claims", identity.identity_claims(F.col("identifiers"), F.col("links")))
    found = rules.row_findings(rows, F.col("file"), rules.catalog_rules()).withColumnRenamed("record_id", "file")
    return rules.review_outcome(c, found)


@query("duplicate_claims", "SELECT claim, count(*) AS n, array_to_string(list_sort(list(id))[1:20], ',') AS members FROM claim GROUP BY claim HAVING count(*) > 1", "catalog", "claim")
def duplicate_claims(spark, d):
    found = rules.duplicate_members(snapshots.claims(views.catalog(spark, d)), "claim", "id")
    return found.select("claim", "n", F.array_join("members", ",").alias("members"))


@query("duplicate_claim_members", "SELECT claim, n, id FROM claim JOIN (SELECT claim, count(*) AS n FROM claim GROUP BY claim HAVING count(*) > 1) USING (claim)", "catalog", "claim")
def duplicate_claim_members(spark, d):
    return rules.duplicate_rows(snapshots.claims(views.catalog(spark, d)), "claim", "id")


@query("duplicate_titles", "SELECT min(id) AS first_id, key AS title_key, count(*) AS n FROM (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM catalog) WHERE key <> '' GROUP BY key HAVING count(*) > 1", "catalog")
def duplicate_titles(spark, d):
    keyed = views.catalog(spark, d).withColumn("title_key", text.title_key(F.col("title"), unicode=False))
    return keyed.where("title_key <> ''").groupBy("title_key").agg(F.min("id").alias("first_id"), n("n")).where("n > 1")


@query("duplicate_ids", "SELECT id, count(*) AS n FROM catalog GROUP BY id HAVING count(*) > 1", "catalog")
def duplicate_ids(spark, d):
    return views.catalog(spark, d).groupBy("id").agg(n("n")).where("n > 1")


@query("isbn_check", "SELECT k, isbn, ok FROM catalog JOIN isbn_ok USING (k)", "catalog", "isbn_ok")
def isbn_check(spark, d):
    isbn = F.get("identifiers", F.lit(0))["value"]
    return views.catalog(spark, d).select("k", isbn.alias("isbn"), identity.is_isbn(isbn).alias("ok"))


@query("url_policy_reasons", "SELECT coalesce(problem, 'ok') AS reason, count(*) AS n FROM problem GROUP BY 1", "catalog", "problem")
def url_policy_reasons(spark, d):
    return views.catalog(spark, d).select(F.coalesce(identity.url_problem(F.get("links", F.lit(0))), F.lit("ok")).alias("reason")).groupBy("reason").agg(n("n"))


@query("page_url_policy", "SELECT CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' ELSE 'ok' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def page_url_policy(spark, d):
    return table(spark, d, "pages").select(F.coalesce(identity.url_problem(F.col("url")), F.lit("ok")).alias("reason")).groupBy("reason").agg(n("n"))


@query("doi_carriers", "SELECT k, carrier AS doi FROM catalog WHERE carrier IS NOT NULL", "catalog")
def doi_carriers(spark, d):
    rows = views.catalog(spark, d).select("k", F.explode("identifiers").alias("i")).where("i.scheme = 'local'")
    return rows.select("k", identity.doi_from_carrier(F.col("i.value")).alias("doi"))


@query("contract_violations", "SELECT 'format:value' AS detail, count(*) AS n FROM catalog WHERE format NOT IN ('Article','Book','Online book','Video','Map','Other') HAVING count(*) > 0 UNION ALL SELECT 'id:pattern', count(*) FROM catalog WHERE NOT regexp_full_match(id, '[A-Za-z0-9._:-]{1,128}') HAVING count(*) > 0", "catalog")
def contract_violations(spark, d):
    c = views.catalog(spark, d)
    return rules.row_findings(c, F.col("id"), rules.contract_rules(rules.CATALOG_CONTRACT, arrays={"creators", "links"})).groupBy("detail").agg(n("n"))


# --- scalar functions ------------------------------------------------------------------------------------------------

PROBE = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN '=1+' || event_id WHEN 1 THEN '''=x' WHEN 2 THEN '  -5' WHEN 3 THEN '@cmd' WHEN 4 THEN '''quoted' WHEN 5 THEN '+' ELSE event_type END AS cell FROM events"


def _cells(spark, d):
    k = F.col("event_id")
    cell = F.col("event_type")
    for i, v in ((5, F.lit("+")), (4, F.lit("'quoted")), (3, F.lit("@cmd")), (2, F.lit("  -5")), (1, F.lit("'=x")), (0, F.concat(F.lit("=1+"), k.cast("string")))):
        cell = F.when(k % 9 == i, v).otherwise(cell)
    return table(spark, d, "events").select("event_id", cell.alias("cell"))


RISK = "CASE WHEN starts_with(cell, '''') AND regexp_matches(substr(cell, 2), '^[ '']*[=+@-]') THEN 'protected' WHEN regexp_matches(cell, '^[ '']*[=+@-]') THEN 'active-risk' ELSE 'safe' END"


@query("spreadsheet_risk", f"SELECT {RISK} AS risk, count(*) AS n FROM ({PROBE}) GROUP BY 1")
def spreadsheet_risk(spark, d):
    return _cells(spark, d).select(text.spreadsheet_class(F.col("cell")).alias("risk")).groupBy("risk").agg(n("n"))


@query("protect_cells", f"SELECT event_id, CASE WHEN {RISK} = 'safe' THEN cell ELSE '''' || cell END AS protected, CASE WHEN {RISK} = 'protected' THEN substr(cell, 2) ELSE cell END AS restored FROM ({PROBE})")
def protect_cells(spark, d):
    return _cells(spark, d).select("event_id", text.protect_cell(F.col("cell")).alias("protected"), text.unprotect_cell(F.col("cell")).alias("restored"))


@query("list_codec", "SELECT p_partkey, replace(replace(p_name, '\\', '\\\\'), '|', '\\|') || '|' || p_brand || '\\|' || p_type AS encoded, p_name || ';' || p_brand || '|' || p_type AS decoded FROM part")
def list_codec(spark, d):
    encoded = text.encode_pipe_list(F.array("p_name", F.concat_ws("|", "p_brand", "p_type")))
    return table(spark, d, "part").select("p_partkey", encoded.alias("encoded"), F.array_join(text.decode_pipe_list(encoded), ";").alias("decoded"))


@query("date_kind_check", "SELECT unit_id, s AS day, try_cast(s AS DATE) IS NOT NULL AS ok FROM value WHERE field_id = 'since'", "value")
def date_kind_check(spark, d):
    v = views.values(spark, d).where("field_id = 'since'")
    return v.select("unit_id", F.col("s").alias("day"), dates.is_calendar_date(F.col("s")).alias("ok"))


EDTF = "CASE o_orderkey % 8 WHEN 0 THEN substr(y, 1, 4) WHEN 1 THEN y || '/..' WHEN 2 THEN substr(y, 1, 3) || 'X' WHEN 3 THEN y || '?' WHEN 4 THEN '[' || substr(y, 1, 4) || ',' || y || ']' WHEN 5 THEN substr(y, 1, 4) || '-13' WHEN 6 THEN y || '/' || substr(y, 1, 7) ELSE substr(y, 1, 4) || '-02-30' END"


@query("edtf_check", f"SELECT o_orderkey, {EDTF} AS value, o_orderkey % 8 NOT IN (5, 7) AS ok FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS y FROM orders)")
def edtf_check(spark, d):
    y, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    forms = [F.substring(y, 1, 4), F.concat(y, F.lit("/..")), F.concat(F.substring(y, 1, 3), F.lit("X")), F.concat(y, F.lit("?")), F.concat(F.lit("["), F.substring(y, 1, 4), F.lit(","), y, F.lit("]")), F.concat(F.substring(y, 1, 4), F.lit("-13")), F.concat(y, F.lit("/"), F.substring(y, 1, 7)), F.concat(F.substring(y, 1, 4), F.lit("-02-30"))]
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("value"))
    return rows.select("o_orderkey", "value", dates.is_edtf(F.col("value")).alias("ok"))


@query("format_crosswalk", "SELECT format, CASE format WHEN 'Book' THEN 'BOOK' WHEN 'Article' THEN 'JOUR' WHEN 'Video' THEN 'VIDEO' WHEN 'Map' THEN 'MAP' WHEN 'Online book' THEN 'EBOOK' ELSE 'GEN' END AS ris, CASE format WHEN 'Article' THEN 'article' WHEN 'Book' THEN 'book' WHEN 'Online book' THEN 'book' ELSE 'misc' END AS bibtex, CASE format WHEN 'Video' THEN 'moving image' WHEN 'Map' THEN 'cartographic' WHEN 'Other' THEN 'mixed material' ELSE 'text' END AS mods, count(*) AS n FROM catalog GROUP BY format", "catalog")
def format_crosswalk(spark, d):
    f = F.col("format")
    return views.catalog(spark, d).groupBy("format").agg(n("n")).select(f, formats.to_ris(f).alias("ris"), formats.to_bibtex(f).alias("bibtex"), formats.to_mods(f).alias("mods"), "n")


@query("format_inference", "SELECT format, CASE WHEN b336 = 'txt' AND b338 = 'cr' THEN 'Online book' ELSE 'Book' END AS from_marc, format AS from_text, count(*) AS n FROM catalog GROUP BY ALL", "catalog")
def format_inference(spark, d):
    none = F.array().cast("array<string>")
    marc = formats.format_from_marc(F.col("trace"), none, none)
    return views.catalog(spark, d).select("format", marc.alias("from_marc"), formats.format_from_text(F.upper("format")).alias("from_text")).groupBy("format", "from_marc", "from_text").agg(n("n"))


# --- search and paging -------------------------------------------------------------------------------------------------


@query("catalog_search", "SELECT k, id FROM catalog WHERE format = 'Book' AND contains(lower(id || ' ' || title || ' ' || creator), 'brand#1')", "catalog")
def catalog_search(spark, d):
    return lists.search(views.catalog(spark, d), "Brand#1", "Book").select("k", "id")


@query("page_slice", "SELECT o_orderkey, position, 3 AS page, total // 100 + CASE WHEN total % 100 > 0 THEN 1 ELSE 0 END AS pages, total FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position, count(*) OVER () AS total FROM orders) WHERE position BETWEEN 301 AND 400")
def page_slice(spark, d):
    return lists.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 3).select("o_orderkey", F.col("position").cast("long"), "page", "pages", "total")


@query("page_containing", "SELECT CAST(floor(count(*) / 100) AS BIGINT) AS page FROM orders, (SELECT o_orderdate AS od, o_orderkey AS ok FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1) WHERE (o_orderdate, o_orderkey) < (od, ok)")
def page_containing(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return lists.page_containing(rows, ["o_orderdate", "o_orderkey"], (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"))


@query("format_facets", "SELECT format, count(*) AS n, count(*) FILTER (public_visible AND NOT suppressed) AS published FROM catalog GROUP BY format", "catalog")
def format_facets(spark, d):
    return views.catalog(spark, d).groupBy("format").agg(n("n"), F.count_if(F.col("public_visible") & ~F.col("suppressed")).alias("published"))


# --- joins and evidence ------------------------------------------------------------------------------------------------


@query("import_conflicts_id", "SELECT DISTINCT i.id FROM catalog i WHERE i.k % 2 = 0 AND EXISTS (SELECT 1 FROM catalog c WHERE c.k % 2 = 1 AND c.id = i.id)", "catalog")
def import_conflicts_id(spark, d):
    c = views.catalog(spark, d)
    return snapshots.id_conflicts(c.where("k % 2 = 0"), c.where("k % 2 = 1"))


@query("import_conflicts_claim", "SELECT DISTINCT i.id, i.claim FROM claim i WHERE i.k % 2 = 0 AND EXISTS (SELECT 1 FROM claim c WHERE c.k % 2 = 1 AND c.claim = i.claim)", "catalog", "claim")
def import_conflicts_claim(spark, d):
    c = views.catalog(spark, d)
    return snapshots.claim_conflicts(c.where("k % 2 = 0"), c.where("k % 2 = 1"))


@query("active_decisions", "SELECT record_sha, entity_id FROM active", "decision", "application", "entity", "active")
def active_decisions(spark, d):
    found = evidence.active_decisions(views.decisions(spark, d), views.applications(spark, d), views.entities(spark, d))
    return found.select("record_sha", F.get("entity_ids", F.lit(0)).alias("entity_id"))


@query("unattributed", "SELECT entity_id, source_kind FROM uncovered", "decision", "application", "entity", "active", "uncovered")
def unattributed(spark, d):
    e = views.entities(spark, d)
    return evidence.unattributed(e, evidence.active_decisions(views.decisions(spark, d), views.applications(spark, d), e)).select("entity_id", "source_kind")


@query(
    "evidence_summary",
    """SELECT (SELECT count(*) FROM application WHERE outcome = 'applied') AS applied, (SELECT count(*) FROM application WHERE outcome = 'not-applied') AS not_applied,
    (SELECT count(*) FROM decision d WHERE decision = 'admit' AND NOT EXISTS (SELECT 1 FROM application a WHERE a.decision_sha = d.record_sha)) AS admitted_unverified,
    (SELECT count(*) FROM active) AS active, (SELECT count(*) FROM uncovered) AS unattributed,
    (SELECT count(*) FROM uncovered) > 0 OR (SELECT count(*) FROM decision d WHERE decision = 'admit' AND NOT EXISTS (SELECT 1 FROM application a WHERE a.decision_sha = d.record_sha)) > 0 AS blocked,
    CASE WHEN (SELECT count(*) FROM decision d WHERE decision = 'admit' AND NOT EXISTS (SELECT 1 FROM application a WHERE a.decision_sha = d.record_sha)) > 0 THEN 'admitted-unverified' WHEN (SELECT count(*) FROM uncovered) > 0 THEN 'unattributed' ELSE 'none' END AS reason""",
    "decision", "application", "entity", "active", "uncovered",
)
def evidence_summary(spark, d):
    return evidence.assessment(views.decisions(spark, d), views.applications(spark, d), views.entities(spark, d))


@query("decision_status", "SELECT source_sha AS entity, CASE min(CASE decision WHEN 'withdraw' THEN 0 WHEN 'reject' THEN 1 ELSE 2 END) WHEN 0 THEN 'withdraw' WHEN 1 THEN 'reject' ELSE 'admit' END AS status FROM decision WHERE source_sha IS NOT NULL GROUP BY source_sha", "decision")
def decision_status(spark, d):
    by_text = views.decisions(spark, d).where("source_sha is not null").withColumn("entity_ids", F.array("source_sha"))
    return evidence.status_by_precedence(by_text).select(F.col("entity_id").alias("entity"), "status")


@query("decision_links", "SELECT decision_sha, outcome, reason FROM application WHERE reason = 'unknown'", "decision", "application")
def decision_links(spark, d):
    return evidence.bad_links(views.decisions(spark, d), views.applications(spark, d)).select("decision_sha", "outcome", "reason")


@query(
    "manifest_reconcile",
    """SELECT id, array_to_string(list_sort(list_filter([CASE WHEN id % 7 = 1 AND id % 11 <> 0 THEN 'digest-mismatch' END, CASE WHEN id % 11 = 0 THEN 'missing-active' END, CASE WHEN id % 5 = 0 THEN 'missing-previous' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM
    (SELECT o_custkey AS c, o_orderkey AS id FROM orders) WHERE (id % 7 = 1 AND id % 11 <> 0) OR id % 11 = 0 OR id % 5 = 0""",
)
def manifest_reconcile(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    m = o.select("id", F.lit(2).alias("active_generation"), F.lit(1).alias("previous_generation"), F.lit("x").alias("payload_digest"))
    active = o.where("id % 11 <> 0").select("id", F.lit(2).alias("generation"), F.when(F.col("id") % 7 == 1, "y").otherwise("x").alias("payload_digest"))
    previous = o.where("id % 5 <> 0").select("id", F.lit(1).alias("generation"), F.lit("w").alias("payload_digest"))
    return snapshots.reconcile(m, active.unionByName(previous))



# --- schema-driven validation ------------------------------------------------------------------------------------------


@query(
    "typed_value_violations",
    """SELECT unit_id, field_id, problem FROM (SELECT unit_id, field_id, CASE
    WHEN field_id = 'mystery' THEN 'unknown-field' WHEN field_id = 'title' AND s <> trim(s) THEN 'canonical'
    WHEN field_id = 'segment' AND s NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 'vocabulary'
    WHEN field_id = 'since' AND try_cast(s AS DATE) IS NULL THEN 'shape' WHEN field_id = 'count' AND n <> floor(n) THEN 'range'
    WHEN field_id = 'checksum' AND s = 'md5:00' THEN 'shape' END AS problem FROM value) WHERE problem IS NOT NULL""",
    "value",
)
def typed_value_violations(spark, d):
    return fields.typed_value_violations(views.values(spark, d), views.fields(spark)).select("unit_id", "field_id", "problem")


@query("required_missing", "SELECT 'S' || s_suppkey AS unit_id, 'active' AS field_id FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'C' || c_custkey, 'title' FROM customer WHERE c_custkey % 9 = 0")
def required_missing(spark, d):
    v = views.values(spark, d)
    return fields.missing_required(v.select("unit_id", "schema_id").distinct(), v, views.fields(spark))


@query("vocabulary_violations", "SELECT 'C' || c_custkey AS unit_id, c_mktsegment AS s FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY')")
def vocabulary_violations(spark, d):
    terms = views.fields(spark).select("schema_id", "field_id", F.explode("vocabulary").alias("term"))
    return fields.vocabulary_violations(views.values(spark, d), terms).select("unit_id", "s")


@query("service_long_form", "SELECT unit_id, field_id, coalesce(s, CAST(CAST(round(n * 100) AS BIGINT) AS VARCHAR), CAST(b AS VARCHAR)) AS shown FROM value", "value")
def service_long_form(spark, d):
    v = views.values(spark, d)
    return v.select("unit_id", "field_id", F.coalesce("s", F.round(F.col("n") * 100).cast("long").cast("string"), F.col("b").cast("string")).alias("shown"))


@query("service_area_rollup", "SELECT a.area, count(c.c_custkey) AS rows FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('NONE')) a(area) LEFT JOIN customer c ON c.c_mktsegment = a.area GROUP BY a.area")
def service_area_rollup(spark, d):
    areas = table(spark, d, "customer").select(F.col("c_mktsegment").alias("area"))
    return lists.counts_zero_filled(areas, "area", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"])


# --- ledgers -----------------------------------------------------------------------------------------------------------

MARK = "sha256(ledger_id || '|' || sequence || '|' || instant || '|' || action)"
HOLES = "SELECT * FROM ledger WHERE CAST(instant AS BIGINT) % 101 <> 50"
BREAKS = f"SELECT ledger_id, sequence, sequence <> 1 AND before IS DISTINCT FROM sequence - 1 AS gap, CASE WHEN sequence = 1 THEN previous_hash <> 'GENESIS' WHEN before = sequence - 1 THEN previous_hash <> prior ELSE false END AS link, hash <> {MARK} AS content, state_digest FROM (SELECT *, lag(sequence) OVER w AS before, lag(hash) OVER w AS prior FROM ({HOLES}) WINDOW w AS (PARTITION BY ledger_id ORDER BY sequence))"


def _mark():
    return F.sha2(F.concat_ws("|", "ledger_id", F.col("sequence").cast("string"), "instant", "action"), 256)


@query("chain_breaks", f"SELECT ledger_id, sequence, gap, link, content FROM ({BREAKS}) WHERE gap OR link OR content", "ledger")
def chain_breaks(spark, d):
    return ledger.chain_breaks(_holes(spark, d), _mark())


def _holes(spark, d):
    return views.ledgers(spark, d).where("cast(instant as long) % 101 <> 50")


@query("chain_verify", f"SELECT ledger_id, events, broken, ok AS terminal_ok, broken = 0 AND ok AS valid FROM (SELECT ledger_id, count(*) AS events, count(*) FILTER (gap OR link OR content) AS broken, CAST(ledger_id AS BIGINT) % 4 <> 0 AS ok FROM ({BREAKS}) GROUP BY ledger_id)", "ledger")
def chain_verify(spark, d):
    e = _holes(spark, d)
    last = e.groupBy("ledger_id").agg(F.max_by("state_digest", "sequence").alias("digest"))
    states = last.withColumn("digest", F.when(F.col("ledger_id").cast("long") % 4 == 0, "other").otherwise(F.col("digest")))
    return ledger.verify_ledgers(e, states, expected=_mark())


@query("chain_append")
def chain_append(spark, d):
    events = views.ledgers(spark, d).select("ledger_id", "sequence", "instant", "action", "target", "state_digest")
    return ledger.append_chain(events).select("ledger_id", "sequence", "previous_hash", "hash")


ORACLES["chain_append"] = """
WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id::VARCHAR AS instant, event_type AS action,
    CASE WHEN event_id % 97 = 0 THEN event_type || '!' ELSE event_type END AS target, sha256(event_id::VARCHAR) AS state_digest FROM events
), b AS (SELECT ledger_id, sequence, length(ledger_id) || ':' || ledger_id || length(sequence::VARCHAR) || ':' || sequence || length(instant) || ':' || instant || length(action) || ':' || action || length(target) || ':' || target || '64:' || state_digest AS body FROM e
), c AS (
  SELECT ledger_id, sequence, 'GENESIS' AS previous_hash, sha256(body || '7:GENESIS') AS hash FROM b WHERE sequence = 1
  UNION ALL SELECT b.ledger_id, b.sequence, c.hash, sha256(b.body || '64:' || c.hash) FROM c JOIN b ON b.ledger_id = c.ledger_id AND b.sequence = c.sequence + 1
) SELECT * FROM c"""


@query("checkpoints", "SELECT ledger_id, min_by(hash, sequence) AS genesis_hash, max_by(hash, sequence) AS terminal_hash, count(*) AS audit_count FROM ledger GROUP BY ledger_id", "ledger")
def checkpoints(spark, d):
    return ledger.checkpoints(views.ledgers(spark, d)).select("ledger_id", "genesis_hash", "terminal_hash", "audit_count")


@query("checkpoint_status", "SELECT ledger_id, CASE WHEN n = 1 THEN 'rolled-back' ELSE 'extended' END AS status FROM (SELECT ledger_id, count(*) AS n FROM ledger GROUP BY ledger_id)", "ledger")
def checkpoint_status(spark, d):
    events = views.ledgers(spark, d)
    first = events.where("sequence <= 2")
    stored = ledger.checkpoints(first).withColumn("sequence", F.greatest("sequence", F.lit(2)))
    return ledger.verify_checkpoints(stored, events)


@query("prefix_extension", "SELECT ledger_id, count(*) > 3 AS extends FROM ledger GROUP BY ledger_id", "ledger")
def prefix_extension(spark, d):
    events = views.ledgers(spark, d)
    return ledger.prefix_extension(events.where("sequence <= 3"), events)


def _revisions(spark, d):
    e = views.ledgers(spark, d)
    return e.select(F.col("ledger_id").alias("workspace_id"), F.col("instant").alias("id"), F.lag("instant").over(views.Window.partitionBy("ledger_id").orderBy("sequence")).alias("parent_id"), F.col("sequence").alias("ordinal"))


@query("retain_last_n", "SELECT workspace_id, id, CASE WHEN r < max(r) OVER (PARTITION BY workspace_id) THEN parent_id END AS parent_id FROM (SELECT ledger_id AS workspace_id, instant AS id, lag(instant) OVER (PARTITION BY ledger_id ORDER BY sequence) AS parent_id, row_number() OVER (PARTITION BY ledger_id ORDER BY sequence DESC) AS r FROM ledger) WHERE r <= 20", "ledger")
def retain_last_n(spark, d):
    return ledger.retain_last(_revisions(spark, d)).select("workspace_id", "id", "parent_id")


@query("lineage_check", "SELECT ledger_id AS workspace_id, instant AS id FROM (SELECT ledger_id, instant, sequence, lag(instant) OVER (PARTITION BY ledger_id ORDER BY sequence) AS p FROM ledger) WHERE p IS NOT NULL AND CAST(instant AS BIGINT) % 71 = 0", "ledger")
def lineage_check(spark, d):
    r = _revisions(spark, d).withColumn("parent_id", F.when(F.col("id").cast("long") % 71 == 0, F.when(F.col("parent_id").isNotNull(), "lost")).otherwise(F.col("parent_id")))
    return ledger.lineage_problems(r).select("workspace_id", "id")


@query(
    "topology_status",
    """SELECT lineage_id, witnesses, roots, forks, gaps, CASE WHEN forks > 0 OR roots > 1 THEN 'forked' WHEN gaps > 0 OR roots <> 1 THEN 'gap' ELSE 'valid-prefix' END AS status FROM (
    SELECT ledger_id AS lineage_id, count(*) AS witnesses, count(*) FILTER (p IS NULL) AS roots, max(CASE WHEN l % 5 = 1 AND n >= 4 THEN 1 ELSE 0 END) AS forks, count(*) FILTER (CASE WHEN p IS NULL THEN s <> 1 ELSE p LIKE 'lost-%' OR (l % 5 = 1 AND sequence = 4) END) AS gaps FROM (
      SELECT ledger_id, sequence, CAST(ledger_id AS BIGINT) AS l, n, CASE WHEN l2 = 2 THEN sequence + 4 ELSE sequence END AS s,
        CASE WHEN sequence = 1 OR (l2 = 3 AND sequence = 3) THEN NULL WHEN sequence % 50 = 0 THEN 'lost-' || instant WHEN l2 = 1 AND sequence = 4 THEN before2 ELSE before END AS p
      FROM (SELECT *, CAST(ledger_id AS BIGINT) % 5 AS l2, count(*) OVER (PARTITION BY ledger_id) AS n, lag(instant) OVER w AS before, lag(instant, 2) OVER w AS before2 FROM ledger WINDOW w AS (PARTITION BY ledger_id ORDER BY sequence)))
    GROUP BY ledger_id)""",
    "ledger",
)
def topology_status(spark, d):
    """Lineages with lost predecessors, a fork (id % 5 = 1), a late start (2) and a second root (3)."""
    w = views.Window.partitionBy("ledger_id").orderBy("sequence")
    kind, s = F.col("ledger_id").cast("long") % 5, F.col("sequence")
    before, before2 = F.lag("instant").over(w), F.lag("instant", 2).over(w)
    p = F.when((s == 1) | (kind == 3) & (s == 3), None).when(s % 50 == 0, F.concat(F.lit("lost-"), "instant")).when((kind == 1) & (s == 4), before2).otherwise(before)
    rows = views.ledgers(spark, d).withColumn("predecessor_digest", p).select(F.col("ledger_id").alias("lineage_id"), F.col("instant").alias("digest"), "predecessor_digest", F.when(kind == 2, s + 4).otherwise(s).alias("sequence"), s.alias("audit_count"))
    return hierarchy.topology(rows).select("lineage_id", "witnesses", "roots", "forks", "gaps", "status")


# --- hierarchy -----------------------------------------------------------------------------------------------------------

DEPTH = "WITH RECURSIVE unit AS (" + views.ORACLE_VIEWS["unit"] + "), up AS (SELECT u.id, p.id AS parent_id FROM unit u LEFT JOIN unit p ON u.parent_id = p.id), walk AS (SELECT id, id AS root, 0 AS depth FROM up WHERE parent_id IS NULL UNION ALL SELECT up.id, walk.root, walk.depth + 1 FROM walk JOIN up ON up.parent_id = walk.id) "


@query("hierarchy_depth")
def hierarchy_depth(spark, d):
    return hierarchy.depths(views.units(spark, d)).where("resolved").select("id", "root", "depth")


ORACLES["hierarchy_depth"] = DEPTH + "SELECT id, root, CAST(depth AS BIGINT) AS depth FROM walk"


@query("hierarchy_problems")
def hierarchy_problems(spark, d):
    return hierarchy.hierarchy_findings(views.units(spark, d))


ORACLES["hierarchy_problems"] = DEPTH + "SELECT id, 'cycle' AS problem FROM unit WHERE id NOT IN (SELECT id FROM walk) UNION ALL SELECT id, 'missing-parent' FROM unit WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM unit)"


@query("hierarchy_order")
def hierarchy_order(spark, d):
    return hierarchy.preorder(views.units(spark, d))


ORACLES["hierarchy_order"] = (
    "WITH RECURSIVE unit AS (" + views.ORACLE_VIEWS["unit"] + "), own AS (SELECT u.id, p.id AS parent_id FROM unit u LEFT JOIN unit p ON u.parent_id = p.id), ranked AS (SELECT id, parent_id, lpad(row_number() OVER (PARTITION BY parent_id ORDER BY id)::VARCHAR, 10, '0') AS r FROM own), "
    "walk AS (SELECT id, id AS root, 0 AS depth, '' AS trail FROM ranked WHERE parent_id IS NULL UNION ALL SELECT k.id, root, depth + 1, trail || '/' || r FROM walk JOIN ranked k ON k.parent_id = walk.id), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY trail) - 1 AS position FROM walk) SELECT id, root, CAST(depth AS BIGINT) AS depth, position, root || '/' || lpad(position::VARCHAR, 19, '0') AS path FROM placed"
)


@query("orphans", "SELECT id, parent_id FROM unit WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM unit)", "unit")
def orphans(spark, d):
    return hierarchy.orphans(views.units(spark, d))


@query("root_count", "SELECT level, count(*) FILTER (parent_id IS NULL) AS roots, count(*) FILTER (parent_id IS NULL) = 1 AS single FROM unit GROUP BY level", "unit")
def root_count(spark, d):
    return hierarchy.root_counts(views.units(spark, d), "level")


@query("children_per_parent", "SELECT parent_id, count(*) AS children FROM unit WHERE parent_id IS NOT NULL GROUP BY parent_id", "unit")
def children_per_parent(spark, d):
    return hierarchy.children_counts(views.units(spark, d))


# --- snapshots -----------------------------------------------------------------------------------------------------------

DIFF = """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' ELSE 'removed' END AS change, NULL AS field, NULL AS before, NULL AS after FROM snap_a a FULL JOIN snap_b b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL
UNION ALL SELECT a.id, 'changed', 'cents', a.cents::VARCHAR, b.cents::VARCHAR FROM snap_a a JOIN snap_b b ON a.id = b.id WHERE a.cents <> b.cents
UNION ALL SELECT a.id, 'changed', 'status', a.status, b.status FROM snap_a a JOIN snap_b b ON a.id = b.id WHERE a.status <> b.status"""


@query("snapshot_diff", DIFF, "snap_a", "snap_b")
def snapshot_diff(spark, d):
    return snapshots.diff(views.snapshot(spark, d, "a"), views.snapshot(spark, d, "b"), "id", ["status", "priority", "cents"])


@query("snapshot_upsert", "SELECT * FROM snap_b UNION ALL SELECT * FROM snap_a WHERE id NOT IN (SELECT id FROM snap_b)", "snap_a", "snap_b")
def snapshot_upsert(spark, d):
    return snapshots.upsert(views.snapshot(spark, d, "a"), views.snapshot(spark, d, "b"))


@query("snapshot_patch", "SELECT a.id, coalesce(b.status, a.status) AS status, a.priority, a.cents FROM snap_a a LEFT JOIN snap_b b ON a.id = b.id", "snap_a", "snap_b")
def snapshot_patch(spark, d):
    return snapshots.patch(views.snapshot(spark, d, "a"), views.snapshot(spark, d, "b").select("id", "status"))


@query("guarded_delete", "SELECT id FROM unit u WHERE NOT (level = 'file' AND NOT EXISTS (SELECT 1 FROM unit c WHERE c.parent_id = u.id))", "unit")
def guarded_delete(spark, d):
    u = views.units(spark, d)
    return snapshots.delete(u, u.where("level = 'file'"), guard=u.select(F.col("parent_id").alias("id"))).select("id")


@query("rollback", "SELECT id, status, 'rev-3' AS revision_id FROM snap_a", "snap_a")
def rollback(spark, d):
    history = views.snapshot(spark, d, "a").withColumn("revision_id", F.lit("rev-1")).unionByName(views.snapshot(spark, d, "b").withColumn("revision_id", F.lit("rev-2")))
    return snapshots.rollback(history, "rev-1", "rev-3").select("id", "status", "revision_id")


@query("snapshot_equality", "SELECT (SELECT count(*) FROM (SELECT * FROM snap_a EXCEPT ALL SELECT * FROM snap_b)) AS missing, (SELECT count(*) FROM (SELECT * FROM snap_b EXCEPT ALL SELECT * FROM snap_a)) AS extra, (SELECT count(*) FROM (SELECT * FROM snap_a EXCEPT ALL SELECT * FROM snap_b)) + (SELECT count(*) FROM (SELECT * FROM snap_b EXCEPT ALL SELECT * FROM snap_a)) = 0 AS equal", "snap_a", "snap_b")
def snapshot_equality(spark, d):
    return snapshots.same_rows(views.snapshot(spark, d, "a"), views.snapshot(spark, d, "b"))


ENCODED = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("cents", "id", "priority", "status"))
SUMS = ", ".join(f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT::HUGEINT)" for i in range(4))


@query("row_digest", f"SELECT id, sha256({ENCODED}) AS digest FROM snap_a", "snap_a")
def row_digest(spark, d):
    a = views.snapshot(spark, d, "a")
    return a.select("id", digest.row_digest(a.columns).alias("digest"))


@query(
    "snapshot_digest",
    f"SELECT count(*) AS rows, sha256(concat_ws(':', count(*), {SUMS})) AS digest FROM (SELECT sha256({ENCODED}) AS d FROM snap_a)",
    "snap_a",
)
def snapshot_digest(spark, d):
    a = views.snapshot(spark, d, "a")
    return digest.table_digest(a, a.columns)


# --- incidents and reports -------------------------------------------------------------------------------------------------


@query("incident_latest_state", "SELECT incident_id, max_by(state, instant) AS state, count(*) AS events FROM incident GROUP BY incident_id", "incident")
def incident_latest_state(spark, d):
    e = views.incidents(spark, d)
    counts = e.groupBy("incident_id").agg(n("events"))
    return ledger.latest(e, "incident_id", "instant").select("incident_id", "state").join(counts, "incident_id")


@query("open_incidents", "SELECT incident_id, state FROM (SELECT incident_id, max_by(state, instant) AS state FROM incident GROUP BY incident_id) WHERE state <> 'resolved'", "incident")
def open_incidents(spark, d):
    return lists.open_incidents(ledger.latest(views.incidents(spark, d), "incident_id", "instant")).select("incident_id", "state")


@query("unsupported_closures", "SELECT incident_id FROM (SELECT incident_id, max_by(state, instant) AS state, max_by(note, instant) AS note, max_by(owner_role, instant) AS owner_role FROM incident GROUP BY incident_id) WHERE state = 'resolved' AND (trim(note) = '' OR owner_role = 'Unassigned')", "incident")
def unsupported_closures(spark, d):
    last = ledger.latest(views.incidents(spark, d), "incident_id", "instant").withColumns({"notes": F.array("note"), "criterion": F.lit("c")})
    return lists.unsupported_closures(last).select("incident_id")


@query("incident_violations", "SELECT incident_id, instant, CASE WHEN trim(note) = '' THEN 'closure-note' ELSE 'closure-owner' END AS problem FROM incident WHERE state = 'resolved' AND (trim(note) = '' OR owner_role = 'Unassigned')", "incident")
def incident_violations(spark, d):
    return lists.incident_violations(views.incidents(spark, d))


@query("incidents_raised", "SELECT DISTINCT record_id, code, CASE severity WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN code LIKE '%URL%' OR code LIKE '%DOI%' THEN 'Electronic access' WHEN code LIKE '%REQUEST%' THEN 'Fulfillment' ELSE 'Discovery metadata' END AS service FROM finding WHERE NOT (code = 'URL_UNSAFE' AND record_id IN (SELECT id FROM catalog WHERE k % 2 = 0))", *FINDING)
def incidents_raised(spark, d):
    c = views.catalog(spark, d)
    known = c.where("k % 2 = 0").select(F.col("id").alias("record_id"), F.array(F.lit("URL_UNSAFE")).alias("evidence"))
    return lists.incidents_from_findings(rules.catalog_findings(c), known).select("record_id", "code", "severity", "service")


@query("public_projection", "SELECT id, title, format, availability FROM catalog WHERE public_visible AND NOT suppressed", "catalog")
def public_projection(spark, d):
    return views.catalog(spark, d).where("public_visible and not suppressed").select("id", "title", "format", "availability")


@query("inventory_state", "SELECT (SELECT count(*) FROM catalog) AS records, (SELECT count(*) FROM catalog WHERE public_visible) AS published, (SELECT count(*) FROM finding WHERE severity = 'error') AS errors, CASE WHEN (SELECT count(*) FROM finding WHERE severity = 'error') > 0 THEN 'action-required' WHEN (SELECT count(*) FROM finding WHERE severity = 'warning') + (SELECT count(*) FROM incident WHERE state <> 'resolved') > 0 THEN 'review-required' ELSE 'none' END AS state", *FINDING, "incident")
def inventory_state(spark, d):
    c = views.catalog(spark, d)
    f = rules.catalog_findings(c)
    one = lambda df: df.withColumn("one", F.lit(1))
    totals = one(c.agg(n("records"), F.count_if("public_visible").alias("published")))
    state = one(lists.overall_state(f, views.incidents(spark, d)))
    return totals.join(one(f.agg(F.count_if(F.col("severity") == "error").alias("errors"))), "one").join(state, "one").drop("one")


@query("original_vs_canonical", "SELECT id, 'canonical' AS side, 'format' AS name, format AS value FROM catalog UNION ALL SELECT id, 'canonical', 'title', title FROM catalog UNION ALL SELECT id, 'source', '336$b', b336 FROM catalog UNION ALL SELECT id, 'source', '338$b', b338 FROM catalog", "catalog")
def original_vs_canonical(spark, d):
    c = views.catalog(spark, d)
    return reports.original_and_canonical(c, ["title", "format"])


@query("observation_rules")
def observation_rules(spark, d):
    return interop.observation_problems(_observations(spark, d)).groupBy("problem").agg(n("n"))


def _observations(spark, d):
    m = F.col("event_id") % 6
    kind = F.element_at(F.array(*map(F.lit, ("unchanged", "unchanged", "executed", "executed", "dropped", "normalized"))), (m + 1).cast("int"))
    finding = F.element_at(F.array(*map(F.lit, ("none", "none", "hazard", "none", "loss", "loss"))), (m + 1).cast("int"))
    return table(spark, d, "events").select(F.concat(F.lit("c"), (F.col("event_id") % 40).cast("string")).alias("case_id"), F.concat(F.lit("p"), F.when(F.col("event_id") % 200 == 199, F.col("event_id") - 40).otherwise(F.col("event_id")).cast("string")).alias("path"), F.col("event_type").alias("expected"), F.col("event_type").alias("displayed"), F.col("event_type").alias("underlying"), F.when(m == 1, "other").otherwise(F.col("event_type")).alias("reexported"), kind.alias("transformation"), finding.alias("finding"))


ORACLES["observation_rules"] = """
SELECT problem, count(*) AS n FROM (
  SELECT CASE event_id % 6 WHEN 1 THEN 'unchanged-differs' WHEN 3 THEN 'hazard' WHEN 5 THEN 'loss' END AS problem FROM events WHERE event_id % 6 IN (1, 3, 5)
  UNION ALL SELECT 'repeated' FROM events e WHERE event_id % 200 = 199 AND EXISTS (SELECT 1 FROM events f WHERE f.event_id = e.event_id - 40)) GROUP BY problem"""


@query(
    "roundtrip_assessment",
    """SELECT bundle_id, CASE WHEN bool_or(bad OR k % 1201 = 9) THEN 'INVALID' WHEN bool_or(k % 997 = 5) THEN 'OBSOLETE' WHEN bool_or(k % 301 = 7) THEN 'FAILED' WHEN bool_or(k % 205 = 3) THEN 'BLOCKED' WHEN bool_or(k % 11 = 0 AND k % 301 <> 7 AND k % 997 <> 5 AND k % 205 <> 3) THEN 'INCOMPLETE' ELSE 'PASS' END AS status
    FROM (SELECT 'b' || (o_custkey % 50) AS bundle_id, o_orderkey AS k, o_orderkey % 1999 = 1 AND o_orderkey % 6 IN (0, 1) AND o_orderkey IN (SELECT event_id FROM events) AS bad FROM orders) GROUP BY bundle_id""",
)
def roundtrip_assessment(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("b"), (F.col("o_custkey") % 50).cast("string")).alias("bundle_id"), F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderkey").alias("k"))
    seen = o.where("k % 11 <> 0 or k % 301 = 7 or k % 997 = 5 or k % 205 = 3 or k % 1201 = 9")
    results = seen.select("bundle_id", "case_id", F.when(F.col("k") % 301 == 7, "fail").when(F.col("k") % 205 == 3, "blocked").otherwise("pass").alias("outcome"), (F.col("k") % 997 != 5).alias("current"))
    observed = _observations(spark, d).withColumn("case_id", F.col("path").substr(F.lit(2), F.lit(20))).where("transformation = 'unchanged'").dropDuplicates(["case_id"])
    differs = F.col("case_id").cast("long") % 1999 == 1
    observed = observed.withColumn("reexported", F.when(differs, "other").otherwise(F.col("expected")))
    unasked = table(spark, d, "events").select(F.col("event_id").cast("string").alias("case_id"))
    mine = observed.join(unasked, "case_id", "left_semi")
    return interop.assess(o.where("k % 1201 <> 9").select("bundle_id", "case_id"), results, mine)
