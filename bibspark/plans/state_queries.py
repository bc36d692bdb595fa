"""Registered queries of running state, nested contracts and life cycles: deep trees, element structure, stored records,
receipts, incidents and ledgers that arrive out of order."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibspark.operators import contracts, evidence, hierarchy, interop, lists, scan, search, snapshots, tables
from bibspark.plans import crosswalk, views
from bibspark.plans.more_queries import _records, _run
from bibspark.plans.queries import _mark, query
from bibspark.plans.views import table
from bibspark.sources import jsons, structure, tagged
from bibspark.streaming import intake

# --- trees of any depth ----------------------------------------------------------------------------------------------


@query("deep_order", "SELECT ledger_id || ':' || sequence AS id, ledger_id || ':1' AS root, sequence - 1 AS depth, sequence - 1 AS position FROM ledger", "ledger")
def deep_order(spark, d):
    """Every ledger as one branch as deep as it is long."""
    e = views.ledgers(spark, d)
    key = lambda s: F.concat_ws(":", "ledger_id", s.cast("string"))
    units = e.select(key(F.col("sequence")).alias("id"), F.when(F.col("sequence") > 1, key(F.col("sequence") - 1)).alias("parent_id"))
    return hierarchy.preorder(units).select("id", "root", "depth", "position")


# --- structure of XML files ------------------------------------------------------------------------------------------

BAD = {"c_custkey % 11 = 3": "<odd><p>x</p><head>h</head></odd>", "c_custkey % 13 = 4": "<odd/>", "c_custkey % 17 = 5": "<nickname/>", "c_custkey % 19 = 6": "<y:odd><p/></y:odd>"}


def _documents(spark, d, tag: str):
    """EAD files, one a nation: customers as components, groups of them by market segment; some with a defect."""
    c = table(spark, d, "customer")
    own = F.concat(F.lit('<c id="C'), "c_custkey", F.when(F.col("c_custkey") % 7 == 2, '" colour="red').otherwise(""), F.lit('" level="file"><did><unittitle>'), F.regexp_replace("c_name", "#", " &lt;"), F.lit("</unittitle></did>"))
    for test, piece in BAD.items():
        own = F.concat(own, F.when(F.expr(test), piece).otherwise(""))
    own = F.concat(own, F.when(F.col("c_custkey") % 23 == 7, "said</c>").otherwise("</c>"))
    rows = c.select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), F.lit(1).alias("o"), F.col("c_custkey").alias("k"), own.alias("line"))
    groups = c.select("c_nationkey", "c_mktsegment").distinct()
    opened = groups.select("c_nationkey", "c_mktsegment", F.lit(0), F.lit(0).cast("long"), F.concat(F.lit('<c id="G'), "c_nationkey", "c_mktsegment", F.lit('" level="series">')))
    closed = groups.select("c_nationkey", "c_mktsegment", F.lit(2), F.lit(0).cast("long"), F.lit("</c>"))
    tops = c.select("c_nationkey").distinct()
    first = tops.select("c_nationkey", F.lit(""), F.lit(0), F.lit(0).cast("long"), F.concat(F.lit('<ead xmlns="urn:ead"><archdesc id="N'), "c_nationkey", F.lit('" level="fonds"><!-- <c> --><dsc>')))
    last = tops.select("c_nationkey", F.lit("~"), F.lit(0), F.lit(0).cast("long"), F.lit("</dsc></archdesc></ead>"))
    lines = rows.union(opened).union(closed).union(first).union(last)
    folder = tables.new_folder(spark, tag)
    lines.repartition("n").sortWithinPartitions("n", "s", "o", "k").select("n", "line").write.partitionBy("n").text(folder)  # a document is one file by its format
    return folder


def _nation(path):
    return F.regexp_extract(path, r"/n=(\d+)/", 1).cast("int").alias("nation")


@query(
    "element_structure",
    """SELECT c_nationkey AS nation, problem, detail, count(*) AS n FROM customer, (VALUES ('order', 'head', 11, 3), ('count', 'p', 13, 4), ('element', 'nickname', 17, 5), ('namespace', 'y', 19, 6), ('attribute', 'colour of c', 7, 2), ('mixed-text', 'c', 23, 7)) v(problem, detail, m, r)
    WHERE c_custkey % m = r GROUP BY c_nationkey, problem, detail""",
)
def element_structure(spark, d):
    rows = structure.elements(structure.tag_stream(spark, _documents(spark, d, "structure")))
    found = structure.structure_rejects(rows, structure.ead_profile(), ("urn:ead",))
    return found.groupBy(_nation("path"), "problem", "detail").agg(F.count("*").alias("n"))


@query(
    "ead_files",
    """SELECT c_nationkey AS nation, 'C' || c_custkey AS unit_id, 'G' || c_nationkey || c_mktsegment AS parent_id, 3 AS depth, 'file' AS level, replace(c_name, '#', ' <') AS title FROM customer
    UNION ALL SELECT DISTINCT c_nationkey, 'G' || c_nationkey || c_mktsegment, 'N' || c_nationkey, 2, 'series', NULL FROM customer
    UNION ALL SELECT DISTINCT c_nationkey, 'N' || c_nationkey, NULL, 1, 'fonds', NULL FROM customer""",
)
def ead_files(spark, d):
    """Documents read as streams of tags, so that each is as many tasks' work as it has ranges."""
    units, values = structure.read_ead_files(spark, _documents(spark, d, "files"), "*.txt")
    titles = values.where("field_id = 'title'").select("path", "unit_id", F.col("s").alias("title"))
    return units.join(titles, ["path", "unit_id"], "left").select(_nation("path"), "unit_id", "parent_id", F.col("depth").cast("int").alias("depth"), "level", "title")


# --- contracts of stored records -------------------------------------------------------------------------------------


def _member(name, value):
    return F.concat(F.lit(f'"{name}":'), value if not isinstance(value, str) else F.lit(value))


def _text(value):
    return F.concat(F.lit('"'), value, F.lit('"'))


def _object(*members):
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _repeated(value, n):
    """A JSON list of n equal values."""
    return F.concat(F.lit("["), F.array_join(F.array_repeat(value, n.cast("int")), ","), F.lit("]"))


@query(
    "record_contracts",
    """SELECT id, path, rule FROM (SELECT p_partkey AS id, p_partkey AS k, * FROM part), LATERAL (
      SELECT 'title' AS path, 'too-long' AS rule WHERE length(p_name) * (k % 120) > 1024
      UNION ALL SELECT 'creators', 'too-many' WHERE p_size > 48
      UNION ALL SELECT 'metadata.volume', 'too-long' WHERE length(p_type) * (k % 12) > 64
      UNION ALL SELECT 'metadata.subjects', 'too-many' WHERE k % 130 > 100
      UNION ALL SELECT 'metadata.' || lower(p_type), 'unknown-key' WHERE k % 41 = 5
      UNION ALL SELECT 'identifiers[0].scheme', 'value' WHERE p_brand LIKE '%7'
      UNION ALL SELECT 'identifiers[1].value', 'blank' WHERE k % 29 = 4
      UNION ALL SELECT 'links[0]', 'url' WHERE k % 31 = 6
      UNION ALL SELECT 'format', 'value' WHERE p_type NOT IN ('ECONOMY')
      UNION ALL SELECT 'suppressed', 'not-boolean' WHERE k % 37 = 7
      UNION ALL SELECT 'edition', 'missing' WHERE k % 43 = 8
      UNION ALL SELECT 'source.trace.TI', 'not-text' WHERE k % 47 = 9
      UNION ALL SELECT 'source.ordinal', CASE WHEN p_retailprice <> floor(p_retailprice) THEN 'not-whole' ELSE 'range' END WHERE p_retailprice <> floor(p_retailprice) OR p_retailprice > 1000
    )""",
)
def record_contracts(spark, d):
    """Stored catalog records as JSON, whose members are made of the part's own values."""
    p, k = tables.spread(table(spark, d, "part"), "p_partkey"), F.col("p_partkey")
    ident = lambda s, v: _object(_member("scheme", _text(s)), _member("value", _text(v)))
    metadata = _object(
        _member("volume", _text(F.repeat("p_type", (k % 12).cast("int")))),
        _member("subjects", _repeated(_text(F.col("p_brand")), k % 130)),
        F.when(k % 41 == 5, F.concat(F.lit('"'), F.lower("p_type"), F.lit('":""'))),
    )
    source = _object(F.lit('"format":"ris","label":"l","digest":"d"'), _member("ordinal", F.col("p_retailprice").cast("decimal(12,2)").cast("string")), _member("trace", F.when(k % 47 == 9, '{"TI":5}').otherwise('{"TI":"x"}')))
    json = _object(
        _member("id", _text(F.concat(F.lit("P-"), k.cast("string")))),
        _member("title", _text(F.repeat("p_name", (k % 120).cast("int")))),
        _member("creators", _repeated(_text(F.col("p_brand")), F.col("p_size") + 2)),
        F.lit('"year":"2020"'),
        _member("format", _text(F.when(F.col("p_type") == "ECONOMY", "Book").otherwise(F.initcap("p_type")))),
        _member("identifiers", F.concat(F.lit("["), ident(F.when(F.col("p_brand").endswith("7"), "ean").otherwise("isbn"), F.col("p_brand")), F.lit(","), ident(F.lit("doi"), F.when(k % 29 == 4, "  ").otherwise(F.col("p_name"))), F.lit("]"))),
        _member("links", F.concat(F.lit('["'), F.when(k % 31 == 6, "http://10.0.0.1/").otherwise("https://example.org/"), k.cast("string"), F.lit('"]'))),
        F.lit('"availability":"Online","location":"","publicVisible":true,"requestable":false'),
        F.when(k % 43 != 8, F.lit('"edition":""')),
        _member("suppressed", F.when(k % 37 == 7, '"yes"').otherwise("false")),
        _member("metadata", metadata),
        _member("source", source),
    )
    return contracts.broken(p.select(k.alias("id"), json.alias("json")), contracts.STORED_RECORD, "json", "id")


STAMPS = '"createdAt":"2024-01-01T00:00:00Z"'


@query(
    "archive_contracts",
    """SELECT 'unit' AS kind, c_custkey AS id, path, rule FROM customer, LATERAL (
      SELECT 'values.' || lower(c_mktsegment) AS path, 'too-many' AS rule WHERE c_custkey % 300 > 250
      UNION ALL SELECT 'values.' || lower(c_mktsegment) || '[1]', 'not-scalar' WHERE c_acctbal < 0 AND c_custkey % 300 > 1
      UNION ALL SELECT 'values.constructor', 'forbidden-key' WHERE c_nationkey = 13
      UNION ALL SELECT 'updatedAt', 'instant' WHERE c_custkey % 31 = 30
      UNION ALL SELECT 'parentId', 'not-text' WHERE c_custkey % 9 = 8
      UNION ALL SELECT 'schemaVersion', 'not-whole' WHERE c_acctbal <> floor(c_acctbal))
    UNION ALL SELECT 'schema', s_suppkey, path, rule FROM supplier, LATERAL (
      SELECT 'fields' AS path, 'too-many' AS rule WHERE s_suppkey % 140 > 128
      UNION ALL SELECT 'fields[' || i || '].required', 'not-boolean' FROM range(0, s_suppkey % 140) t(i) WHERE i % 50 = 49
      UNION ALL SELECT 'name', 'too-long' WHERE length(s_name) * (s_suppkey % 10) > 120
      UNION ALL SELECT 'fields[0].mappings.marc', 'unknown-key' WHERE s_suppkey % 8 = 3)""",
)
def archive_contracts(spark, d):
    """Stored units and schemas as JSON."""
    c, k = tables.spread(table(spark, d, "customer"), "c_custkey"), F.col("c_custkey")
    cells = F.transform(F.sequence(F.lit(1), F.greatest((k % 300).cast("int"), F.lit(1))), lambda i: F.when((F.col("c_acctbal") < 0) & (i == 2), '{"x":1}').otherwise(_text(i.cast("string"))))
    values = _object(F.concat(F.lit('"'), F.lower("c_mktsegment"), F.lit('":['), F.array_join(cells, ","), F.lit("]")), F.when(F.col("c_nationkey") == 13, '"constructor":1'))
    day = F.concat(F.lit('"2024-02-'), F.lpad((k % 31).cast("string"), 2, "0"), F.lit('T00:00:00Z"'))
    unit = _object(
        _member("id", _text(k.cast("string"))), F.lit('"schemaId":"s","level":"file"'), _member("schemaVersion", F.col("c_acctbal").cast("decimal(12,2)").cast("string")), _member("parentId", F.when(k % 9 == 8, "5").otherwise("null")),
        _member("values", values), F.lit(STAMPS), _member("updatedAt", F.when(k % 31 == 30, day).otherwise('"2024-02-29T00:00:00Z"')),
    )
    units = contracts.broken(c.select(F.lit("unit").alias("kind"), k.alias("id"), unit.alias("json")), contracts.STORED_UNIT, "json", "kind", "id")
    s, j = tables.spread(table(spark, d, "supplier"), "s_suppkey"), F.col("s_suppkey")
    odd = F.when(j % 8 == 3, '{"marc":"x"}').otherwise('{"ead":"x"}')
    one = lambda i: F.concat(F.lit('{"id":"f","label":"l","definition":"","kind":"text","repeatable":true,"vocabulary":["a"],"required":'), F.when(i % 50 == 0, "1").otherwise("true"), F.lit(',"mappings":'), F.when(i == 1, odd).otherwise("{}"), F.lit("}"))
    fields = F.concat(F.lit("["), F.array_join(F.when(j % 140 > 0, F.transform(F.sequence(F.lit(1), F.greatest((j % 140).cast("int"), F.lit(1))), one)).otherwise(F.array()), ","), F.lit("]"))
    schema = _object(_member("id", _text(j.cast("string"))), _member("name", _text(F.repeat("s_name", (j % 10).cast("int")))), F.lit('"description":"","profile":"ead4","version":1,"updatedAt":"2024-01-01T00:00:00Z"'), F.lit(STAMPS), _member("fields", fields))
    return units.unionByName(contracts.broken(s.select(F.lit("schema").alias("kind"), j.alias("id"), schema.alias("json")), contracts.STORED_SCHEMA, "json", "kind", "id"))


@query(
    "service_contracts",
    """SELECT event_id AS id, path, rule FROM events, LATERAL (
      SELECT 'values.k' AS path, 'not-scalar' AS rule WHERE event_type = 'error'
      UNION ALL SELECT 'title', 'too-long' WHERE length(props) * (event_id % 60) > 500
      UNION ALL SELECT 'ownerRole', 'not-text' WHERE event_type = 'click' AND event_id % 5 = 2
      UNION ALL SELECT event_type, 'unknown-key' WHERE event_id % 17 = 3
      UNION ALL SELECT 'state', 'missing' WHERE event_id % 23 = 4)""",
)
def service_contracts(spark, d):
    """Stored service records as JSON; the values are those of the event."""
    e, k = tables.spread(table(spark, d, "events").select("event_id", "event_type", "props"), "event_id"), F.col("event_id")
    inner = F.get_json_object("props", "$.k")
    values = _object(_member("k", F.when(F.col("event_type") == "error", F.concat(F.lit('{"v":'), inner, F.lit("}"))).otherwise(F.concat(F.lit("["), inner, F.lit(',true,"x"]')))))
    plain = F.regexp_replace("props", '"', "'")
    json = _object(
        _member("id", _text(k.cast("string"))), F.lit('"kind":"k","area":"a","system":"","sensitivity":"low","updatedAt":"2024-01-01T00:00:00Z"'), F.lit(STAMPS), _member("title", _text(F.repeat(plain, (k % 60).cast("int")))),
        F.when(k % 23 != 4, F.lit('"state":"ok"')), _member("ownerRole", F.when((F.col("event_type") == "click") & (k % 5 == 2), "7").otherwise('"o"')), F.when(k % 17 == 3, F.concat(F.lit('"'), "event_type", F.lit('":1'))), _member("values", values),
    )
    return contracts.broken(e.select(k.alias("id"), json.alias("json")), contracts.STORED_SERVICE, "json", "id")


# --- receipts, incidents, ledgers out of order -----------------------------------------------------------------------


@query(
    "receipt_checks",
    """WITH o AS (SELECT o_orderkey AS k, 'C' || o_custkey AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
    a AS (SELECT w, n AS seq, md5(w || ':' || n) AS digest FROM o WHERE n % 5 <> 4), top AS (SELECT w, max(seq) AS last FROM a GROUP BY w),
    r AS (SELECT k, CASE WHEN k % 13 = 1 THEN 'X' || w ELSE w END AS w, CASE WHEN k % 17 = 2 THEN 'other' ELSE 'main' END AS l, CASE WHEN k % 7 = 3 THEN n + 100 ELSE n END AS n, CASE WHEN k % 11 = 4 THEN 'wrong' ELSE md5(w || ':' || n) END AS digest, CASE WHEN k % 19 = 5 THEN n + 1 ELSE n END AS point FROM o)
    SELECT k AS id, CASE WHEN top.w IS NULL THEN 'workspace' WHEN l <> 'main' THEN 'lineage' WHEN r.n > top.last THEN 'ahead' WHEN a.seq IS NULL THEN 'sequence' WHEN a.digest <> r.digest THEN 'digest' WHEN point <> r.n THEN 'checkpoint' WHEN r.n < top.last THEN 'stale' END AS refused
    FROM r LEFT JOIN top ON top.w = r.w LEFT JOIN a ON a.w = r.w AND a.seq = r.n""",
)
def receipt_checks(spark, d):
    """Orders as anchors of their customer's lineage, some left out, and as receipts that were given for them."""
    w = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), w.alias("workspace_id"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    o = scan.running(o, ["workspace_id"], ["at"], place="sequence").drop("at")
    k, n = F.col("k"), F.col("sequence")
    digest = F.md5(F.concat_ws(":", "workspace_id", n.cast("string")).cast("binary"))
    point = lambda g: F.struct(g.alias("generation"))
    anchors = o.where("sequence % 5 <> 4").select("workspace_id", F.lit("main").alias("lineage_id"), "sequence", digest.alias("digest"), point(n).alias("checkpoint"))
    receipts = o.select(
        k.alias("id"), F.when(k % 13 == 1, F.concat(F.lit("X"), "workspace_id")).otherwise(F.col("workspace_id")).alias("workspace_id"), F.when(k % 17 == 2, "other").otherwise("main").alias("lineage_id"), F.when(k % 7 == 3, n + 100).otherwise(n).alias("sequence"),
        F.when(k % 11 == 4, "wrong").otherwise(digest).alias("anchor_digest"), point(F.when(k % 7 == 3, n + 100).otherwise(n) + F.when((k % 19 == 5), 1).otherwise(0)).alias("checkpoint"),
    )
    return evidence.receipt_checks(receipts, anchors)


@query(
    "incident_states",
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY instant, state, owner_role, next_action, note) AS n FROM (
        SELECT user_id::VARCHAR AS incident_id, event_id AS instant, CASE event_id % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'investigating' WHEN 2 THEN 'monitoring' WHEN 3 THEN 'closed' WHEN 4 THEN 'resolved' END AS state,
          CASE event_id % 5 WHEN 1 THEN 'desk ' || event_type WHEN 2 THEN 'UNASSIGNED' WHEN 3 THEN '' END AS owner_role, CASE event_id % 4 WHEN 1 THEN 'check ' || event_type WHEN 2 THEN '' END AS next_action, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN ' ' END AS note FROM events)),
    fold(incident_id, n, instant, refused, state, owner_role, next_action, notes) AS (
      SELECT DISTINCT incident_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 'open', 'Unassigned', '', 0::BIGINT FROM e
      UNION ALL SELECT incident_id, n, instant, bad, CASE WHEN bad IS NULL THEN s ELSE state END, CASE WHEN bad IS NULL THEN o ELSE owner_role END, CASE WHEN bad IS NULL THEN a ELSE next_action END, CASE WHEN bad IS NULL THEN c ELSE notes END FROM (
        SELECT *, CASE WHEN given NOT IN ('open', 'investigating', 'monitoring', 'resolved') THEN 'state-invalid' WHEN s <> 'resolved' THEN NULL WHEN state <> 'resolved' AND NOT noted THEN 'closure-note' WHEN state = 'resolved' AND (o <> owner_role OR a <> next_action) AND NOT noted THEN 'edit-note'
          WHEN o = '' OR lower(o) = 'unassigned' THEN 'owner' WHEN a = '' THEN 'action' WHEN c = 0 THEN 'evidence' END AS bad FROM (
          SELECT e.incident_id, e.n, e.instant, e.state AS given, coalesce(e.state, f.state) AS s, coalesce(e.owner_role, f.owner_role) AS o, coalesce(e.next_action, f.next_action) AS a, trim(coalesce(note, '')) <> '' AS noted, f.notes + CASE WHEN trim(coalesce(note, '')) <> '' THEN 1 ELSE 0 END AS c, f.state, f.owner_role, f.next_action, f.notes
          FROM fold f JOIN e ON e.incident_id = f.incident_id AND e.n = f.n + 1)))
    SELECT incident_id, instant, refused, state, owner_role, next_action, notes FROM fold WHERE n > 0""",
)
def incident_states(spark, d):
    """Events of a user as patches of one incident."""
    k, kind = F.col("event_id"), F.col("event_type")
    pick = lambda m, values: F.element_at(F.array(*[v if v is not None else F.lit(None).cast("string") for v in values]), (k % m + 1).cast("int"))
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("incident_id"), k.alias("instant"), pick(6, [*map(F.lit, ("resolved", "investigating", "monitoring", "closed", "resolved")), None]).alias("state"), pick(5, [None, F.concat(F.lit("desk "), kind), F.lit("UNASSIGNED"), F.lit(""), None]).alias("owner_role"),
        pick(4, [None, F.concat(F.lit("check "), kind), F.lit(""), None]).alias("next_action"), pick(3, [kind, F.lit(" "), None]).alias("note"),
    )
    return lists.incident_states(rows)


DELAY = "10000 days"  # events are a second apart and come in any order: none may be late, and the clock's event lies 26,000 days ahead


@query(
    "stream_ledger_order",
    """SELECT * FROM (WITH e AS (SELECT *, instant::BIGINT AS k, sha256(ledger_id || '|' || sequence || '|' || instant || '|' || action) AS mark, lag(hash) OVER (PARTITION BY ledger_id ORDER BY sequence) AS prior FROM ledger), kept AS (SELECT * FROM e WHERE k % 53 <> 7),
    near AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY ledger_id ORDER BY sequence), 0) AS before FROM kept)
    SELECT ledger_id, sequence, CASE WHEN before + 1 <> sequence THEN 'gap' WHEN previous_hash <> coalesce(prior, 'GENESIS') THEN 'link' ELSE 'content' END AS problem FROM near
    WHERE before + 1 <> sequence OR previous_hash <> coalesce(prior, 'GENESIS') OR hash <> mark UNION ALL SELECT ledger_id, sequence, 'repeat' FROM kept WHERE k % 71 = 3)""",
    "ledger",
)
def stream_ledger_order(spark, d):
    """Ledgers dealt over three micro-batches by a hash, without some events and with some twice; a last event of a ledger
    of its own moves the clock on, so that all gaps close."""
    e = views.ledgers(spark, d).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("instant").cast("long")))
    k = F.col("instant").cast("long")
    kept = e.where(k % 53 != 7).withColumn("part", F.pmod(F.xxhash64("instant"), F.lit(3)).cast("int"))
    kept = kept.unionByName(kept.where(k % 71 == 3).withColumn("part", F.lit(3)))
    none = F.lit("")
    clock = spark.range(1).select(F.lit("~clock").alias("ledger_id"), F.lit(1).cast("long").alias("sequence"), none.alias("instant"), none.alias("action"), none.alias("target"), none.alias("state_digest"), none.alias("mark"), F.lit("GENESIS").alias("previous_hash"), none.alias("hash"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("at"), F.lit(4).alias("part"))
    folder = tables.new_folder(spark, "unordered")
    arrivals = tables.stage(kept.unionByName(clock), "arrivals")
    for i in range(5):  # files of a later micro-batch are newer; each is many tasks' work
        tables.spread(arrivals.where(F.col("part") == i), "ledger_id").write.mode("append").parquet(folder)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", tables.many_tasks(spark)).parquet(folder)
        return _run(intake.verify_ledger_stream(stream, F.when(F.col("ledger_id") == "~clock", F.lit("")).otherwise(_mark()), "at", DELAY), "verdicts")
    finally:
        spark.conf.set(provider, before)


# --- search by an index, stored revisions, large arrays, losses of a format ------------------------------------------

HAY = "lower(concat_ws(' ', id, title, creator, isbn, doi, CASE WHEN carrier IS NOT NULL THEN 'https://doi.org/10.1234/PART.' || (k + 5) END, isbn2))"


@query("catalog_search_index", f"SELECT q AS query, k, id FROM catalog, (VALUES ('brand#1'), ('widget brand'), ('ng'), ('10.1234/part.10')) v(q) WHERE contains({HAY}, q)", "catalog")
def catalog_search_index(spark, d):
    """Searches by way of one index; the one of two letters scans."""
    records, folder, out = views.catalog(spark, d), tables.new_folder(spark, "grams"), None
    search.build_index(records, folder, key="k")
    for q in ("brand#1", "Widget Brand", "ng", "10.1234/PART.10"):
        rows = search.indexed_search(records, folder, q, key="k").select(F.lit(q.lower()).alias("query"), "k", "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stored_revisions", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM snap_a a FULL JOIN snap_b b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.cents <> b.cents OR a.status <> b.status GROUP BY ALL", "snap_a", "snap_b")
def stored_revisions(spark, d):
    """Two revisions in bucketed tables: their difference takes no shuffle."""
    name = lambda w: f"revision_{w}_{tables.uuid.uuid4().hex}"
    a, b = (snapshots.store(views.snapshot(spark, d, w), name(w), "id", 8) for w in "ab")
    return snapshots.diff(a, b, "id", ["status", "priority", "cents"]).select("id", "change").distinct().withColumn("n", F.lit(1).cast("long"))


@query("large_arrays", """SELECT (p_partkey % 4)::INT AS file, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) AS ordinal, p_partkey AS id, CASE WHEN p_partkey % 9 = 2 THEN NULL ELSE p_name || ' "' || p_brand || '", [' || p_type || '\\] {:' END AS name FROM part""")
def large_arrays(spark, d):
    """Arrays in files that are cut wherever a quote stands; names hold quotes, brackets and backslashes."""
    k = F.col("p_partkey")
    name = F.to_json(F.struct(F.concat(F.col("p_name"), F.lit(' "'), F.col("p_brand"), F.lit('", ['), F.col("p_type"), F.lit("\\] {:")).alias("name")))
    item = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(', "in":[[], {"x":[1,"]"]}], "n":'), F.when(k % 9 == 2, "null").otherwise(name), F.lit("}"))
    p = table(spark, d, "part").withColumn("file", (k % 4).cast("int"))
    last = scan.running(p.select("file", k, item.alias("item")), ["file"], [F.desc("p_partkey")], place="back")
    lines = last.select("file", F.lit(1).alias("o"), F.col("p_partkey").alias("k"), F.concat("item", F.when(F.col("back") > 1, ",").otherwise("")).alias("line"))
    ends = p.select("file").distinct()
    lines = lines.union(ends.select("file", F.lit(0), F.lit(0).cast("long"), F.lit('{"records": 1, "x": [1, "a"], "items": ['))).union(ends.select("file", F.lit(2), F.lit(0).cast("long"), F.lit('], "items2": [2]}')))
    folder = tables.new_folder(spark, "arrays")
    lines.repartition("file").sortWithinPartitions("file", "o", "k").select("file", "line").write.partitionBy("file").text(folder)  # an array is one file by its format
    found = jsons.read_large_array(spark, folder, "*.txt", "items")
    v = F.parse_json("json")
    return found.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("int").alias("file"), "ordinal", F.try_variant_get(v, "$.id", "long").alias("id"), F.try_variant_get(v, "$.n.name", "string").alias("name"))


@query(
    "roundtrip_losses",
    """SELECT id, field, sent, back FROM (SELECT 'f' || k AS id, * EXCLUDE (id) FROM catalog), LATERAL (
      SELECT 'identifiers' AS field, '{"v":[' || concat_ws(',', own, two, three, four) || ']}' AS sent, '{"v":[' || concat_ws(',', two, own, four) || ']}' AS back FROM (SELECT '{"scheme":"isbn","value":"' || isbn || '"}' AS own, '{"scheme":"doi","value":"' || doi || '"}' AS two, CASE WHEN carrier IS NOT NULL THEN '{"scheme":"local","value":"https://doi.org/10.1234/PART.' || (k + 5) || '"}' END AS three, '{"scheme":"isbn","value":"' || isbn2 || '"}' AS four)
      UNION ALL SELECT 'extent', '{"v":"' || creator || ' p."}', '{"v":""}'
      UNION ALL SELECT 'coverage', '{"v":"' || b336 || '"}', '{"v":""}') WHERE sent <> back""",
    "catalog",
)
def roundtrip_losses(spark, d):
    """What records lose on their way through RIS: other identifiers, the order of those that it has, and fields without a tag."""
    sent = _records(spark, d).withColumn("id", F.col("path")).withColumn("extent", F.concat(F.get("creators", F.lit(0)), F.lit(" p.")))
    kinds = views.catalog(spark, d).select(F.concat(F.lit("f"), "k").alias("path"), F.col("trace")["336$b"].alias("coverage"))
    sent = sent.drop("coverage").join(kinds, "path")
    back = tagged.read_ris(crosswalk.ris(sent).select(F.col("id").alias("path"), F.col("out").alias("text")))
    keep = ["id", "title", "creators", "format", "identifiers", "links", "extent", "coverage"]
    return interop.field_differences(sent.select(*keep), back.select(*keep))
