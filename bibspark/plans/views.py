"""Deterministic domain views over the driver's tables; ORACLE_VIEWS has the same in DuckDB SQL, written independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.operators import ledger
from bibspark.operators.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog records from parts; defects are fixed functions of the key."""
    k = F.col("k")
    base = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", "p_size"), "k")
    twin = F.when((k % 11 == 0) & (k > 0), k - 1).otherwise(k)
    digits = F.concat(F.lit("978"), F.lpad(twin.cast("string"), 9, "0"))
    weighted = sum((F.substring(digits, i, 1).cast("int") * (1 if i % 2 else 3) for i in range(2, 13)), F.substring(digits, 1, 1).cast("int"))
    check = (10 - weighted % 10) % 10
    isbn = F.concat(digits, F.when(k % 7 == 0, (check + 1) % 10).otherwise(check).cast("string"))
    ident = lambda scheme, value: F.struct(F.lit(scheme).alias("scheme"), value.alias("value"))
    key = k.cast("string")
    identifiers = F.array_compact(
        F.array(
            ident("isbn", isbn),
            F.when(k % 5 == 0, ident("doi", F.when(k % 15 == 0, F.lit("10.12/x y")).otherwise(F.concat(F.lit("10.1234/part."), key)))),
            F.when(k % 20 == 0, ident("local", F.concat(F.lit("https://doi.org/10.1234/PART."), (k + 5).cast("string")))),
            F.when(k % 33 == 0, ident("isbn", isbn)),
        )
    )
    hosts = ["http://example.org/", "https://user:pw@example.org/", "https://10.0.0.1/", "https://example.org/?api_key=", "https://localhost/", "https://example.org./", "https://[2001:db8::1]/", "https://intranet/"]
    link = F.lit("https://example.org/item/")
    for i, h in enumerate(hosts):
        link = F.when(k % 37 == i, F.lit(h)).otherwise(link)
    kinds = {"ECONOMY": "Book", "STANDARD": "Article", "SMALL": "Video", "MEDIUM": "Map", "LARGE": "Online book"}
    fmt = F.lit("Other")
    for a, b in kinds.items():
        fmt = F.when(F.col("p_type") == a, b).otherwise(fmt)
    return base.select(
        k,
        F.when((k % 101 == 0) & (k > 0), F.concat(F.lit("P-"), (k - 1).cast("string"))).when(k % 127 == 0, F.concat(F.lit("bad id "), key)).otherwise(F.concat(F.lit("P-"), key)).alias("id"),
        F.when(k % 53 == 0, "").otherwise(F.concat_ws(" ", "p_name", F.col("p_brand"), F.col("p_size").cast("string"))).alias("title"),
        F.array("p_brand").alias("creators"),
        fmt.alias("format"),
        identifiers.alias("identifiers"),
        F.array(F.concat(link, key)).alias("links"),
        F.element_at(F.array(*map(F.lit, ("Available", "Online", "Unavailable", "Check availability"))), (k % 4 + 1).cast("int")).alias("availability"),
        F.when(k % 8 == 1, "Online").otherwise("Stacks").alias("location"),
        ((F.col("p_size") % 2 == 0) & (k % 13 == 0)).alias("suppressed"),
        (k % 3 != 1).alias("public_visible"),
        (k % 6 != 0).alias("requestable"),
        F.create_map(F.lit("336$b"), F.when(k % 2 == 0, "txt").otherwise("tdi"), F.lit("338$b"), F.when(k % 3 == 0, "cr").otherwise("nc")).alias("trace"),
        F.concat(F.lit("file-"), (k % 17).cast("string")).alias("file"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent_id, level, root): region, nation, customer, order; some orders point to a missing parent, and four
    literal units form a cycle with a tail."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("fonds").alias("level"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.lit("series"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), F.lit("file"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey"), F.when(F.col("o_orderkey") % 499 == 0, F.concat(F.lit("X"), "o_custkey")).otherwise(F.concat(F.lit("C"), "o_custkey")), F.lit("item"))
    loop = spark.createDataFrame([("Z1", "Z2", "other"), ("Z2", "Z3", "other"), ("Z3", "Z1", "other"), ("Z4", "Z1", "other")], "id string, parent_id string, level string")
    return r.union(n).union(c).union(o).union(loop)


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of suppliers and customers in long form: (unit_id, schema_id, field_id, value_index, s, n, b)."""
    none = lambda t: F.lit(None).cast(t)

    def rows(df, unit, schema, field, s=None, n=None, b=None, where="true"):
        return df.where(where).select(unit.alias("unit_id"), F.lit(schema).alias("schema_id"), F.lit(field).alias("field_id"), F.lit(0).alias("value_index"), (s if s is not None else none("string")).alias("s"), (n if n is not None else none("double")).alias("n"), (b if b is not None else none("boolean")).alias("b"))

    s = table(spark, sf_dir, "supplier")
    c = table(spark, sf_dir, "customer")
    su, cu = F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("C"), "c_custkey")
    key = F.col("c_custkey")
    date = F.concat(F.lit("2024-"), F.lpad((key % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((key % 31 + 1).cast("string"), 2, "0"))
    parts = [
        rows(s, su, "sup", "title", s=F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit(" "), "s_name")).otherwise(F.col("s_name"))),
        rows(s, su, "sup", "balance", n=F.col("s_acctbal")),
        rows(s, su, "sup", "active", b=F.col("s_acctbal") > 0, where="s_suppkey % 4 <> 0"),
        rows(c, cu, "cus", "title", s=F.col("c_name"), where="c_custkey % 9 <> 0"),
        rows(c, cu, "cus", "segment", s=F.col("c_mktsegment")),
        rows(c, cu, "cus", "since", s=date),
        rows(c, cu, "cus", "count", n=F.col("c_acctbal"), where="c_custkey % 5 = 0"),
        rows(c, cu, "cus", "checksum", s=F.concat(F.lit("md5:"), F.when(key % 6 == 0, F.md5(F.col("c_name").cast("binary"))).otherwise("00")), where="c_custkey % 3 = 0"),
        rows(c, cu, "cus", "mystery", s=F.lit("x"), where="c_custkey % 50 = 7"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fields(spark: SparkSession) -> DataFrame:
    """Field definitions of the two schemas."""
    rows = [
        ("sup", "title", "text", True, False, []),
        ("sup", "balance", "decimal", False, False, []),
        ("sup", "active", "boolean", True, False, []),
        ("cus", "title", "text", True, False, []),
        ("cus", "segment", "controlled-term", False, False, ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]),
        ("cus", "since", "date", False, False, []),
        ("cus", "count", "integer", False, False, []),
        ("cus", "checksum", "checksum", False, False, []),
    ]
    return spark.createDataFrame(rows, "schema_id string, field_id string, kind string, required boolean, repeatable boolean, vocabulary array<string>")


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit ledgers of users from events. Hash and link of an event are functions of its own and the event before, so
    they need no fold; some are tampered with."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ledger_id"),
        F.row_number().over(w).cast("long").alias("sequence"),
        F.col("event_id").cast("string").alias("instant"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_id") % 97 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type")).alias("target"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("state_digest"),
        F.col("event_id"),
    )
    own = F.sha2(F.concat_ws("|", "ledger_id", F.col("sequence").cast("string"), "instant", "action"), 256)
    rows = rows.withColumn("mark", own)
    before = F.lag("mark", 1, ledger.GENESIS).over(Window.partitionBy("ledger_id").orderBy("sequence"))
    return rows.withColumn("previous_hash", F.when(F.col("event_id") % 89 == 5, "broken").otherwise(before)).withColumn("hash", F.sha2(F.concat_ws("|", "ledger_id", F.col("sequence").cast("string"), "instant", "target"), 256)).drop("event_id")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on documents from labels: withdraw if toxic, else admit or reject by quality."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    rows = l.join(d.select("doc_id", "text"), "doc_id", "left")
    decision = F.when(F.col("toxic") == 1, "withdraw").when(F.col("quality") == 1, "admit").otherwise("reject")
    return rows.select(F.sha2(F.concat(F.lit("d"), F.col("doc_id").cast("string")), 256).alias("record_sha"), F.when(F.col("doc_id") % 10 == 0, "archive").otherwise("catalog").alias("source_kind"), F.sha2("text", 256).alias("source_sha"), F.array(F.col("doc_id").cast("string")).alias("entity_ids"), decision.alias("decision"), F.col("doc_id").alias("k"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir).where("k % 7 <> 3")
    outcome = F.when((F.col("decision") == "admit") & (F.col("k") % 11 != 0), "applied").otherwise("not-applied")
    reason = F.when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "withdraw", "withdrawn").when(F.col("k") % 11 == 0, "conflict").otherwise("accepted")
    return d.select(F.col("record_sha").alias("decision_sha"), outcome.alias("outcome"), F.when(F.col("k") % 41 == 0, "unknown").otherwise(reason).alias("reason"), F.concat(F.lit("rev-"), (F.col("k") % 5).cast("string")).alias("revision_id"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 10 == 0, "archive").when(F.col("doc_id") % 23 == 0, "fixture").otherwise("catalog")
    return d.select(F.col("doc_id").cast("string").alias("entity_id"), kind.alias("source_kind"), F.sha2(F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("source_sha"))


def snapshot(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Orders as snapshot a; b lacks some, has others shifted in, and has changed totals."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    if which == "a":
        return o
    kept = o.where("id % 13 <> 0").withColumn("cents", F.when(F.col("id") % 17 == 0, F.col("cents") + 1).otherwise(F.col("cents"))).withColumn("status", F.when(F.col("id") % 19 == 0, "R").otherwise(F.col("status")))
    new = o.where("id % 23 = 0").withColumn("id", -1 - F.col("id"))
    return kept.unionByName(new)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident events from conversations: a turn is an event, the last of each conversation may resolve it."""
    c = table(spark, sf_dir, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    state = F.when((F.col("turn") == last) & (F.col("conv_id") % 3 != 0), "resolved").when(F.col("turn") % 2 == 0, "open").otherwise("investigating")
    return c.select(F.col("conv_id").alias("incident_id"), F.col("turn").alias("instant"), state.alias("state"), F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.substring("text", 1, 40)).alias("note"), F.when(F.col("conv_id") % 5 == 0, "Unassigned").otherwise(F.col("role")).alias("owner_role"))


ORACLE_VIEWS = {
    "catalog": """
SELECT k, id, title, creator, format, isbn, doi, carrier, isbn2, link, availability, location, suppressed, public_visible, requestable, b336, b338, file FROM (
  SELECT k,
    CASE WHEN k % 101 = 0 AND k > 0 THEN 'P-' || (k - 1) WHEN k % 127 = 0 THEN 'bad id ' || k ELSE 'P-' || k END AS id,
    CASE WHEN k % 53 = 0 THEN '' ELSE p_name || ' ' || p_brand || ' ' || p_size END AS title,
    p_brand AS creator, CASE p_type WHEN 'ECONOMY' THEN 'Book' WHEN 'STANDARD' THEN 'Article' WHEN 'SMALL' THEN 'Video' WHEN 'MEDIUM' THEN 'Map' WHEN 'LARGE' THEN 'Online book' ELSE 'Other' END AS format,
    digits || CASE WHEN k % 7 = 0 THEN (ck + 1) % 10 ELSE ck END AS isbn,
    CASE WHEN k % 15 = 0 THEN '10.12/x y' WHEN k % 5 = 0 THEN '10.1234/part.' || k END AS doi,
    CASE WHEN k % 20 = 0 THEN '10.1234/part.' || (k + 5) END AS carrier,
    CASE WHEN k % 33 = 0 THEN digits || CASE WHEN k % 7 = 0 THEN (ck + 1) % 10 ELSE ck END END AS isbn2,
    CASE k % 37 WHEN 0 THEN 'http://example.org/' WHEN 1 THEN 'https://user:pw@example.org/' WHEN 2 THEN 'https://10.0.0.1/' WHEN 3 THEN 'https://example.org/?api_key=' WHEN 4 THEN 'https://localhost/' WHEN 5 THEN 'https://example.org./' WHEN 6 THEN 'https://[2001:db8::1]/' WHEN 7 THEN 'https://intranet/' ELSE 'https://example.org/item/' END || k AS link,
    CASE k % 4 WHEN 0 THEN 'Available' WHEN 1 THEN 'Online' WHEN 2 THEN 'Unavailable' ELSE 'Check availability' END AS availability,
    CASE WHEN k % 8 = 1 THEN 'Online' ELSE 'Stacks' END AS location,
    p_size % 2 = 0 AND k % 13 = 0 AS suppressed, k % 3 <> 1 AS public_visible, k % 6 <> 0 AS requestable,
    CASE WHEN k % 2 = 0 THEN 'txt' ELSE 'tdi' END AS b336, CASE WHEN k % 3 = 0 THEN 'cr' ELSE 'nc' END AS b338, 'file-' || (k % 17) AS file
  FROM (SELECT *, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(digits, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10)::INT % 10 AS ck
        FROM (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, '978' || lpad(CAST(CASE WHEN p_partkey % 11 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR), 9, '0') AS digits FROM part)))
""",
    "claim": """
SELECT DISTINCT k, id, claim FROM (
  SELECT k, id, 'isbn:' || isbn AS claim FROM catalog
  UNION ALL SELECT k, id, 'doi:' || doi FROM catalog WHERE doi IS NOT NULL
  UNION ALL SELECT k, id, 'local:https://doi.org/10.1234/PART.' || (k + 5) FROM catalog WHERE carrier IS NOT NULL
  UNION ALL SELECT k, id, 'doi:' || carrier FROM catalog WHERE carrier IS NOT NULL)
""",
    "isbn_ok": """
SELECT k, list_sum(list_transform(range(1, 14), lambda i: CAST(substr(isbn, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS ok FROM catalog
""",
    "problem": """
SELECT k, id, link, CASE
  WHEN NOT starts_with(link, 'https://') THEN 'scheme' WHEN regexp_matches(link, '^https://[^/?#]*@') THEN 'credentials'
  WHEN regexp_extract(link, '^https://([^/?#]*)', 1) LIKE '%.' THEN 'trailing-dot'
  WHEN regexp_extract(link, '^https://([^/?#]*)', 1) = 'localhost' THEN 'private-host'
  WHEN regexp_matches(link, '^https://10[.]') THEN 'private-ipv4' WHEN regexp_matches(link, '^https://\\[2001:db8:') THEN 'private-ipv6'
  WHEN NOT contains(regexp_extract(link, '^https://([^/?#]*)', 1), '.') THEN 'single-label'
  WHEN regexp_matches(link, '[?&][^=&]*api_key') THEN 'secret' END AS problem FROM catalog
""",
    "finding": """
SELECT 'error' AS severity, 'TITLE_MISSING' AS code, id AS record_id, '' AS detail FROM catalog WHERE trim(title) = ''
UNION ALL SELECT 'error', 'ID_INVALID', id, '' FROM catalog WHERE NOT regexp_full_match(id, '[A-Za-z0-9._:-]{1,128}')
UNION ALL SELECT 'error', 'SUPPRESSION_LEAK', id, '' FROM catalog WHERE suppressed AND public_visible
UNION ALL SELECT 'warning', 'REQUEST_MISMATCH', id, '' FROM catalog WHERE availability = 'Available' AND NOT requestable AND location <> 'Online'
UNION ALL SELECT 'warning', 'FORMAT_CONFLICT', id, '' FROM catalog WHERE format = 'Video' AND b336 = 'txt' AND b338 = 'cr'
UNION ALL SELECT 'error', 'IDENTIFIER_DUPLICATE', id, 'isbn:' || isbn FROM catalog WHERE isbn2 IS NOT NULL
UNION ALL SELECT 'warning', 'ISBN_INVALID', c.id, c.isbn FROM catalog c JOIN isbn_ok o USING (k) CROSS JOIN range(CASE WHEN c.isbn2 IS NULL THEN 1 ELSE 2 END) WHERE NOT o.ok
UNION ALL SELECT 'warning', 'DOI_INVALID', id, doi FROM catalog WHERE doi = '10.12/x y'
UNION ALL SELECT 'warning', 'IDENTITY_CARRIER_CONFLICT', id, string_agg(claim, ', ' ORDER BY claim) FROM claim WHERE starts_with(claim, 'doi:') GROUP BY k, id HAVING count(*) > 1
UNION ALL SELECT 'error', 'URL_UNSAFE', id, problem FROM problem WHERE problem IS NOT NULL
UNION ALL SELECT 'error', 'IDENTIFIER_DUPLICATE', min(id), claim || ' x ' || count(*) FROM claim GROUP BY claim HAVING count(*) > 1
UNION ALL SELECT 'notice', 'TITLE_DUPLICATE', min(id), key || ' x ' || count(*) FROM (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM catalog) WHERE key <> '' GROUP BY key HAVING count(*) > 1
UNION ALL SELECT 'error', 'RECORD_ID_DUPLICATE', min(id), id || ' x ' || count(*) FROM catalog GROUP BY id HAVING count(*) > 1
""",
    "rowfinding": """
SELECT k, 'error' AS severity FROM catalog WHERE trim(title) = '' UNION ALL SELECT k, 'error' FROM catalog WHERE NOT regexp_full_match(id, '[A-Za-z0-9._:-]{1,128}')
UNION ALL SELECT k, 'error' FROM catalog WHERE suppressed AND public_visible UNION ALL SELECT k, 'warning' FROM catalog WHERE availability = 'Available' AND NOT requestable AND location <> 'Online'
UNION ALL SELECT k, 'warning' FROM catalog WHERE format = 'Video' AND b336 = 'txt' AND b338 = 'cr' UNION ALL SELECT k, 'error' FROM catalog WHERE isbn2 IS NOT NULL
UNION ALL SELECT k, 'warning' FROM catalog JOIN isbn_ok USING (k) CROSS JOIN range(CASE WHEN isbn2 IS NULL THEN 1 ELSE 2 END) WHERE NOT ok UNION ALL SELECT k, 'warning' FROM catalog WHERE doi = '10.12/x y'
UNION ALL SELECT k, 'warning' FROM catalog WHERE carrier IS NOT NULL UNION ALL SELECT k, 'error' FROM catalog WHERE k % 37 < 8
""",
    "clean": """
SELECT * FROM catalog WHERE id NOT IN (SELECT record_id FROM finding WHERE severity = 'error' OR code = 'RECORD_ID_DUPLICATE') AND k % 101 NOT IN (0, 100)
""",
    "unit": """
SELECT 'R' || r_regionkey AS id, NULL AS parent_id, 'fonds' AS level FROM region
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'series' FROM nation
UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'file' FROM customer
UNION ALL SELECT 'O' || o_orderkey, CASE WHEN o_orderkey % 499 = 0 THEN 'X' ELSE 'C' END || o_custkey, 'item' FROM orders
UNION ALL SELECT * FROM (VALUES ('Z1', 'Z2', 'other'), ('Z2', 'Z3', 'other'), ('Z3', 'Z1', 'other'), ('Z4', 'Z1', 'other')) z(id, parent_id, level)
""",
    "ledger": """
SELECT ledger_id, sequence, instant, action, target, state_digest, hash, CASE WHEN event_id % 89 = 5 THEN 'broken' ELSE coalesce(lag(mark) OVER (PARTITION BY ledger_id ORDER BY sequence), 'GENESIS') END AS previous_hash FROM (
  SELECT *, sha256(ledger_id || '|' || sequence || '|' || instant || '|' || action) AS mark, sha256(ledger_id || '|' || sequence || '|' || instant || '|' || target) AS hash FROM (
    SELECT event_id, user_id::VARCHAR AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id::VARCHAR AS instant, event_type AS action,
      CASE WHEN event_id % 97 = 0 THEN event_type || '!' ELSE event_type END AS target, sha256(event_id::VARCHAR) AS state_digest FROM events))
""",
    "decision": """
SELECT sha256('d' || l.doc_id) AS record_sha, CASE WHEN l.doc_id % 10 = 0 THEN 'archive' ELSE 'catalog' END AS source_kind, sha256(d.text) AS source_sha, l.doc_id::VARCHAR AS entity_id,
  CASE WHEN toxic = 1 THEN 'withdraw' WHEN quality = 1 THEN 'admit' ELSE 'reject' END AS decision, l.doc_id AS k FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id
""",
    "application": """
SELECT record_sha AS decision_sha, CASE WHEN decision = 'admit' AND k % 11 <> 0 THEN 'applied' ELSE 'not-applied' END AS outcome,
  CASE WHEN k % 41 = 0 THEN 'unknown' WHEN decision = 'reject' THEN 'rejected' WHEN decision = 'withdraw' THEN 'withdrawn' WHEN k % 11 = 0 THEN 'conflict' ELSE 'accepted' END AS reason, 'rev-' || (k % 5) AS revision_id FROM decision WHERE k % 7 <> 3
""",
    "entity": """
SELECT doc_id::VARCHAR AS entity_id, CASE WHEN doc_id % 10 = 0 THEN 'archive' WHEN doc_id % 23 = 0 THEN 'fixture' ELSE 'catalog' END AS source_kind,
  sha256(CASE WHEN doc_id % 29 = 0 THEN text || '!' ELSE text END) AS source_sha FROM documents
""",
    "active": """
SELECT d.* FROM decision d JOIN application a ON d.record_sha = a.decision_sha WHERE d.decision = 'admit' AND a.outcome = 'applied'
  AND EXISTS (SELECT 1 FROM entity e WHERE e.entity_id = d.entity_id AND (d.source_kind = 'archive' OR e.source_sha = d.source_sha))
""",
    "uncovered": """
SELECT e.* FROM entity e WHERE e.source_kind <> 'fixture' AND NOT EXISTS (SELECT 1 FROM active a WHERE a.entity_id = e.entity_id AND a.source_sha = e.source_sha)
""",
    "snap_a": "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders",
    "snap_b": """
SELECT id, CASE WHEN id % 19 = 0 THEN 'R' ELSE status END AS status, priority, CASE WHEN id % 17 = 0 THEN cents + 1 ELSE cents END AS cents FROM snap_a WHERE id % 13 <> 0
UNION ALL SELECT -1 - id, status, priority, cents FROM snap_a WHERE id % 23 = 0
""",
    "incident": """
SELECT conv_id AS incident_id, turn AS instant, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 3 <> 0 THEN 'resolved' WHEN turn % 2 = 0 THEN 'open' ELSE 'investigating' END AS state,
  CASE WHEN conv_id % 4 = 0 THEN '' ELSE substr(text, 1, 40) END AS note, CASE WHEN conv_id % 5 = 0 THEN 'Unassigned' ELSE role END AS owner_role FROM conversations
""",
    "value": """
SELECT 'S' || s_suppkey AS unit_id, 'sup' AS schema_id, 'title' AS field_id, CASE WHEN s_suppkey % 10 = 3 THEN ' ' ELSE '' END || s_name AS s, NULL::DOUBLE AS n, NULL::BOOLEAN AS b FROM supplier
UNION ALL SELECT 'S' || s_suppkey, 'sup', 'balance', NULL, s_acctbal, NULL FROM supplier
UNION ALL SELECT 'S' || s_suppkey, 'sup', 'active', NULL, NULL, s_acctbal > 0 FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT 'C' || c_custkey, 'cus', 'title', c_name, NULL, NULL FROM customer WHERE c_custkey % 9 <> 0
UNION ALL SELECT 'C' || c_custkey, 'cus', 'segment', c_mktsegment, NULL, NULL FROM customer
UNION ALL SELECT 'C' || c_custkey, 'cus', 'since', '2024-' || lpad((c_custkey % 14)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 31 + 1)::VARCHAR, 2, '0'), NULL, NULL FROM customer
UNION ALL SELECT 'C' || c_custkey, 'cus', 'count', NULL, c_acctbal, NULL FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'C' || c_custkey, 'cus', 'checksum', 'md5:' || CASE WHEN c_custkey % 6 = 0 THEN md5(c_name) ELSE '00' END, NULL, NULL FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'C' || c_custkey, 'cus', 'mystery', 'x', NULL, NULL FROM customer WHERE c_custkey % 50 = 7
""",
}


def oracle(sql: str, *views: str) -> str:
    """A query with the views it needs, in order, as common table expressions."""
    return "WITH " + ", ".join(f"{v} AS ({ORACLE_VIEWS[v].strip()})" for v in views) + " " + sql.strip() if views else sql.strip()
