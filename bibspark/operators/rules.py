"""The data-quality rule engine: rules become one array of findings per row, then one row per finding.

Row and array rules run map-side in one pass. Group rules aggregate counts and the smallest id per key (never lists of
members), so a key shared by very many records stays cheap. User rules are Rule objects like those built in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions import formats, identity, text

FINDING = "severity string, code string, record_id string, detail string"
NONE = "array<string>"


@dataclass(frozen=True)
class Rule:
    """details: an array<string> column, one finding for each member."""

    code: str
    severity: str
    details: Column


def once(test: Column, detail: Column | str = "") -> Column:
    """Details of a rule that holds at most once per row. A null test does not hold."""
    value = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(test, F.array(F.coalesce(value, F.lit("")))).otherwise(F.array().cast(NONE))


def each(values: Column, test, detail=lambda x: x) -> Column:
    """Details of a rule on the members of an array."""
    return F.transform(F.filter(F.coalesce(values, F.array()), lambda x: F.coalesce(test(x), F.lit(False))), detail)


def row_findings(rows: DataFrame, record_id: Column, rules: list[Rule]) -> DataFrame:
    def found(r: Rule) -> Column:
        return F.transform(F.coalesce(r.details, F.array().cast(NONE)), lambda d: F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), d.alias("detail")))

    parts = [found(r) for r in rules]
    return rows.select(record_id.alias("record_id"), F.explode(F.concat(*parts)).alias("f")).select("f.severity", "f.code", "record_id", "f.detail")


def catalog_rules() -> list[Rule]:
    """Row rules on catalog records (columns of the view catalog; claims: identity.identity_claims)."""
    c = F.col
    keys = F.transform(c("identifiers"), lambda i: F.concat_ws(":", i["scheme"], identity.identifier_key(i["scheme"], i["value"])))
    trace = lambda k: F.try_element_at(c("trace"), F.lit(k))
    of = lambda scheme: F.filter(c("identifiers"), lambda i: i["scheme"] == scheme)
    key = lambda i: identity.identifier_key(i["scheme"], i["value"])
    dois = identity.doi_claims(c("claims"))
    problems = F.transform(c("links"), lambda u: identity.url_problem(u))
    return [
        Rule("TITLE_MISSING", "error", once(text.trim_white(F.coalesce(c("title"), F.lit(""))) == "")),
        Rule("ID_INVALID", "error", once(~text.is_safe_id(c("id")))),
        Rule("SUPPRESSION_LEAK", "error", once(c("suppressed") & c("public_visible"))),
        Rule("REQUEST_MISMATCH", "warning", once((c("availability") == "Available") & ~c("requestable") & (c("location") != "Online"))),
        Rule("FORMAT_CONFLICT", "warning", once((c("format") == "Video") & (trace("336$b") == "txt") & (trace("338$b") == "cr"))),
        Rule("IDENTIFIER_DUPLICATE", "error", F.transform(F.filter(F.transform(keys, lambda x, i: F.struct(x.alias("x"), F.exists(F.slice(keys, 1, i), lambda y: y == x).alias("again"))), lambda z: z["again"]), lambda z: z["x"])),
        Rule("ISBN_INVALID", "warning", each(of("isbn"), lambda i: ~identity.is_isbn(key(i)), lambda i: i["value"])),
        Rule("DOI_INVALID", "warning", each(of("doi"), lambda i: ~identity.is_doi(key(i)), lambda i: i["value"])),
        Rule("IDENTITY_CARRIER_CONFLICT", "warning", once(F.size(dois) > 1, F.array_join(dois, ", "))),
        Rule("URL_UNSAFE", "error", F.array_compact(problems)),
    ]


def duplicates(rows: DataFrame, key: str, record_id: str, severity: str, code: str) -> DataFrame:
    """One finding per key that more than one row has, at the smallest record id. Null and empty keys do not count."""
    groups = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count("*").alias("n"), F.min(record_id).alias("first"))
    detail = F.concat(F.col(key).cast("string"), F.lit(" x "), F.col("n").cast("string"))
    return groups.where("n > 1").select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("first").alias("record_id"), detail.alias("detail"))


def duplicate_members(rows: DataFrame, key: str, record_id: str, keep: int = 20) -> DataFrame:
    """(key, n, members): the rows of each repeated key, and its `keep` smallest record ids as a sorted array."""
    order = Window.partitionBy(key).orderBy(record_id)
    known = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    sizes = known.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    first = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    return sizes.join(first.groupBy(key).agg(F.array_sort(F.collect_list(record_id)).alias("members")), key)


def duplicate_rows(rows: DataFrame, key: str, record_id: str) -> DataFrame:
    """(key, n, record_id): every row of each repeated key, without arrays or windows; Spark splits hot keys of the join."""
    known = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(key, record_id)
    sizes = known.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return known.join(sizes, key).select(key, "n", record_id)


def catalog_findings(catalog: DataFrame, extra: list[Rule] = ()) -> DataFrame:
    """All findings of a set of catalog records, row rules and group rules, and any rules of the user.

    The keys of all group rules are exploded once and counted in one aggregation."""
    rows = catalog.withColumns({"claims": identity.identity_claims(F.col("identifiers"), F.col("links")), "title_key": text.title_key(F.col("title"), unicode=False)})
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    keys = F.concat(F.transform("claims", lambda x: key("IDENTIFIER_DUPLICATE", x)), F.array(key("TITLE_DUPLICATE", F.col("title_key")), key("RECORD_ID_DUPLICATE", F.col("id"))))
    groups = rows.select("id", F.explode(keys).alias("k")).where("k.key <> ''").groupBy("k.kind", "k.key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    found = groups.select(F.when(F.col("kind") == "TITLE_DUPLICATE", "notice").otherwise("error").alias("severity"), F.col("kind").alias("code"), F.col("first").alias("record_id"), F.concat_ws(" x ", "key", F.col("n").cast("string")).alias("detail"))
    return row_findings(rows, F.col("id"), [*catalog_rules(), *extra]).unionByName(found)


def with_finding_ids(findings: DataFrame) -> DataFrame:
    """Adds occurrence (of equal findings) and finding_id = code:record:hash of detail:occurrence."""
    order = Window.partitionBy("code", "record_id", "detail").orderBy("severity")
    rows = findings.withColumn("occurrence", F.row_number().over(order))
    return rows.withColumn("finding_id", F.concat_ws(":", "code", F.coalesce("record_id", F.lit("workspace")), F.substring(F.sha2("detail", 256), 1, 8), F.col("occurrence").cast("string")))


def by_code(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.count("*").alias("findings"), F.count_distinct("record_id").alias("records"))


def review_outcome(records: DataFrame, findings: DataFrame, file: str = "file") -> DataFrame:
    """(file, records, errors, warnings, blocked): blocked without records or with any error finding.

    findings has the file of its record."""
    n = records.groupBy(file).agg(F.count("*").alias("records"))
    f = findings.groupBy(file).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return n.join(f, file, "full").select(file, zero("records"), zero("errors"), zero("warnings"), ((zero("records") == 0) | (zero("errors") > 0)).alias("blocked"))


def over_capacity(findings: DataFrame, group: str, most: int) -> DataFrame:
    """Groups with more findings than a threshold."""
    return findings.groupBy(group).agg(F.count("*").alias("findings")).where(F.col("findings") > most)


# --- contracts: column, pattern or length or set of values, as a table -------------------------------------------


@dataclass(frozen=True)
class Contract:
    """What a column must be: required, a pattern, a largest length (or array size), a set of values."""

    column: str
    required: bool = False
    pattern: str | None = None
    most: int | None = None
    values: tuple[str, ...] = ()


def contract_rules(contracts: list[Contract], severity: str = "error", code: str = "SHAPE_INVALID", arrays: set[str] = frozenset()) -> list[Rule]:
    """Rules of a record contract; the detail is column:kind."""
    out = []
    for c in contracts:
        v = F.col(c.column)
        size = F.size(v) if c.column in arrays else F.length(v)
        if c.required:
            out.append(Rule(code, severity, once(v.isNull() | (size == 0), f"{c.column}:required")))
        if c.pattern:
            out.append(Rule(code, severity, once(~v.rlike(c.pattern), f"{c.column}:pattern")))
        if c.most is not None:
            out.append(Rule(code, severity, once(size > c.most, f"{c.column}:length")))
        if c.values:
            out.append(Rule(code, severity, once(~v.isin(*c.values), f"{c.column}:value")))
    return out


#: Stored catalog records. The largest lengths and numbers of members.
CATALOG_CONTRACT = [
    Contract("id", True, "^[A-Za-z0-9._:-]{1,128}$"),
    Contract("title", False, None, 1000),
    Contract("format", True, None, None, formats.RECORD_FORMATS),
    Contract("availability", True, None, None, formats.AVAILABILITY),
    Contract("creators", False, None, 50),
    Contract("links", False, None, 20),
]

DIGEST = "^[0-9a-f]{64}$"
SAFE = "^[A-Za-z0-9._:-]{1,128}$"

#: Sealed records (decision, outcome, checkpoint, observation): required keys, digests, ids and enumerations.
RECORD_CONTRACTS = {
    "decision": [Contract("record_sha", True, DIGEST), Contract("source_sha", True, DIGEST), Contract("decision", True, None, None, ("admit", "reject", "withdraw"))],
    "application": [Contract("decision_sha", True, DIGEST), Contract("outcome", True, None, None, ("applied", "not-applied")), Contract("revision_id", False, SAFE)],
    "checkpoint": [Contract("lineage_id", True, SAFE), Contract("digest", True, DIGEST)],
    "observation": [Contract("case_id", True, SAFE), Contract("transformation", True, None, None, ("unchanged", "normalized", "loss", "hazard"))],
}


def config_rules() -> list[Rule]:
    """Rules of a configuration row (resolver_base, proxy_prefix, member_code)."""
    c = F.col
    return [
        Rule("RESOLVER_UNSAFE", "error", once((c("resolver_base") != "") & identity.url_problem(c("resolver_base"), template=True).isNotNull())),
        Rule("PROXY_UNSAFE", "error", once((c("proxy_prefix") != "") & identity.url_problem(c("proxy_prefix"), template=True).isNotNull())),
        Rule("MEMBER_CODE_INVALID", "error", once((c("member_code") != "") & ~c("member_code").rlike("^[A-Za-z0-9_-]{2,32}$"))),
    ]


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that are not allowed, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast(NONE)), F.array(*map(F.lit, allowed))))
