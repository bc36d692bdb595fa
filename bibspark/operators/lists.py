"""Search, paging, gates, incidents and roll-ups over catalog and register tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions import formats
from bibspark.operators.tables import stage


def search(catalog: DataFrame, query: str, fmt: str | None = None) -> DataFrame:
    """Records of a format whose id, title, creators or identifier values hold the query in any case."""
    hay = F.lower(F.concat_ws(" ", "id", "title", F.array_join("creators", " "), F.array_join(F.transform("identifiers", lambda i: i["value"]), " ")))
    rows = catalog.where(F.col("format") == fmt) if fmt else catalog
    return rows.where(hay.contains(query.lower()))


def register(records: DataFrame, area: str | None = None) -> DataFrame:
    """Service records of one area, or of all."""
    return records.where(F.col("area") == area) if area else records


def findings_of(findings: DataFrame, record_id: str | None = None, blocking: str | None = None, most: int | None = None) -> DataFrame:
    """Findings of one record; blocking ones (import: errors; export: errors and warnings); the first `most` by severity."""
    rows = findings.where(F.col("record_id") == record_id) if record_id is not None else findings
    if blocking:
        rows = rows.where(F.col("severity").isin(*{"import": ("error",), "export": ("error", "warning")}[blocking]))
    return rows.orderBy(formats.severity_rank(F.col("severity")), "code", "record_id", "detail").limit(most) if most is not None else rows


def with_origin(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings with the synthetic flag of their record (false where it has none)."""
    flags = records.groupBy(F.col("id").alias("record_id")).agg(F.bool_or("synthetic").alias("synthetic"))
    return findings.join(flags, "record_id", "left").withColumn("synthetic", F.coalesce("synthetic", F.lit(False)))


def contaminated(records: DataFrame) -> DataFrame:
    """One row (records, synthetic, contaminated): whether synthetic records stand among others."""
    return records.agg(F.count("*").alias("records"), F.count_if("synthetic").alias("synthetic")).withColumn("contaminated", (F.col("synthetic") > 0) & (F.col("synthetic") < F.col("records")))


FRONT = 10_000  # a page that ends here or before is taken from each partition's first rows


def page(rows: DataFrame, order: list[str], number: int, size: int = 100) -> DataFrame:
    """The rows of a page (0 first; clamped to the last) by a total order, with page, pages, total, start and end.

    Of a page that ends within the first FRONT rows, each partition's first so many rows are merged. Beyond, rows are
    dealt by ranges of the order and written once with their range; a row's rank is the number of rows of smaller ranges
    plus its place in its own range, and only ranges that the page touches are ranked."""
    if size < 1:
        raise ValueError("a page has at least one row")
    if (max(int(number), 0) + 1) * size <= FRONT:
        total = rows.count()
        pages = max(1, -(-total // size))
        at = min(max(int(number), 0), pages - 1)
        start, end = (at * size + 1 if total else 0), min(total, (at + 1) * size)
        info = {"page": at, "pages": pages, "total": total, "start": start, "end": end}
        first = rows.orderBy(*order).limit(max(end, 1))  # FRONT rows at most
        ranked = first.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
        return ranked.where(F.col("position").between(start, end)).withColumns({k: F.lit(v).cast("long") for k, v in info.items()})
    dealt = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    total = sum(n for _, n in sizes)
    pages = max(1, -(-total // size))
    at = min(max(int(number), 0), pages - 1)
    start, end = (at * size + 1 if total else 0), min(total, (at + 1) * size)
    before, touched = 0, []
    for part, n in sizes:
        if before < end and before + n >= start:
            touched.append((part, before))
        before += n
    known = F.lit(None).cast("long")
    for part, n in touched:
        known = F.when(F.col("part") == part, F.lit(n).cast("long")).otherwise(known)
    own = dealt.where(F.col("part").isin(*[p for p, _ in touched])) if touched else dealt.where("false")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    info = {"page": at, "pages": pages, "total": total, "start": start, "end": end}
    ranked = own.withColumn("position", place + known).drop("part")
    return ranked.where(F.col("position").between(start, end)).withColumns({k: F.lit(v).cast("long") for k, v in info.items()})


def page_containing(rows: DataFrame, order: list[str], test: Column, size: int = 100) -> DataFrame:
    """One row (page): that of the first row, by the order, for which test holds; 0 if there is none."""
    first = rows.where(test).orderBy(*order).limit(1).select(F.struct(*order).alias("first"))
    before = rows.withColumn("k", F.lit(1)).join(first.withColumn("k", F.lit(1)), "k").where(F.struct(*order) < F.col("first"))
    return before.agg(F.floor(F.count("*") / size).cast("long").alias("page"))


def candidates_for_parent(units: DataFrame, own_id: str, query: str, selected: str | None, most: int = 100) -> DataFrame:
    """The first `most` units that hold the query, never the unit itself, always the selected one."""
    found = units.where((F.col("id") != own_id) & F.lower("id").contains(query.lower())).orderBy("id").limit(most)
    return found.unionByName(units.where(F.col("id") == selected)).distinct() if selected else found


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where("state <> 'resolved'")


def unsupported_closures(incidents: DataFrame) -> DataFrame:
    """Resolved incidents without a note, an owner or a criterion."""
    no_note = F.forall(F.coalesce("notes", F.array().cast("array<string>")), lambda x: F.trim(x) == "")
    return incidents.where((F.col("state") == "resolved") & (no_note | (F.coalesce("owner_role", F.lit("Unassigned")) == "Unassigned") | (F.trim(F.coalesce("criterion", F.lit(""))) == "")))


def incident_violations(events: DataFrame) -> DataFrame:
    """Incident events (incident_id, instant, state, note, owner_role) that break the life cycle: closure without a note or
    an owner, or an edit of a resolved incident without a note."""
    before = F.lag("state").over(Window.partitionBy("incident_id").orderBy("instant"))
    bare = F.trim(F.coalesce("note", F.lit(""))) == ""
    rows = events.withColumn("before", before)
    problem = F.when((F.col("state") == "resolved") & bare, "closure-note").when((F.col("state") == "resolved") & (F.col("owner_role") == "Unassigned"), "closure-owner").when((F.col("before") == "resolved") & bare, "edit-note")
    return rows.select("incident_id", "instant", problem.alias("problem")).where("problem is not null")


def incidents_from_findings(findings: DataFrame, open_now: DataFrame) -> DataFrame:
    """New incidents for findings that no open incident of the record names yet."""
    known = open_now.select("record_id", F.explode("evidence").alias("code")).distinct()
    new = findings.join(known, ["record_id", "code"], "left_anti").dropDuplicates(["record_id", "code"])
    severity = formats.lookup(F.col("severity"), {"error": "high", "warning": "medium", "notice": "low"})
    return new.select("record_id", "code", severity.alias("severity"), formats.service_of_finding(F.col("code")).alias("service"), formats.action_of_finding(F.col("code")).alias("next_action"), F.lit("open").alias("state"))


def export_gate(flags: DataFrame, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(keep, reason) of rows (synthetic, blocked_evidence, errors, warnings, ledger_valid): the first that blocks, or open."""
    return flags.select(*keep, F.when(F.col("synthetic"), "synthetic").when(F.col("blocked_evidence"), "evidence").when(F.col("errors") + F.col("warnings") > 0, "findings").when(~F.col("ledger_valid"), "ledger").otherwise("open").alias("reason"))


def counts_zero_filled(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, rows) for every given value, 0 where there is none."""
    all_values = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    n = rows.groupBy(key).agg(F.count("*").alias("rows"))
    return all_values.join(n, key, "left").select(key, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def overall_state(findings: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: action-required (errors or unsupported closures), review-required (warnings or open incidents), none."""
    f = findings.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("e"), F.coalesce(F.bool_or(F.col("severity") == "warning"), F.lit(False)).alias("w")).withColumn("k", F.lit(1))
    i = incidents.agg(F.count_if(F.col("state") != "resolved").alias("o")).withColumn("k", F.lit(1))
    return f.join(i, "k").select(F.when(F.col("e"), "action-required").when(F.col("w") | (F.col("o") > 0), "review-required").otherwise("none").alias("state"))


#: States of an incident.
STATES = ("open", "investigating", "monitoring", "resolved")
FOLDED = "incident_id string, instant long, refused string, state string, owner_role string, next_action string, notes long"


def incident_states(events: DataFrame) -> DataFrame:
    """(incident_id, instant, refused, state, owner_role, next_action, notes) after each event of an incident's life.

    events: patches (incident_id string, instant long, state, owner_role, next_action, note), null members do not change;
    an incident begins open, unassigned, without action or notes. refused is the first rule that an event breaks, and a
    refused event changes nothing: state-invalid; closure-note (resolving without a note); edit-note (another owner or
    action of a resolved incident without one); owner, action and evidence (what a resolved incident has to have).
    Each state depends on the one before, so an incident's events are streamed in order (ties by their contents) with one
    state in memory; incidents go in parallel."""
    import pyarrow as pa

    columns = ["state", "owner_role", "next_action", "note"]
    rows = events.select(F.col("incident_id").cast("string"), F.col("instant").cast("long"), *[F.col(c).cast("string") for c in columns])
    rows = rows.repartition("incident_id").sortWithinPartitions("incident_id", "instant", *columns)
    names = ["incident_id", "instant", "refused", "state", "owner_role", "next_action", "notes"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64()]

    def run(batches):
        now, state = object(), None
        for b in batches:
            out = []
            for own, at, *patch in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != now:
                    now, state = own, ("open", "Unassigned", "", 0)
                refused, state = _patched(state, *patch)
                out.append((own, at, refused, *state))
            cells = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, FOLDED)


def _patched(now: tuple, state: str | None, owner: str | None, action: str | None, note: str | None) -> tuple[str | None, tuple]:
    """The rule that a patch of (state, owner, action, notes) breaks, if any, and what is then."""
    note = (note or "").strip()
    if state and state not in STATES:
        return "state-invalid", now
    new = (state or now[0], now[1] if owner is None else owner.strip(), now[2] if action is None else action.strip(), now[3] + bool(note))
    if new[0] == "resolved":
        if now[0] != "resolved" and not note:
            return "closure-note", now
        if now[0] == "resolved" and new[1:3] != now[1:3] and not note:
            return "edit-note", now
        if not new[1] or new[1].lower() == "unassigned":
            return "owner", now
        if not new[2]:
            return "action", now
        if not new[3]:
            return "evidence", now
    return None, new
