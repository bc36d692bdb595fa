"""Contracts of nested records: a description of what a record may hold, compiled to one column expression.

Records are JSON texts. A contract is a tree of the classes below; compiled, it gives every place that breaks it as
(path, rule), one rule a path, the first that holds. Nothing is parsed into fixed columns first, so that wrong kinds,
missing and unknown keys show. The expression runs row by row inside Spark, without Python workers.

Rules: not-json, not-text, not-number, not-whole, not-boolean, not-list, not-object, not-scalar; missing, unknown-key,
forbidden-key; too-long, too-short, too-many, too-few, repeated, value, pattern, range; and names of own tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import dates, identity, text

RESULT = "array<struct<path:string,rule:string>>"
OBJECT, LIST = "map<string,variant>", "array<variant>"


def _at(path: Column, rule: str | Column) -> Column:
    return F.struct(path.alias("path"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))


def _none() -> Column:
    return F.array().cast(RESULT)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: otherwise every mention parses its JSON anew,
    and mentions inside mentions multiply with each level of a contract."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first(path: Column, *rules: tuple[Column, str]) -> Column:
    """The first rule that holds, as a list of at most one."""
    out = None
    for test, rule in rules:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, rule) if out is None else out.when(test, rule)
    return _none() if out is None else _let(out, lambda rule: F.when(rule.isNull(), _none()).otherwise(F.array(_at(path, rule))))


def _key(path: Column, key: Column | str) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, VOID, ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


class Spec:
    def check(self, v: Column, path: Column) -> Column:
        """Violations of a variant that is there."""
        raise NotImplementedError


@dataclass(frozen=True)
class Text(Spec):
    """test: true where a text is right; name: the rule's name."""

    most: int | None = None
    least: int = 0
    values: tuple[str, ...] = ()
    pattern: str | None = None
    test: Callable[[Column], Column] | None = None
    name: str = "form"

    def check(self, v, path):
        def own(s):
            rules = [(_kind(v) != "STRING", "not-text")]
            if self.least > 0:
                rules.append((F.length(s) < self.least, "too-short"))
            if self.most is not None:
                rules.append((F.length(s) > self.most, "too-long"))
            if self.values:
                rules.append((~s.isin(*self.values), "value"))
            if self.pattern:
                rules.append((~s.rlike(self.pattern), "pattern"))
            if self.test:
                rules.append((~self.test(s), self.name))
            return _first(path, *rules)

        return _let(_as(v, "string"), own)


@dataclass(frozen=True)
class Number(Spec):
    low: float | None = None
    high: float | None = None
    whole: bool = True

    def check(self, v, path):
        kind, n = _kind(v), _as(v, "double")
        rules = [(~kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "not-number")]
        if self.whole:
            rules.append((n != F.floor(n), "not-whole"))
        if self.low is not None:
            rules.append((n < self.low, "range"))
        if self.high is not None:
            rules.append((n > self.high, "range"))
        return _first(path, *rules)


@dataclass(frozen=True)
class Flag(Spec):
    def check(self, v, path):
        return _first(path, (_kind(v) != "BOOLEAN", "not-boolean"))


@dataclass(frozen=True)
class Scalar(Spec):
    """A text, number or boolean."""

    def check(self, v, path):
        return _first(path, (_kind(v).isin("ARRAY", "OBJECT", "VOID"), "not-scalar"))


@dataclass(frozen=True)
class Nullable(Spec):
    of: Spec

    def check(self, v, path):
        return F.when(F.is_variant_null(v), _none()).otherwise(self.of.check(v, path))


@dataclass(frozen=True)
class Items(Spec):
    """A list; alone: one value may stand for a list of one."""

    of: Spec
    most: int | None = None
    least: int = 0
    distinct: bool = False
    alone: bool = False

    def check(self, v, path):
        other = self.of.check(v, path) if self.alone else F.array(_at(path, "not-list"))

        def own(items):
            rules = [(F.size(items) < self.least, "too-few")] if self.least > 0 else []
            if self.most is not None:
                rules.append((F.size(items) > self.most, "too-many"))
            if self.distinct:
                texts = F.transform(items, lambda x: x.cast("string"))
                rules.append((F.size(F.array_distinct(texts)) < F.size(items), "repeated"))
            inner = F.flatten(F.transform(items, lambda x, i: self.of.check(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            return F.when(items.isNull(), other).otherwise(F.concat(_first(path, *rules), inner))

        return _let(_as(v, LIST), own)  # null for what is no list


@dataclass(frozen=True)
class Entries(Spec):
    """An object of any keys whose values are alike."""

    of: Spec
    most: int | None = None
    forbidden: tuple[str, ...] = ()

    def check(self, v, path):
        def one(e):
            inner = self.of.check(e["value"], _key(path, e["key"]))
            if not self.forbidden:
                return inner
            return F.when(e["key"].isin(*self.forbidden), F.array(_at(_key(path, e["key"]), "forbidden-key"))).otherwise(inner)

        def own(entries):
            whole = _first(path, (F.size(entries) > self.most, "too-many")) if self.most is not None else _none()
            return F.when(entries.isNull(), F.array(_at(path, "not-object"))).otherwise(F.concat(whole, F.flatten(F.transform(entries, one))))

        return _let(F.map_entries(_as(v, OBJECT)), own)  # null for what is no object


@dataclass(frozen=True)
class Record(Spec):
    """An object of known keys. tests: a rule's name -> true, for the object, where it is right (rules of the whole)."""

    required: dict[str, Spec] = field(default_factory=dict)
    optional: dict[str, Spec] = field(default_factory=dict)
    tests: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def check(self, v, path):
        known = [*self.required, *self.optional]

        def member(k, spec, absent):
            missing = F.array(_at(_key(path, k), "missing")) if absent else _none()
            return _let(get(v, k), lambda own: F.when(own.isNull(), missing).otherwise(spec.check(own, _key(path, k))))

        def of(keys):
            others = F.array_except(keys, F.array(*map(F.lit, known)))
            parts = [F.transform(F.array_sort(others), lambda k: _at(_key(path, k), "unknown-key"))]
            parts += [member(k, spec, absent) for specs, absent in ((self.required, True), (self.optional, False)) for k, spec in specs.items()]
            parts += [_first(path, (~right(v), name)) for name, right in self.tests.items()]
            return F.when(keys.isNull(), F.array(_at(path, "not-object"))).otherwise(F.concat(*parts))

        return _let(F.map_keys(_as(v, OBJECT)), of)  # null for what is no object


def get(v: Column, key: str, kind: str = "variant") -> Column:
    """A member of an object, null where it is absent."""
    return F.try_variant_get(v, f"$['{key}']", kind)


def violations(spec: Spec, json: Column) -> Column:
    """array<struct<path, rule>> of a JSON text; the path of the record itself is empty. Null, and what is no JSON or has
    a key twice, is not-json."""
    return _let(F.try_parse_json(json), lambda v: F.when(v.isNull(), F.array(_at(F.lit(""), "not-json"))).otherwise(spec.check(v, F.lit(""))))


def broken(rows: DataFrame, spec: Spec, json: str, *keep: str) -> DataFrame:
    """(keep, path, rule) for each place of each row's JSON text that breaks the contract."""
    return rows.select(*keep, F.explode(violations(spec, F.col(json))).alias("v")).select(*keep, "v.path", "v.rule")


# --- contracts of stored records -------------------------------------------------------------------------------------

#: Shapes of ids and digests, keys that no record may have.
SAFE_ID = "^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
SHA256 = "^[0-9a-f]{64}$"
FORBIDDEN = ("__proto__", "prototype", "constructor")


def _instant(most: int = 64) -> Text:
    return Text(most, test=dates.is_instant, name="instant")


def _exact(most: int) -> Text:
    """Text that is not empty and already in its canonical form."""
    return Text(most, 1, test=lambda s: text.is_canonical(s, most, True), name="not-canonical")


def _list(most: int, longest: int) -> Items:
    return Items(Text(longest), most)


#: Members of a record's metadata, and their bounds.
METADATA = Record(
    optional={
        "issued": Text(64), "created": Text(64), "modified": Text(64), "publisher": Text(2048), "place": Text(2048), "language": Text(100), "subjects": _list(100, 1024), "genres": _list(100, 1024),
        "abstract": Text(8192), "rights": Text(4096), "license": Text(2048), "series": Text(2048), "containerTitle": Text(2048), "volume": Text(64), "issue": Text(64), "pages": Text(128),
        "extent": Text(512), "audience": Text(512), "coverage": Text(512), "relations": _list(100, 1024), "notes": _list(100, 1024),
    }
)
#: Schemes of identifiers.
IDENTIFIER = Record({"scheme": Text(values=("doi", "isbn", "issn", "oclc", "lccn", "orcid", "ismn", "upc", "uri", "local")), "value": Text(256, test=text.is_identity_text, name="blank")})
#: Source formats, record formats and availabilities; members of stored records, and their bounds.
SOURCES = ("fixture", "marcxml", "dcxml", "modsxml", "in-keeping-json", "laclab-json", "csl-json", "jsonld", "ris", "bibtex", "csv", "tsv", "marc-text")
FORMATS = ("Article", "Book", "Online book", "Book chapter", "Conference paper", "Serial", "Newspaper", "Video", "Audio", "Image", "Map", "Score", "Dataset", "Software", "Website", "Report", "Thesis", "Manuscript", "Archival collection", "Other")
AVAILABILITIES = ("Available", "Online", "Unavailable", "Check availability")
ELEMENT = Record({"code": Text(64), "name": Text(160), "value": Text(8192), "definition": Text(500)})
SOURCE = Record({"format": Text(values=SOURCES), "label": Text(180), "digest": Text(128), "ordinal": Number(1, 1000), "trace": Entries(Text(8192), 64)}, {"elements": Items(ELEMENT, 1024)})
STORED_RECORD = Record(
    {
        "id": Text(128, pattern=SAFE_ID), "title": Text(1024), "creators": _list(50, 512), "year": Text(16), "format": Text(values=FORMATS), "identifiers": Items(IDENTIFIER, 50),
        "links": Items(Text(2048, test=lambda s: identity.url_problem(s).isNull(), name="url"), 20), "availability": Text(values=AVAILABILITIES), "edition": Text(512), "location": Text(512),
        "suppressed": Flag(), "publicVisible": Flag(), "requestable": Flag(), "source": SOURCE,
    },
    {"contributors": _list(50, 512), "metadata": METADATA},
)
#: Members of stored archive schemas and units, and of service records.
FIELD = Record({"id": Text(128), "label": Text(120), "definition": Text(500), "kind": Text(32), "required": Flag(), "repeatable": Flag(), "vocabulary": _list(250, 256), "mappings": Record({}, {k: Text(256) for k in ("ead", "archivesSpace", "atom", "ric")})})
STORED_SCHEMA = Record({"id": Text(128), "name": Text(120), "description": Text(1000), "profile": Text(32), "version": Number(), "fields": Items(FIELD, 128), "createdAt": _instant(), "updatedAt": _instant()}, {"recordType": Text(32)})
STORED_UNIT = Record(
    {"id": Text(128), "schemaId": Text(128), "schemaVersion": Number(), "parentId": Nullable(Text(128)), "level": Text(32), "values": Entries(Items(Scalar(), 250, alone=True), 128, FORBIDDEN), "createdAt": _instant(), "updatedAt": _instant()},
    {"published": Flag(), "language": Text(64)},
)
STORED_SERVICE = Record(
    {"id": Text(128), "kind": Text(80), "area": Text(80), "title": Text(500), "state": Text(32), "ownerRole": Text(160), "system": Text(256), "sensitivity": Text(32), "values": Entries(Items(Scalar(), 100, alone=True), 64, FORBIDDEN), "createdAt": _instant(), "updatedAt": _instant()}
)
#: Members of sealed decisions.
DESCRIPTOR = Record(
    {
        "source": Record({"kind": Text(values=("catalog-import", "archive-import", "workspace-backup", "workspace-history", "other")), "filename": _exact(180), "format": _exact(80), "bytes": Number(1, 32 << 20), "sha256": Text(pattern=SHA256)}),
        "review": Record({"structuralStatus": Text(values=("passed",)), "canonicalPayloadSha256": Text(pattern=SHA256), "parserProfile": _exact(160)}),
        "scope": Record({"kind": Text(values=("catalog-records", "archive-records", "service-records", "workspace", "other")), "entityIds": Items(_exact(256), 5000, 1, True)}),
    }
)
DISPOSITION = Record(
    {
        "decision": Text(values=("admit-unverified", "reject", "withdraw")), "claimedOrigin": Text(values=("unknown", "direct-export", "transferred-copy", "other")), "custodyNote": _exact(2000), "actorRoleClaim": _exact(200),
        "rationale": _exact(2000), "policyReference": _exact(500), "atBrowser": Text(test=dates.is_instant, name="instant"), "timeBasis": Text(values=("browser-clock-untrusted",)),
    }
)
#: Members of checkpoints, anchors and receipts of continuity.
CHECKPOINT = Record({"generation": Number(1), **{k: Text(pattern=SHA256) for k in ("payloadDigest", "ledgerGenesisHash", "terminalHash", "terminalStateDigest")}, "auditCount": Number(1), "predecessorTerminalHash": Nullable(Text(pattern=SHA256))})


def _chained(v: Column) -> Column:
    """An initial anchor names none before it; a later one names both, and its generation follows."""
    prior, before = get(v, "previousAnchorDigest"), get(v, "previousCheckpoint")
    none = F.is_variant_null(prior) & F.is_variant_null(before)
    later = ~F.is_variant_null(prior) & ~F.is_variant_null(before)
    follows = get(get(v, "activeCheckpoint"), "generation", "long") == get(before, "generation", "long") + 1
    return F.when(get(v, "sequence", "long") == 1, none).otherwise(later & F.coalesce(follows, F.lit(False)))


ANCHOR = Record(
    {
        "schema": Text(120, 1), "version": Number(1), "workspaceId": Text(pattern=SAFE_ID), "lineageId": Text(pattern=SAFE_ID), "sequence": Number(1), "previousAnchorDigest": Nullable(Text(pattern=SHA256)),
        "initialAcceptance": Entries(Scalar(), forbidden=FORBIDDEN), "activeCheckpoint": CHECKPOINT, "previousCheckpoint": Nullable(CHECKPOINT), "digest": Text(pattern=SHA256),
    },
    tests={"not-chained": _chained},
)
RECEIPT = Record({"schema": Text(120, 1), "version": Number(1), "workspaceId": Text(pattern=SAFE_ID), "lineageId": Text(pattern=SAFE_ID), "sequence": Number(1), "anchorDigest": Text(pattern=SHA256), "activeCheckpoint": CHECKPOINT})
