"""Nested contracts: every rule at its path, and stored records of each kind."""

import copy
import json

import pytest

from pyspark.sql import functions as F

from bibspark.operators import contracts as C
from bibspark.operators.tables import spread

SHA = "0" * 64


def found(spark, spec, *values):
    """Of each value (JSON text or object) the sorted (path, rule)."""
    rows = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    out = [[] for _ in rows]
    for r in C.broken(spark.createDataFrame(rows, "i int, j string"), spec, "j", "i").collect():
        out[r.i].append((r.path, r.rule))
    return [sorted(x) for x in out]


def test_rules(spark):
    spec = C.Record(
        {"t": C.Text(3, 1, pattern="^[a-z]*$"), "n": C.Number(1, 5), "f": C.Flag()},
        {"v": C.Text(values=("x", "y")), "l": C.Items(C.Record({"k": C.Number(whole=False)}), 2, 1), "m": C.Entries(C.Items(C.Scalar(), 2, alone=True), 2, ("bad",)), "z": C.Nullable(C.Text()), "d": C.Items(C.Text(), distinct=True)},
        {"odd": lambda v: C.get(v, "n", "long") != 4},
    )
    good = {"t": "ab", "n": 2, "f": True}
    cases = [
        (good, []),
        (None, [("", "not-json")]),
        ("{", [("", "not-json")]),
        ('{"t":"a","t":"b"}', [("", "not-json")]),
        ([1], [("", "not-object")]),
        ({}, [("f", "missing"), ("n", "missing"), ("t", "missing")]),
        ({"t": "", "n": 0, "f": "true"}, [("f", "not-boolean"), ("n", "range"), ("t", "too-short")]),
        ({"t": "abcd", "n": 6, "f": 1}, [("f", "not-boolean"), ("n", "range"), ("t", "too-long")]),
        ({"t": "A", "n": 1.5, "f": False}, [("n", "not-whole"), ("t", "pattern")]),
        ({"t": 5, "n": "5", "f": None}, [("f", "not-boolean"), ("n", "not-number"), ("t", "not-text")]),
        ({**good, "n": 4}, [("", "odd")]),
        ({**good, "a.b": 1, "c": {}}, [("a.b", "unknown-key"), ("c", "unknown-key")]),
        ({**good, "v": "q"}, [("v", "value")]),
        ({**good, "l": []}, [("l", "too-few")]),
        ({**good, "l": [{"k": 1}, {"k": 1.5}, {"k": "1"}, {"q": 1}, 7]}, [("l", "too-many"), ("l[2].k", "not-number"), ("l[3].k", "missing"), ("l[3].q", "unknown-key"), ("l[4]", "not-object")]),
        ({**good, "l": "x"}, [("l", "not-list")]),
        ({**good, "m": {"a": 1, "b": ["x", True]}}, []),
        ({**good, "m": {"a": {}, "bad": 1, "c": [1, [2], 3]}}, [("m", "too-many"), ("m.a", "not-scalar"), ("m.bad", "forbidden-key"), ("m.c", "too-many"), ("m.c[1]", "not-scalar")]),
        ({**good, "z": None}, []),
        ({**good, "z": 1}, [("z", "not-text")]),
        ({**good, "d": ["a", "b", "a"]}, [("d", "repeated")]),
    ]
    for (value, want), got in zip(cases, found(spark, spec, *[v for v, _ in cases]), strict=True):
        assert got == sorted(want), value


RECORD = {
    "id": "R-1", "title": "T", "creators": ["A"], "year": "2020", "format": "Book", "identifiers": [{"scheme": "isbn", "value": "1"}], "links": ["https://example.org/x"], "availability": "Online", "edition": "", "location": "",
    "suppressed": False, "publicVisible": True, "requestable": True, "metadata": {"volume": "1", "subjects": ["s"]}, "source": {"format": "ris", "label": "l", "digest": "d", "ordinal": 1, "trace": {"TI": "x"}, "elements": [{"code": "TI", "name": "t", "value": "v", "definition": "d"}]},
}
UNIT = {"id": "u", "schemaId": "s", "schemaVersion": 1, "parentId": None, "level": "file", "values": {"a": ["x", 1], "b": True}, "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-01-01T00:00:00.5Z"}
SCHEMA = {"id": "s", "name": "n", "description": "", "profile": "ead4", "version": 1, "fields": [{"id": "f", "label": "l", "definition": "", "kind": "text", "required": True, "repeatable": False, "vocabulary": ["a"], "mappings": {"ead": "x"}}], "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-01-01T00:00:00Z"}
SERVICE = {"id": "s", "kind": "k", "area": "a", "title": "t", "state": "ok", "ownerRole": "o", "system": "", "sensitivity": "low", "values": {"n": 1}, "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-01-01T00:00:00Z"}
DESCRIPTOR = {"source": {"kind": "catalog-import", "filename": "a.ris", "format": "ris", "bytes": 10, "sha256": SHA}, "review": {"structuralStatus": "passed", "canonicalPayloadSha256": SHA, "parserProfile": "p"}, "scope": {"kind": "catalog-records", "entityIds": ["a", "b"]}}
DISPOSITION = {"decision": "reject", "claimedOrigin": "unknown", "custodyNote": "c", "actorRoleClaim": "r", "rationale": "w", "policyReference": "p", "atBrowser": "2024-01-01T00:00:00Z", "timeBasis": "browser-clock-untrusted"}
POINT = {"generation": 1, "payloadDigest": SHA, "ledgerGenesisHash": SHA, "terminalHash": SHA, "terminalStateDigest": SHA, "auditCount": 3, "predecessorTerminalHash": None}
ANCHOR = {"schema": "s", "version": 1, "workspaceId": "w", "lineageId": "l", "sequence": 1, "previousAnchorDigest": None, "initialAcceptance": {}, "activeCheckpoint": POINT, "previousCheckpoint": None, "digest": SHA}
RECEIPT = {"schema": "s", "version": 1, "workspaceId": "w", "lineageId": "l", "sequence": 1, "anchorDigest": SHA, "activeCheckpoint": POINT}


def changed(value, path, new):
    out = copy.deepcopy(value)
    at = out
    for k in path[:-1]:
        at = at[k]
    if new is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = new
    return out


@pytest.mark.parametrize(
    "spec, good, cases",
    [
        (C.STORED_RECORD, RECORD, [(["id"], " x", ("id", "pattern")), (["format"], "Scroll", ("format", "value")), (["links", 0], "http://10.0.0.1/", ("links[0]", "url")), (["metadata", "volume"], "v" * 65, ("metadata.volume", "too-long")), (["metadata", "colour"], "", ("metadata.colour", "unknown-key")), (["metadata", "notes"], ["n"] * 101, ("metadata.notes", "too-many")), (["identifiers", 0, "value"], " ", ("identifiers[0].value", "blank")), (["identifiers", 0, "scheme"], "ean", ("identifiers[0].scheme", "value")), (["source", "trace", "TI"], 1, ("source.trace.TI", "not-text")), (["source", "elements", 0, "code"], KeyError, ("source.elements[0].code", "missing")), (["edition"], KeyError, ("edition", "missing"))]),
        (C.STORED_UNIT, UNIT, [(["values", "__proto__"], 1, ("values.__proto__", "forbidden-key")), (["values", "a", 1], {}, ("values.a[1]", "not-scalar")), (["createdAt"], "2024-02-30T00:00:00Z", ("createdAt", "instant")), (["parentId"], 5, ("parentId", "not-text")), (["values", "c"], [1] * 251, ("values.c", "too-many"))]),
        (C.STORED_SCHEMA, SCHEMA, [(["fields", 0, "required"], 1, ("fields[0].required", "not-boolean")), (["fields", 0, "mappings", "marc"], "x", ("fields[0].mappings.marc", "unknown-key")), (["fields", 0, "label"], "l" * 121, ("fields[0].label", "too-long")), (["version"], 1.5, ("version", "not-whole"))]),
        (C.STORED_SERVICE, SERVICE, [(["values", "n"], [[1]], ("values.n[0]", "not-scalar")), (["ownerRole"], None, ("ownerRole", "not-text"))]),
        (C.DESCRIPTOR, DESCRIPTOR, [(["scope", "entityIds"], ["a", "a"], ("scope.entityIds", "repeated")), (["scope", "entityIds", 1], " b", ("scope.entityIds[1]", "not-canonical")), (["source", "bytes"], 0, ("source.bytes", "range")), (["source", "sha256"], "A" * 64, ("source.sha256", "pattern")), (["review", "structuralStatus"], "failed", ("review.structuralStatus", "value"))]),
        (C.DISPOSITION, DISPOSITION, [(["decision"], "accept", ("decision", "value")), (["rationale"], "", ("rationale", "too-short")), (["atBrowser"], "yesterday", ("atBrowser", "instant"))]),
        (C.ANCHOR, ANCHOR, [(["sequence"], 2, ("", "not-chained")), (["previousAnchorDigest"], SHA, ("", "not-chained")), (["activeCheckpoint", "terminalHash"], "x", ("activeCheckpoint.terminalHash", "pattern"))]),
        (C.RECEIPT, RECEIPT, [(["anchorDigest"], None, ("anchorDigest", "not-text")), (["extra"], 1, ("extra", "unknown-key"))]),
    ],
)
def test_stored(spark, spec, good, cases):
    got = found(spark, spec, good, *[changed(good, path, new) for path, new, _ in cases])
    assert got == [[], *[[want] for *_, want in cases]]


def test_extended_anchor(spark):
    later = {**ANCHOR, "sequence": 2, "previousAnchorDigest": SHA, "previousCheckpoint": POINT}
    assert found(spark, C.ANCHOR, {**later, "activeCheckpoint": {**POINT, "generation": 2}}, later, {**later, "previousCheckpoint": None}) == [[], [("", "not-chained")], [("", "not-chained")]]


def test_plan_grows_with_the_contract(spark):
    """A value is named once, so each level of a contract adds its own expressions and multiplies none; and the rows of a small file are many tasks' work."""
    spec, sizes = C.Items(C.Text(3, 1)), []
    for _ in range(4):
        spec = C.Record({"a": C.Items(spec)})
        plan = spark.range(1).select(C.violations(spec, F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
        sizes.append(plan.count("try_variant_get"))
    assert sizes[-1] - sizes[-2] == sizes[-2] - sizes[-3], sizes
    assert spread(spark.range(10), "id").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
