"""Index search, stored revisions and large arrays against plain forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bibspark.operators import lists, search, snapshots, tables
from bibspark.sources import jsons

RECORD = "id string, title string, creators array<string>, identifiers array<struct<scheme:string,value:string>>, format string"


def test_index_equals_scan(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcÄ%_ ") for _ in range(rnd.randint(1, 6)))
    rows = [(f"P-{i}", rnd.choice([None, word() + " " + word()]), rnd.choice([None, [], [word(), word()]]), [("isbn", str(rnd.randrange(9999)))], rnd.choice(["Book", "Map"])) for i in range(500)]
    rows.append(("empty", "", [], [], "Book"))
    records = spark.createDataFrame(rows, RECORD)
    folder = tables.new_folder(spark, "grams")
    search.build_index(records, folder)
    for q in ("", "a", "Ab", "abc", "ä%_", "p-12", "ca ab", "zzz", "99", "P-499 "):
        for fmt in (None, "Book"):
            want = sorted(r.id for r in lists.search(records, q, fmt).collect())
            assert sorted(r.id for r in search.indexed_search(records, folder, q, fmt).collect()) == want, q


def test_index_reads_few_postings(spark):
    """The filter on grams reaches the scan of the postings, and files of other grams are left out by their bounds."""
    records = spark.range(3000).select(F.concat(F.lit("id"), F.md5(F.col("id").cast("string").cast("binary"))).alias("id"), F.lit("t").alias("title"), F.array().cast("array<string>").alias("creators"), F.array().cast("array<struct<scheme:string,value:string>>").alias("identifiers"), F.lit("Book").alias("format"))
    folder = tables.new_folder(spark, "grams")
    search.build_index(records, folder)
    found = search.candidates(records, folder, "0a1b")
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().toString() or "In(gram" in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert found.count() < 100


def test_stored_revisions_take_no_shuffle(spark):
    a = spark.range(2000).select("id", (F.col("id") % 7).alias("v"))
    b = spark.range(100, 2100).select("id", (F.col("id") % 7 + F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("v"))
    name = lambda w: f"rev_{w}_{tables.uuid.uuid4().hex}"
    x, y = snapshots.store(a, name("a"), "id", 4), snapshots.store(b, name("b"), "id", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = snapshots.diff(x, y, "id", ["v"])
        assert "Exchange" not in spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, snapshots.diff(a, b, "id", ["v"]).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _made(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return [_made(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    if kind == 6:
        return {rnd.choice(["a", "b}", "items", '"', "\\"]): _made(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}
    return [None, True, rnd.randint(-9, 9), 1.5, rnd.choice(["", "x", '"', "\\", '\\"', "],{[", "a, b: c", "ü\n"])][kind]


@pytest.mark.parametrize("member, indent", [(None, None), (None, 1), ("items", None), ("items", 2)])
def test_large_arrays(spark, tmp_path, member, indent):
    """Items of any kind, in files that many tasks read, as the json module has them."""
    rnd, want = random.Random(str(member)), {}
    for f, n in {"many": 300, "one": 1, "none": 0}.items():
        items = [_made(rnd) for _ in range(n)]
        whole = items if member is None else {"first": [1, {"items": [2]}], "items": items, "last": {"items": []}}
        (tmp_path / f"{f}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=False))
        want[f] = items
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got: dict = {f: {} for f in want}
        for r in jsons.read_large_array(spark, str(tmp_path), "*.json", member).collect():
            got[r.path.rpartition("/")[2][:-5]][r.ordinal] = json.loads(r.json)
        assert {f: [g[k] for k in sorted(g)] for f, g in got.items()} == want and all(sorted(g) == list(range(1, len(g) + 1)) for g in got.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_postings_take_no_hash_table(spark):
    """Postings are sorted, not gathered in a hash table a task; a key with two records counts each gram once; and the text is made once a record."""
    records = spark.createDataFrame([("a", "xy abc", [], [], "Book"), ("a", "abcd", [], [], "Map"), ("b", "bcd", [], [], "Book")], RECORD)
    folder = tables.new_folder(spark, "grams")
    search.build_index(records, folder)
    assert spark.read.parquet(f"{folder}/postings").where("gram = 'abc' and key = 'a'").count() == 2
    assert sorted(r.title for r in search.indexed_search(records, folder, "abc").collect()) == ["abcd", "xy abc"]
    plan = records.select(search.grams(search.haystack()).alias("g"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat_ws") == 1


def test_large_arrays_are_not_shuffled(spark, tmp_path):
    """Only the items at the ends of a range are: before, every piece of the file was shuffled several times."""
    items = [{"id": i, "name": f'"{i}", [x' * 5} for i in range(20_000)]
    (tmp_path / "a.json").write_text(json.dumps({"x": [1], "items": items}))
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = lambda: store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    last = max((s.stageId() for s in map(stages().apply, range(stages().size()))), default=-1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = {r.ordinal: json.loads(r.json) for r in jsons.read_large_array(spark, str(tmp_path), "*.json", "items").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(items, 1))
    now = stages()
    sent = sum(s.shuffleWriteBytes() for s in map(now.apply, range(now.size())) if s.stageId() > last)
    assert sent < (tmp_path / "a.json").stat().st_size / 10
