"""Running state over ranges, list ranking of trees, and structure of XML files, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from bibspark.operators import hierarchy, scan, tables
from bibspark.sources import structure, xml


@pytest.fixture(params=[1, 7])
def partitions(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running(spark, partitions):
    """One hot group, many small ones and a null one: sums with the row, last values before it, and places."""
    rnd = random.Random(partitions)
    rows = [(rnd.choice(["hot"] * 6 + [None, "", *"abcdefgh"]), i, rnd.randint(-3, 3), rnd.choice([None, None, f"v{i}"])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i int, n int, s string").repartition(5)
    got = scan.running(df, ["g"], ["i"], sums={"total": F.col("n")}, earlier={"last": F.col("s"), "pair": F.when(F.col("s").isNotNull(), F.struct("i", "s"))}, place="place")
    assert got.columns == ["g", "i", "n", "s", "total", "place", "last", "pair"]
    want, state = {}, {}
    for g, i, n, s in sorted(rows, key=lambda r: r[1]):
        total, place, last, at = state.get(g, (0, 0, None, None))
        want[i] = (total + n, place + 1, last, (at, last) if last else None)
        state[g] = (total + n, place + 1, s or last, i if s else at)
    assert {r.i: (r.total, r.place, r["last"], tuple(r.pair) if r.pair else None) for r in got.collect()} == want
    assert scan.running(df.limit(0), ["g"], ["i"], sums={"total": F.col("n")}).collect() == []
    whole = scan.running(df, [], ["i"], sums={"total": F.col("n")})
    assert whole.agg(F.max_by("total", "i")).first()[0] == sum(r[2] for r in rows)


def plain_preorder(rows):
    known = {i for i, _ in rows}
    children, roots = {}, []
    for i, p in rows:
        roots.append(i) if p not in known else children.setdefault(p, []).append(i)
    out = set()
    for r in roots:
        stack, n = [(r, 0)], 0
        while stack:
            i, depth = stack.pop()
            out.add((i, r, depth, n))
            n += 1
            stack += [(c, depth + 1) for c in sorted(children.get(i, []), reverse=True)]
    return out


@pytest.mark.parametrize("levels", [0, 64])
def test_preorder(spark, partitions, levels, monkeypatch):
    """By pointer jumping, and by levels."""
    monkeypatch.setattr(hierarchy, "LEVELS", levels)
    rnd = random.Random(2)
    rows = [(i, None if i < 4 else rnd.choice([rnd.randrange(i), 3, 3])) for i in range(400)]  # unit 3 has half of all units below it
    rows += [(900, 901), (901, 902), (902, 900), (903, 900), (950, 777), (951, 950)]  # a cycle with a tail, an orphan
    got = hierarchy.preorder(spark.createDataFrame(rows, "id long, parent_id long"))
    assert {(r.id, r.root, r.depth, r.position) for r in got.collect()} == plain_preorder(rows)
    order = [r.id for r in got.where("root = 3").orderBy("path").collect()]
    assert order == [i for i, *_ in sorted((x for x in plain_preorder(rows) if x[1] == 3), key=lambda x: x[3])]
    assert hierarchy.preorder(spark.createDataFrame([], "id long, parent_id long")).collect() == []


def test_deep_chain(spark):
    """10,000 levels: as many rounds as the logarithm of the tour, and nothing but the result is left behind."""
    n = 10_000
    seen, stage = [], hierarchy.stage
    hierarchy.stage = lambda df, tag: seen.append(tag) or stage(df, tag)
    fs = spark._jvm.org.apache.hadoop.fs.Path(tables.shared_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = lambda: {f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(tables.shared_dir(spark)))}
    hierarchy.stage(spark.range(1), "first")
    before = folders()
    try:
        got = hierarchy.preorder(spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id")))
    finally:
        hierarchy.stage = stage
    assert len([t for t in seen if t == "tour"]) <= 1 + (2 * n).bit_length()
    assert got.where("depth <> id or position <> id or root <> 0").count() == 0 and got.count() == n
    assert len(folders() - before) == 1


def test_parents_by_depth(spark, partitions):
    rnd = random.Random(4)
    rows, depth = [], 0
    for i in range(300):
        depth = max(0, min(depth + 1, depth + rnd.choice([1, 0, 0, -1, -2])))
        rows.append(("f", i, depth, f"u{i}"))
    got = hierarchy.parents_by_depth(spark.createDataFrame(rows, "f string, i int, d int, u string"), "f", "i", "d", "u", "above")
    want, last = {}, {}
    for _, i, d, u in rows:
        want[i] = last.get(d - 1)
        last[d] = u
    assert {r.i: r.above for r in got.collect()} == want


GOOD = """<?xml version="1.0"?>
<ead xmlns="urn:e" xmlns:x="urn:x"><!-- a < b <c> --><archdesc id="a" level="fonds"><did><unittitle>One &amp; <![CDATA[<two>]]></unittitle></did>
<odd><head>h</head><p>text</p></odd><c id="b" level="file"><did><unittitle>B</unittitle><origination><name>N</name></origination></did></c><c id='d' level="series" audience="internal"><c id="e" level="item"/></c></archdesc></ead>"""


def _files(spark, folder, **docs):
    for name, doc in docs.items():
        (folder / f"{name}.xml").write_text(doc)
    return structure.elements(structure.tag_stream(spark, str(folder)))


def _names(df):
    return df.withColumn("path", F.regexp_extract("path", r"(\w+)\.xml$", 1))


def test_elements(spark, tmp_path, partitions):
    rows = _files(spark, tmp_path, good=GOOD, flat="<r>" + "<a x='1'/>" * 50 + "</r>")
    got = sorted((r.path, r.pos, r.kind, r.name, r.depth, r.parent) for r in _names(rows).where("kind <> 'close'").collect())
    good = [r for r in got if r[0] == "good"]
    assert [(n, d, p) for *_, n, d, p in good] == [("ead", 1, None), ("archdesc", 2, "ead"), ("did", 3, "archdesc"), ("unittitle", 4, "did"), ("odd", 3, "archdesc"), ("head", 4, "odd"), ("p", 4, "odd"), ("c", 3, "archdesc"), ("did", 4, "c"), ("unittitle", 5, "did"), ("origination", 5, "did"), ("name", 6, "origination"), ("c", 3, "archdesc"), ("c", 4, "c")]
    assert [r[2:] for r in got if r[0] == "flat"] == [("open", "r", 1, None)] + [("empty", "a", 2, "r")] * 50


@pytest.mark.parametrize(
    "old, new, want",
    [
        ("<odd>", "<odd><odd/>", {("child", "odd in odd"), ("count", "p")}),
        ("<head>h</head><p>text</p>", "<p>text</p><head>h</head>", {("order", "head")}),
        ("<p>text</p>", "<p>text</p><p/>", {("count", "p")}),
        ("<p>text</p>", "", {("count", "p")}),
        ("<did><unittitle>B", "<did colour='red'><unittitle>B", {("attribute", "colour of did")}),
        ("<did><unittitle>B", "<did>mixed<unittitle>B", {("mixed-text", "did")}),
        ("<name>N</name>", "<y:name>N</y:name>", {("namespace", "y")}),
        ("<name>N</name>", "<x:name>N</x:name>", set()),
        ('xmlns:x="urn:x"', 'xmlns:x="urn:other"', {("namespace", "urn:other")}),
        ("<name>N</name>", "<nickname/>", {("element", "nickname")}),
        ("<name>N</name>", "<name id=>N</name>", {("malformed", "")}),
    ],
)
def test_structure(spark, tmp_path, old, new, want):
    assert old in GOOD
    rows = _files(spark, tmp_path, one=GOOD.replace(old, new, 1))
    profile = structure.ead_profile()
    got = {(r.problem, r.detail) for r in structure.structure_rejects(rows, profile, ("urn:e", "urn:x")).collect()}
    assert (want <= got if ("malformed", "") in want else got == want), got


def test_ead_of_any_size(spark, tmp_path):
    """A document of many flat components is read by many tasks, as the reader of whole texts reads it."""
    n = 20_000
    flat = "".join(f'<c id="u{i}" level="file"><did><unittitle>T {i} &lt;</unittitle></did><odd><p>o{i}</p></odd></c>\n' for i in range(n))
    (tmp_path / "big.xml").write_text(f'<ead><archdesc id="top" level="fonds"><did><unittitle>Top</unittitle><origination><name>A</name><name>B</name></origination></did><dsc>{flat}</dsc></archdesc></ead>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert structure.tag_stream(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        units, values = structure.read_ead_files(spark, str(tmp_path))
        assert units.count() == n + 1 and units.where("parent_id = 'top' and depth = 2 and level = 'file'").count() == n
        assert values.where("unit_id = 'u777'").select("field_id", "value_index", "s").collect() == [("note", 0, "o777"), ("title", 0, "T 777 <")] or {tuple(r) for r in values.where("unit_id = 'u777'").select("field_id", "value_index", "s").collect()} == {("title", 0, "T 777 <"), ("note", 0, "o777")}
        assert values.where("unit_id = 'top' and field_id = 'creator'").first().s == "A B"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ead_readers_agree(spark, tmp_path):
    (tmp_path / "one.xml").write_text(GOOD)
    units, values = structure.read_ead_files(spark, str(tmp_path))
    plain = GOOD.replace("<![CDATA[<two>]]>", "&lt;two&gt;").replace("<!-- a < b <c> -->", "").replace("'", '"')
    other, told = xml.read_ead(spark.createDataFrame([("one", plain)], "path string, text string"))
    key = ["unit_id", "parent_id", "depth", "level", "published"]
    assert sorted(map(str, units.select(*key).collect())) == sorted(map(str, other.where("unit_id <> 'e'").select(*key).union(other.sparkSession.createDataFrame([("e", "d", 3, "item", True)], other.select(*key).schema)).collect()))
    assert {(r.unit_id, r.field_id, r.s) for r in values.collect()} >= {(r.unit_id, r.field_id, r.s) for r in told.where("unit_id = 'b'").collect()}


@pytest.mark.parametrize("block", [0, 2, 16])
def test_blocks_of_tours(spark, partitions, block, monkeypatch):
    """Units that stand together are ranked together: a chain of 5,000 levels takes a round for each doubling of its blocks only; and
    trees in any order, with cycles inside and across blocks, are ranked as before."""
    seen, stage = [], hierarchy.stage
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    monkeypatch.setattr(hierarchy, "LEVELS", 0)
    rnd = random.Random(block)
    rows = [(i, None if i < 3 else rnd.randrange(max(0, i - 9), i)) for i in range(300)] + [(900, 901), (901, 902), (902, 900), (903, 900)]
    rnd.shuffle(rows)
    got = hierarchy.preorder(spark.createDataFrame(rows, "id long, parent_id long"))
    assert {(r.id, r.root, r.depth, r.position) for r in got.collect()} == plain_preorder(rows)
    if block == 16:
        monkeypatch.setattr(hierarchy, "stage", lambda df, tag: seen.append(tag) or stage(df, tag))
        chain = hierarchy.preorder(spark.range(0, 5000, 1, 4).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id")))
        assert chain.where("depth <> id or position <> id or root <> 0").count() == 0 and chain.count() == 5000
        assert seen.count("tour") <= 6


def test_mixed_text_and_plan(spark, tmp_path):
    """Text before, between and behind children is mixed, once for each element; that of leaves is not. Rules read one written table of
    elements: before, each rule found all parents anew and joined all places with text."""
    docs = {"before": "<c>x<did/></c>", "between": "<c><did/>y<odd/>z</c>", "behind": "<c><did/> w </c>", "broken": "<c>x<1><did/></c>", "leaf": "<c>said</c>", "blank": "<c> \n<did/>\t</c>", "inner": "<c><did>x</did></c>"}
    rows = _files(spark, tmp_path, **docs)
    found = structure.structure_rejects(rows, structure.ead_profile())
    mixed = _names(found.where("problem = 'mixed-text'")).collect()
    assert sorted((r.path, r.pos, r.detail) for r in mixed) == [(n, 1, "c") for n in ("before", "behind", "between", "broken")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window ") <= 1  # places of siblings
