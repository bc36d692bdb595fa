"""Operator 11, Merkle dataset manifest with pointer-jumping proofs.

1. Leaves are digests of rows. Their places within their group come from one range sort: a row's place is its index in
   its range plus the group's rows in earlier ranges, so no group is ever one task's work.
2. Nodes: groups of 2^STEP neighbouring nodes become STEP levels of parents in one shuffle each.
3. Proofs: every node starts with the segment of one step, its sibling towards its parent. A round joins the table with
   itself: a node whose segment reaches the ancestor 2^r steps up appends that ancestor's segment, which doubles the
   distance. Only nodes whose level is a multiple of 2^(r+1) are asked for again, so the tables shrink to the leaves'
   whole paths, after about log2(height) rounds. Near the top many nodes ask for few ancestors, whose table is then
   small: Spark broadcasts it by its size.
4. The roots of all groups are the leaves of one more tree, built the same way; a leaf's proof goes through both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.llm.common import finished, materialise, read_table, release, written

STEP = 4  # levels of one shuffle: groups of 16 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree whose leaves are the groups' roots


def _spelt(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(*texts: Column) -> Column:
    """Lower-case hex sha256 of texts, concatenated."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.coalesce(F.lower(F.hex(digest)), F.lit(""))


def leaf_of(row: dict[str, Column]) -> Column:
    """Digest of a row's FIELDS, each `-` if null, else its bytes in UTF-8, `:` and its value."""
    return _hash(*[_spelt(row[f]) for f in FIELDS])


def _placed(rows: DataFrame, group: list[str], order: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """rows with a column pos, their place from 0 within their group by `order`; and (group, n), the groups' sizes."""
    own = [*group, *order]
    rows = materialise(rows.repartitionByRange(*own).sortWithinPartitions(*own).withColumn("at", F.monotonically_increasing_id()), tag)  # range in the upper bits
    piece = F.shiftright("at", 33)
    pieces = rows.groupBy(*group, piece.alias("piece")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    pieces = materialise(pieces.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")), f"{tag}-pieces")
    named = pieces.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("piece").alias("_piece"), "base")
    same = piece == F.col("_piece")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    placed = rows.join(named, same).withColumn("pos", F.col("at") + F.col("base")).drop("at", "base", "_piece", *[f"_{g}" for g in group])
    return placed, pieces.groupBy(*group).agg(F.sum("n").alias("n"))


def _parents(nodes: Column) -> Column:
    """Digests of every two consecutive nodes; a last one alone makes one too."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.unhex(_hash(_hex(F.get(nodes, 2 * i)), _hex(F.get(nodes, 2 * i + 1)))))


def _steps(nodes: Column, level: int, first: Column) -> Column:
    """Rows (level, pos, step, digest) of consecutive nodes, the first one's place being even."""

    def node(_, i: Column) -> Column:
        step = F.struct(F.when(i % 2 == 1, F.get(nodes, i - 1)).alias("left"), F.when(i % 2 == 0, F.get(nodes, i + 1)).alias("right"))
        return F.struct(F.lit(level).alias("level"), (first + i).alias("pos"), step.alias("step"), F.lit(None).cast("binary").alias("digest"))

    return F.transform(nodes, node)


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """leaves (tree, pos, height, digest), pos from 0 within a tree -> the written tables of nodes, and (tree, root).

    Nodes are (tree, level, pos, height, step, digest): step (left, right) is the sibling towards the parent, if any; rows
    with a digest are those from which the next STEP levels grow."""
    tables, level, tops = [], 0, leaves.select("tree", "pos", "height", "digest")
    roots = tops.where("height = 0").select("tree", F.col("digest").alias("root"))
    most = leaves.agg(F.max("height")).first()[0] or 0
    while level < most:
        block = tops.where(F.col("height") > level).groupBy("tree", "height", F.shiftright("pos", STEP).alias("block"))
        rows = block.agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own"))  # 2^STEP nodes at most
        rows = rows.withColumn("a0", F.col("own.digest"))
        emitted = []
        for j in range(STEP):
            more = F.col("height") > level + j
            rows = rows.withColumn(f"a{j + 1}", F.when(more, _parents(F.col(f"a{j}"))).otherwise(F.slice(f"a{j}", 1, 1)))
            emitted.append(F.when(more, _steps(F.col(f"a{j}"), level + j, F.shiftleft("block", STEP - j))).otherwise(F.array()))
        top = F.struct(F.least(F.lit(level + STEP), F.col("height")).alias("level"), F.col("block").alias("pos"), F.lit(None).cast("struct<left:binary,right:binary>").alias("step"), F.col(f"a{STEP}")[0].alias("digest"))
        table = materialise(rows.select("tree", "height", F.explode(F.concat(*emitted, F.array(top))).alias("node")).select("tree", "node.level", "node.pos", "height", "node.step", "node.digest"), "nodes")
        tables.append(table)
        level += STEP
        tops = table.where("digest is not null")
        roots = roots.unionByName(tops.where(F.col("height") <= level).select("tree", F.col("digest").alias("root")))
    return tables, roots


def paths(tables: list[DataFrame]) -> DataFrame | None:
    """Tables of build() -> (tree, pos, path): all siblings of each leaf up to its tree's root (none: trees of one leaf)."""
    if not tables:
        return None
    state = tables[0]
    for t in tables[1:]:
        state = state.unionByName(t)
    state = state.where("step is not null").select("tree", "level", "pos", "height", F.array("step").alias("path"))
    most = tables[0].agg(F.max("height")).first()[0]
    span, held = 1, None
    while span < most:
        low = state.where(F.col("level") % (2 * span) == 0).withColumn("up", F.shiftright("pos", span))
        high = state.where(F.col("level") % (2 * span) == span).select("tree", (F.col("level") - span).alias("level"), F.col("pos").alias("up"), F.col("path").alias("more"))
        joined = low.join(high, ["tree", "level", "up"], "left").select("tree", "level", "pos", "height", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"))
        state = materialise(joined, "segments")
        if held is not None:
            release(held)
        span, held = 2 * span, state
    return state.where("level = 0").select("tree", "pos", "path")


NO_PATH = "array<struct<left:binary,right:binary>>"


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, path) of every row: digests as 32 bytes, path from the leaf to the root.

    changed is the leaf of the tampered row, null where nothing is tampered: where 7 divides crc32(doc_id) n_chars is
    one more (null stays). Groups are values of lang (null is one); within them rows ascend by doc_id (nulls first), ties
    by leaf, repeated rows are leaves of their own. Any column may be null; other columns are ignored. No rows: no rows."""
    row = {f: F.col(f) for f in FIELDS}
    tampered = row | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", "lang", F.unhex(leaf_of(row)).alias("digest"), F.when(hit, F.unhex(leaf_of(tampered))).alias("changed"), F.monotonically_increasing_id().alias("row"))
    placed, sizes = _placed(materialise(leaves, "leaves"), ["lang"], ["doc_id", "digest", "row"], "ordered")  # row: copies are dealt to several ranges too
    trees, _ = _placed(sizes.select("lang", "n"), [], ["lang"], "trees")
    trees = materialise(trees.select(F.col("lang").alias("_lang"), F.col("pos").alias("tree"), _height(F.col("n")).alias("height")), "trees")
    placed = materialise(placed.join(trees, placed.lang.eqNullSafe(F.col("_lang"))).select("tree", "height", "pos", "doc_id", "digest", "changed"), "placed")
    tables, roots = build(placed)
    roots = materialise(roots, "roots")
    count = F.lit(roots.count())
    top_tables, top = build(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), _height(count).alias("height"), F.col("root").alias("digest")))
    top = top.select(F.col("root")).first()
    none = F.array().cast(NO_PATH)
    path, top_path = paths(tables), paths(top_tables)
    rows = placed.withColumn("path", none) if path is None else placed.join(path, ["tree", "pos"], "left")
    rows = rows.join(roots.withColumnRenamed("root", "subroot"), "tree")
    rows = rows.withColumn("top_path", none) if top_path is None else rows.join(top_path.select(F.col("pos").alias("tree"), F.col("path").alias("top_path")), "tree")
    path = F.concat(F.coalesce("path", none), F.col("top_path"))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "changed", "subroot", F.lit(bytes(top.root) if top else None).cast("binary").alias("root"), path.alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf's digest and its path of siblings lead to."""
    return F.aggregate(path, _hex(leaf), lambda at, s: _hash(_hex(s["left"]), at, _hex(s["right"])))


def verified(rows: DataFrame) -> DataFrame:
    """Rows of manifest() -> the proof's digest, the root recomputed from the row as it is now, and whether it holds."""
    siblings = F.transform("path", lambda s: F.concat(_hex(s["left"]), _hex(s["right"])))
    out = rows.select(
        "doc_id",
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        _hash(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark, sf_dir):
    before = written()
    return finished(verified(manifest(read_table(spark, sf_dir, "documents").select(*FIELDS))), "manifest", before)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = " || ".join(_FIELD.format(f) for f in FIELDS)
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, sha256({_LEAF}) AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN sha256({_LEAF.replace("CAST(n_chars AS", "CAST(n_chars + 1 AS")}) END AS changed FROM documents)
), tree(lang, level, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT l.id, t.level, l.pos >> t.level & 1 AS odd, s.h FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos = l.pos >> t.level AND t.n > 1
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.pos = xor(t.pos, 1)
  UNION ALL SELECT l.id, 1000 + t.level, r.pos >> t.level & 1, s.h FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.pos = r.pos >> t.level AND t.n > 1
    LEFT JOIN top s ON s.level = t.level AND s.pos = xor(t.pos, 1)
), numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS k FROM steps),
proofs AS (SELECT id, coalesce(string_agg(h, '' ORDER BY level), '') AS proof, count(*) AS k FROM steps GROUP BY id),
fold(id, k, h) AS (
  SELECT id, 0, coalesce(changed, leaf) FROM leaves
  UNION ALL SELECT f.id, f.k + 1, sha256(CASE WHEN s.odd = 1 THEN coalesce(s.h, '') ELSE '' END || f.h || CASE WHEN s.odd = 0 THEN coalesce(s.h, '') ELSE '' END) FROM fold f JOIN numbered s ON s.id = f.id AND s.k = f.k + 1
)
SELECT l.doc_id, l.leaf, r.subroot, t.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.n = 1 LEFT JOIN proofs p ON p.id = l.id JOIN fold f ON f.id = l.id AND f.k = coalesce(p.k, 0)
"""
