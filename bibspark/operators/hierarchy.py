"""Trees and lineages: depth, cycles, order, roots and topology, by pointer doubling (about log2(depth) joins)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.operators.scan import running
from bibspark.operators.tables import finished, mark, release, stage


def parents_by_depth(units: DataFrame, group: str, order: str, depth: str, unit_id: str, name: str) -> DataFrame:
    """units with column `name`: the last earlier unit of the group that stands one level higher; any depth.

    Each unit answers for its own level and asks at the level above, so one scan over (group, level) finds all; a group
    or a level of any size is many tasks' work. Units of one place in `order` do not see each other."""
    cols = units.columns
    asks = units.withColumns({"_level": F.col(depth) - 1, "_known": F.lit(None).cast("string"), "_answer": F.lit(0)})
    answers = units.withColumns({"_level": F.col(depth), "_known": F.col(unit_id), "_answer": F.lit(1)})
    both = running(asks.unionByName(answers), [group, "_level"], [order, "_answer"], earlier={name: F.col("_known")})
    return both.where("_answer = 0").select(*cols, name)


def orphans(units: DataFrame, group: str | None = None) -> DataFrame:
    """Units whose parent is not a unit (of the same group)."""
    keys = [group] if group else []
    parents = units.select(*keys, F.col("id").alias("parent_id"))  # an anti-join needs no distinct ids, whose hash table would grow with a task's split
    return units.where("parent_id is not null").join(parents, [*keys, "parent_id"], "left_anti").select("id", "parent_id")


def depths(units: DataFrame) -> DataFrame:
    """(id, root, depth, resolved) for units (id, parent_id), ids distinct.

    depth counts steps to the root. A missing parent ends the walk there (the orphan is its own root). Units on or
    below a cycle never reach a root: resolved is false, root and depth are null."""
    since = mark()
    known = units.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    state = units.select("id", "parent_id").join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("up"))
    state = stage(state.select("id", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("up").isNull().alias("done")), "depth")
    left = None
    while True:
        jump = state.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("done").alias("stop"))
        old = state
        moved = state.where("not done").join(jump, "top").select("id", F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("stop").alias("done"))
        state = stage(state.where("done").unionByName(moved), "depth")
        release(old)
        open_now = state.where("not done").count()
        # a walk of n open units ends within log2(n) + 1 rounds unless it is cyclic
        if open_now == 0 or (left is not None and open_now == left[0] and left[1] >= max(2, open_now.bit_length() + 1)):
            break
        left = (open_now, left[1] + 1 if left and left[0] == open_now else 1)
    return finished(state.select("id", F.when(F.col("done"), F.col("top")).alias("root"), F.when(F.col("done"), F.col("steps")).alias("depth"), F.col("done").alias("resolved")), "depths", since)


def hierarchy_findings(units: DataFrame, max_component_depth: int = 32) -> DataFrame:
    """(id, problem): missing-parent, cycle, too-deep (more than max_component_depth levels under the root)."""
    d = depths(units)
    missing = orphans(units).select("id", F.lit("missing-parent").alias("problem"))
    cyclic = d.where("not resolved").select("id", F.lit("cycle").alias("problem"))
    deep = d.where(F.col("depth") > max_component_depth).select("id", F.lit("too-deep").alias("problem"))
    return missing.unionByName(cyclic).unionByName(deep)


LEVELS = 16  # trees of more levels are ranked by pointer jumping
BLOCK = 16  # 2^BLOCK units that stand together in the input are ranked within one task first


def _siblings(units: DataFrame, order_by: str) -> tuple[DataFrame, DataFrame]:
    """(id, parent_id, key, inner, block) with null parents where the parent is missing, inner where a unit has children; and its
    rows with a parent, with their rank among their siblings and where the tour left the one before. Ranks come from a
    scan, so a parent may have any number of children."""
    ids = units.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    parents = units.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("inner", F.lit(True))
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK)
    rows = units.select("id", "parent_id", F.col(order_by).alias("key"), block.alias("block")).join(ids, "parent_id", "left").join(parents, "id", "left")
    rows = stage(rows.select("id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), "key", F.coalesce("inner", F.lit(False)).alias("inner"), "block"), "units")
    children = running(rows.where("parent_id is not null").drop("block"), ["parent_id"], ["key", "id"], earlier={"before": F.struct("id", F.col("inner").alias("up"))}, place="rank")
    return rows, stage(children, "children")


def _by_level(rows: DataFrame, children: DataFrame) -> DataFrame | None:
    """(id, root, depth, position) by a join a level, or None where trees have more than LEVELS levels: the ranks on the
    way to a unit sort like the pre-order."""
    level = rows.where("parent_id is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("trail"))
    found = level
    for d in range(1, LEVELS + 1):
        up = level.select(F.col("id").alias("parent_id"), "root", "trail")
        level = stage(children.join(up, "parent_id").select("id", "root", F.lit(d).cast("long").alias("depth"), F.concat("trail", F.lpad(F.col("rank").cast("string"), 19, "0")).alias("trail")), "level")
        if level.isEmpty():
            placed = running(found, ["root"], ["trail"], place="place")
            return placed.select("id", "root", "depth", (F.col("place") - 1).alias("position"))
        found = found.unionByName(level)
    return None


def _tour(rows: DataFrame, children: DataFrame) -> DataFrame:
    """Successors in the Euler tours of all trees: (id, up, next_id, next_up, units, levels, block), next null at a tour's end.

    A unit with children is an element where the tour enters it and one where it leaves (up); a unit without is one
    element. units and levels are what an element adds to the number of units met and to the depth."""
    first = F.struct(F.col("parent_id").alias("id"), F.lit(False).alias("up"))
    links = children.select(F.coalesce("before", first).alias("e"), F.col("id").alias("next_id"), F.lit(False).alias("next_up"))
    last = children.groupBy("parent_id").agg(F.max(F.struct("rank", "id", "inner")).alias("l"))
    links = links.unionByName(last.select(F.struct("l.id", F.col("l.inner").alias("up")).alias("e"), F.col("parent_id").alias("next_id"), F.lit(True).alias("next_up")))
    links = links.unionByName(rows.where("parent_id is null").select(F.struct("id", F.col("inner").alias("up")).alias("e"), F.lit(None).cast(rows.schema["id"].dataType).alias("next_id"), F.lit(None).cast("boolean").alias("next_up")))
    own = rows.select(F.col("id").alias("own_id"), "inner", "block")
    out = links.select("e.id", "e.up", "next_id", "next_up").join(own, F.col("id") == F.col("own_id"))
    return out.select("id", "up", "next_id", "next_up", (~F.col("up")).cast("long").alias("units"), F.when(F.col("up"), -1).when(F.col("inner"), 1).otherwise(0).cast("long").alias("levels"), "block")


def _jumped(blocks):
    """Elements (id, up, next_id, next_up, units, levels, end, block) sorted by block: each points to the first element outside its
    block then, or to none where its tour ends inside."""

    def jump(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        codes = pa.chunked_array([b.column(0), b.column(2)]).combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        up, next_up = (b.column(i).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 3))
        units, levels = (b.column(i).to_numpy(zero_copy_only=False).copy() for i in (4, 5))
        place = np.full(2 * (codes.max() + 1), -1)
        place[2 * codes[:n] + up] = np.arange(n)
        to = np.where(codes[n:] >= 0, place[2 * codes[n:] + next_up], -1)
        at = np.arange(n)  # the element whose next one is this element's
        for _ in range(n.bit_length() + 1):  # what still moves then goes round in a cycle
            go = np.flatnonzero(to >= 0)
            if not len(go):
                break
            t = to[go]
            more, lower, then, last = units[t], levels[t], to[t], at[t]
            units[go] += more
            levels[go] += lower
            to[go], at[go] = then, last
        take = pa.array(at)
        cols = {"next_id": b.column(2).take(take), "next_up": b.column(3).take(take), "units": pa.array(units), "levels": pa.array(levels), "end": b.column(6).take(take)}
        return pa.RecordBatch.from_arrays([cols.get(c, b.column(i)) for i, c in enumerate(b.schema.names)], schema=b.schema)

    held = []
    for b in blocks:
        block = b.column(7).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else [0]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            if held and held[-1].column(7)[0].as_py() != block[a]:
                yield jump(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield jump(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _by_list(rows: DataFrame, children: DataFrame) -> DataFrame:
    """(id, root, depth, position) at any depth: the tours are lists, ranked by pointer jumping. First blocks of units that stand together
    in the input are ranked by themselves. Then only elements that another block points to are left; a round joins each
    with the one it points to and adds up what lies between, so that about log2(units) joins reach every list's end; each
    element has one predecessor, so no key is hot."""
    tour = _tour(rows, children).withColumn("end", F.when(F.col("next_id").isNull(), F.col("id")))
    dealt = tour.select("id", "up", "next_id", "next_up", "units", "levels", "end", "block").repartition("block").sortWithinPartitions("block")
    rows = stage(dealt.mapInArrow(_jumped, dealt.schema).drop("block"), "tour")
    heads = rows.where("next_id is not null").select(F.col("next_id").alias("id"), F.col("next_up").alias("up")).distinct()
    met = stage(rows.join(heads, ["id", "up"]).select(*rows.columns), "tour")
    target = lambda df: df.select(F.col("id").alias("next_id"), F.col("up").alias("next_up"), F.col("next_id").alias("then_id"), F.col("next_up").alias("then_up"), F.col("units").alias("more"), F.col("levels").alias("lower"), F.col("end").alias("found"))
    moved = lambda df, to: df.where("next_id is not null").join(target(to), ["next_id", "next_up"]).select("id", "up", F.col("then_id").alias("next_id"), F.col("then_up").alias("next_up"), (F.col("units") + F.col("more")).alias("units"), (F.col("levels") + F.col("lower")).alias("levels"), F.col("found").alias("end"))
    left = None
    while True:
        open_now = met.where("next_id is not null").count()
        if open_now == 0 or (left is not None and open_now == left[0] and left[1] >= max(2, open_now.bit_length() + 1)):
            break  # what is left goes round in a cycle
        left = (open_now, left[1] + 1 if left and left[0] == open_now else 1)
        old = met
        met = stage(met.where("next_id is null").unionByName(moved(met, met)), "tour")
        release(old)
    rows = rows.where("next_id is null").unionByName(moved(rows, met))
    entered = stage(rows.where("not up and end is not null").select("id", "end", "units", "levels"), "entered")  # units: from here to the end of the tour; levels: minus the depth
    sizes = entered.where("id = end").select(F.col("id").alias("root"), F.col("units").alias("size"))
    out = entered.select("id", F.col("end").alias("root"), (-F.col("levels")).alias("depth"), "units").join(sizes, "root")
    return out.select("id", "root", "depth", (F.col("size") - F.col("units")).alias("position"))


def preorder(units: DataFrame, order_by: str = "id") -> DataFrame:
    """(id, root, depth, position, path) of units (id, parent_id, order_by), ids distinct, in trees of any depth.

    position numbers a tree's units from 0, parents before children and siblings in the order of `order_by`, then id;
    path is root and position as one text that sorts so. A missing parent makes a root. Units on or below a cycle are
    left out. Trees of at most LEVELS levels take a join a level, others about log2(units) joins."""
    since = mark()
    rows, children = _siblings(units, order_by)
    out = _by_level(rows, children)
    if out is None:
        out = _by_list(rows, children)
    return finished(out.withColumn("path", F.concat_ws("/", F.col("root").cast("string"), F.lpad(F.col("position").cast("string"), 19, "0"))), "preorder", since)


def children_counts(units: DataFrame) -> DataFrame:
    return units.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))


def root_counts(units: DataFrame, group: str) -> DataFrame:
    """(group, roots, single): groups with exactly one root are single."""
    return units.groupBy(group).agg(F.count_if(F.col("parent_id").isNull()).alias("roots")).withColumn("single", F.col("roots") == 1)


def topology(witnesses: DataFrame, terminals: DataFrame | None = None) -> DataFrame:
    """(lineage_id, witnesses, roots, forks, gaps, heads, status), each lineage judged by itself, all in parallel.

    witnesses: (lineage_id, digest, predecessor_digest, sequence, audit_count), and origin_scope where known; terminals:
    (lineage_id, digest, sequence) that the head has to be. Status, first that holds: terminal-conflict (one digest with
    different contents), invalid (a digest twice), forked (several successors or roots, of one scope), boundary (several
    scopes), gap (no root, a missing predecessor, a root that is not number 1, or a step that is not one more with a
    growing count: what is not connected to the root has one of these), then valid-prefix, or by the terminal truncated,
    terminal-conflict or corroborated. A terminal without a witness gives no-evidence."""
    w = witnesses if "origin_scope" in witnesses.columns else witnesses.withColumn("origin_scope", F.lit(""))
    body = F.struct("predecessor_digest", "sequence", "audit_count", "origin_scope")
    twice = w.groupBy("lineage_id", "digest").agg(F.count("*").alias("n"), F.count_distinct(F.to_json(body)).alias("kinds")).groupBy("lineage_id").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("kinds") > 1).alias("conflicts"))
    after = w.where("predecessor_digest is not null").groupBy("lineage_id", F.col("predecessor_digest").alias("digest")).agg(F.count("*").alias("successors"))
    before = w.groupBy("lineage_id", F.col("digest").alias("predecessor_digest")).agg(F.min("sequence").alias("prior"), F.min("audit_count").alias("prior_audit"))
    rows = w.join(after, ["lineage_id", "digest"], "left").join(before, ["lineage_id", "predecessor_digest"], "left")
    child = F.col("predecessor_digest").isNotNull()
    gap = child & (F.col("prior").isNull() | (F.col("sequence") != F.col("prior") + 1) | (F.col("audit_count") <= F.col("prior_audit"))) | ~child & (F.col("sequence") != 1)
    flags = rows.groupBy("lineage_id").agg(
        F.count("*").alias("witnesses"),
        F.count_if(~child).alias("roots"),
        F.count_if(F.coalesce("successors", F.lit(0)) > 1).alias("forks"),
        F.count_if(gap).alias("gaps"),
        F.count_if(F.col("successors").isNull()).alias("heads"),
        (F.min("origin_scope") != F.max("origin_scope")).alias("scopes"),
        F.max_by("digest", "sequence").alias("head"),
        F.max("sequence").alias("head_at"),
    ).join(twice, "lineage_id")
    status = (
        F.when(F.col("conflicts") > 0, "terminal-conflict")
        .when(F.col("repeated") > 0, "invalid")
        .when((F.col("forks") > 0) | (F.col("roots") > 1) & ~F.col("scopes"), "forked")
        .when(F.col("scopes"), "boundary")
        .when((F.col("gaps") > 0) | (F.col("roots") != 1), "gap")
    )
    if terminals is not None:
        flags = flags.join(terminals.select("lineage_id", F.col("digest").alias("terminal"), F.col("sequence").alias("terminal_at")), "lineage_id", "full")
        zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("witnesses", "roots", "forks", "gaps", "heads")}
        flags = flags.withColumns(zero)
        status = F.when(F.col("witnesses") == 0, "no-evidence").otherwise(status)
        status = F.coalesce(status, F.when(F.col("terminal").isNull(), "valid-prefix").when(F.col("terminal_at") > F.col("head_at"), "truncated").when((F.col("terminal_at") != F.col("head_at")) | (F.col("terminal") != F.col("head")), "terminal-conflict").otherwise("corroborated"))
    return flags.select("lineage_id", "witnesses", "roots", "forks", "gaps", "heads", F.coalesce(status, F.lit("valid-prefix")).alias("status"))
