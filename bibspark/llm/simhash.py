"""Operator 5, SimHash near-dedup by pivot distance tables.

One table holds every distinct fingerprint with its coordinates: its Hamming distances to PIVOTS fixed reference
fingerprints. It is written once and its rows are dealt to cells. Hamming distance is a metric, so two fingerprints
within r bits differ by at most r in every coordinate: pairs of a cell whose largest coordinate difference exceeds r are
discarded, and survivors are verified by their fingerprints.

* Cells of few bits: block pivots (zero, and one mask per bit) give by difference of distances each bit. r changed bits
  touch at most r of G = r + 3 groups of bits, so at least three groups keep equal coordinates: one cell per choice of
  three groups. No pair within r bits is missed.
* Cells of near copies (five-word shingles, similarity 0.8): at that similarity some ten of 64 bits differ, so no equal
  blocks are left; the KEYS smallest shingle hashes of a text are its cells instead. The table and the bits discard with
  a wide margin, and what they leave is verified by the exact similarity of the shingle sets. Cells of more than PAIRS
  rows are joined inside the cell: pairs are verified there, so that only links that hold make its trees.

Cells are streamed sorted and no task ever holds an unbounded group: a cell of more than CELL rows is dealt anew, as
salted pairs of sub-cells, or, of near copies, in parts (see similar_links). Only a spanning forest of a cell's links is
emitted, never all its pairs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import batch, finished, gathered, materialise, may_be_in, mix64, read_table, release, run_hashes, salt, split_words, word_hashes, written
from bibspark.llm.graph import components

CELL = 2048
PAIRS = 16  # rows of a cell whose pairs are all compared at once
PAIR_COST = 400_000  # multiplications that take as long as comparing two sets
CELL_BYTES = 64 << 20  # of shingle hashes that a cell of near copies holds
SEED = 42
BITS = 64
PIVOTS = 32
KEYS = 6  # smallest shingle hashes of a text
SLACK = 3.5  # standard errors that a pair's estimated similarity may lie below the threshold before it is discarded


def shingles(text: str | None, words: int) -> list[bytes]:
    """Word shingles in order, repeats included; fewer words: the whole sequence; no word: none."""
    w = split_words(text)
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def majority(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run of n hashes: the bits that are set in over half of them (no hash: zero)."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    at = 0
    while at < len(some):  # pieces of whole runs; one very long run is summed in parts
        end = at + max(1, int(np.searchsorted(starts[some[at:]] + n[some[at:]], starts[some[at]] + 65_536, "right")))
        own = some[at:end]
        lo, hi = starts[own[0]], starts[own[-1]] + n[own[-1]]
        if len(own) == 1:
            count = sum(np.unpackbits(hashes[i : min(i + 65_536, hi)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(lo, hi, 65_536))[None]
        else:
            count = np.add.reduceat(np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts[own] - lo, axis=0, dtype=np.int32)
        out[own] = np.packbits((2 * count > n[own][:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]
        at = end
    return out


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes, repeats included."""
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles(text, words)), np.uint64)
    return int(majority(h, np.zeros(1, np.int64), np.array([len(h)]))[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row. Null or empty text: fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield batch(schema, b.column(0), fps.view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def pivots(lanes: int) -> np.ndarray:
    return mix64(np.arange(1, PIVOTS * lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(PIVOTS, lanes)


def coordinates(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows of 64-bit words) to the pivots."""
    return np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in pivots(fp.shape[1])], axis=1)


def exact_cells(radius: int):
    """Cell keys (choice of groups, their bits) of one-word fingerprints, complete up to `radius` bits."""
    groups = np.array_split(np.arange(BITS), radius + 3)
    chosen = list(itertools.combinations(range(radius + 3), 3))

    def keys(fp: np.ndarray) -> np.ndarray:
        out = np.empty((len(fp), len(chosen)), np.uint64)
        for t, groups_of in enumerate(chosen):
            mask = np.uint64(sum(1 << int(i) for g in groups_of for i in groups[g]))
            out[:, t] = mix64((fp[:, 0] & mask) ^ mix64(salt(t + 1) + np.zeros(1, np.uint64)))
        return out

    return keys


def _lists(flat: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), flat)


def _bodies(fp: np.ndarray) -> pa.Array:
    """Fingerprint and coordinates of each row as bytes."""
    at = coordinates(fp).astype(np.uint8 if 64 * fp.shape[1] < 256 else np.uint16)
    raw = np.concatenate([fp.view(np.uint8), at.view(np.uint8)], axis=1)
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32).tobytes() if len(fp) else b"\0" * 4), pa.py_buffer(raw.tobytes())])


def _read_bodies(bodies: pa.Array, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and coordinates again."""
    offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1]
    raw = np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(bodies), -1)
    at = np.ascontiguousarray(raw[:, 8 * lanes :]).view(np.uint8 if 64 * lanes < 256 else np.uint16)
    return np.ascontiguousarray(raw[:, : 8 * lanes]).view(np.uint64), at.astype(np.int16)


def pivot_table(fps: DataFrame, lanes: int, cells=None) -> DataFrame:
    """fps (id, fp array<long>[, keys array<long>]) -> written table (id, body binary, keys): body is the fingerprint and
    its coordinates; keys, where cells is given, are the cells of the fingerprint."""
    schema = pa.schema([("id", pa.int64()), ("body", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            fp = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
            keys = b.column(2)
            if cells:
                own = cells(fp)
                keys = _lists(own.reshape(-1).view(np.int64), own.shape[1])
            yield batch(schema, b.column(0), _bodies(fp), keys)

    keys = F.array().cast("array<long>") if cells else F.col("keys")
    return materialise(fps.select("id", "fp", keys.alias("keys")).mapInArrow(run, "id long, body binary, keys array<long>"), "pivots")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= radius


def _forest(fp: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the rows within `radius` of each other."""
    left = np.arange(len(fp))
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            start, reached = reached[0], reached[1:]
            keep = (np.abs(table[left] - table[start]) <= radius).all(axis=1)
            keep[keep] = _near(fp[left[keep]], fp[start], radius)
            found = left[keep]
            for other in found:
                yield int(start), int(other)
            reached, left = np.concatenate([reached, found]), left[~keep]


def _links(key: np.ndarray, ids: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: links of each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    u, v = [], []
    small = np.repeat(sizes <= PAIRS, sizes)
    for lag in range(1, min(PAIRS, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small[:-lag] & (key[:-lag] == key[lag:]))
        i = i[(np.abs(table[i] - table[i + lag]) <= radius).all(axis=1)]
        i = i[_near(fp[i], fp[i + lag], radius)]
        u.append(ids[i]), v.append(ids[i + lag])
    for s, n in zip(starts[sizes > PAIRS], sizes[sizes > PAIRS], strict=True):
        pairs = list(_forest(fp[s : s + n], table[s : s + n], radius))
        if pairs:
            at = np.array(pairs) + s
            u.append(ids[at[:, 0]]), v.append(ids[at[:, 1]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _in_cells(radius: int, lanes: int, most: int | None):
    """Streams rows (key, id, body) sorted by key -> links (u, v). Rows of cells larger than `most` come back as (key, u)."""
    schema = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def links(rows: pa.RecordBatch):
        fp, table = _read_bodies(rows.column(2), lanes)
        u, v = _links(rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False), fp, table, radius)
        return batch(schema, pa.nulls(len(u), pa.int64()), u, v)

    def late(rows: pa.RecordBatch):
        return batch(schema, rows.column(0), rows.column(1), pa.nulls(rows.num_rows, pa.int64()))

    def one(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def closed(rows: pa.RecordBatch):
        """Whole cells; those over `most` rows go back."""
        key = rows.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        big = np.repeat(sizes > most, sizes) if most else np.zeros(len(key), bool)
        if big.any():
            yield late(rows.filter(pa.array(big)))
        if not big.all():
            yield links(rows.filter(pa.array(~big)) if big.any() else rows)

    def run(batches):
        held, n_held, large = [], 0, None  # rows of the last, still open cell; the key of a cell that is too large
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            if large is not None and len(key):
                n = int(np.searchsorted(key, large, "right"))
                if n:
                    yield late(b.slice(0, n))
                b, key = b.slice(n), key[n:]
                if len(key):
                    large = None
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            if held and held[0].column(0)[0].as_py() != key[-1]:
                done, held, n_held = [*held, b.slice(0, cut)], [], 0
                yield from closed(one(done))
            elif cut:
                yield from closed(b.slice(0, cut))
            held.append(b.slice(cut))
            n_held += len(key) - cut
            if most and n_held > most:
                large = key[-1]
                for part in held:
                    yield late(part)
                held, n_held = [], 0
        if held:
            yield links(one(held))

    return run


def _streamed(rows: DataFrame, radius: int, lanes: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """rows (key, id, body) -> links (u, v), and the (key, id) of cells that are too large; both written."""
    table = materialise(rows.select("key", "id", "body").repartition("key").sortWithinPartitions("key", "id").mapInArrow(_in_cells(radius, lanes, most), "key long, u long, v long"), "cells")
    return table.where("v is not null").select("u", "v"), table.where("v is null").select("key", F.col("u").alias("id"))


def _in_parts(late: DataFrame) -> DataFrame:
    """late with the number of parts of at most half a CELL that its cell makes, and the part of each row."""
    parts = late.groupBy("key").agg(F.ceil(F.count("*") / (CELL // 2)).cast("int").alias("parts"))
    return late.join(parts, "key").withColumn("s", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def near_links(table: DataFrame, radius: int, lanes: int) -> DataFrame:
    """A pivot table, ids distinct -> (u, v): links that connect the ids within `radius` bits that share a cell.

    Cells of more than CELL rows go through salted pairs of sub-cells, which lose no link."""
    body = table.select("id", "body")
    links, late = _streamed(table.withColumn("key", F.explode("keys")), radius, lanes, CELL)
    if late.isEmpty():
        return links
    parts = _in_parts(late).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    more, _ = _streamed(parts.select(F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t")).alias("key"), "id").join(body, "id"), radius, lanes, None)
    return links.unionByName(more)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of docs (doc_id, text; other columns are ignored).

    Rows whose fingerprints are joined by links of at most `radius` differing bits share a component; component_id is
    its smallest doc_id. Texts without a word have fingerprint zero and are linked like any other; a row with a null
    doc_id is kept and takes the component of its fingerprint (null if no row there has a doc_id). Repeated rows stay
    repeated; an empty table gives an empty result."""
    before = written()
    fps = materialise(fingerprints(docs, words), "fps")
    kinds = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "kinds")
    table = pivot_table(kinds.select(F.col("fp").alias("id"), F.array("fp").alias("fp")), 1, exact_cells(radius))
    roots = components(near_links(table, radius, 1))
    known = kinds.join(roots, kinds.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(lowest, "root").select("fp", "component_id")
    return finished(fps.join(named, "fp").select("doc_id", "fp", "component_id"), "components", before)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, flat and sorted within each, and how many each text has."""
    h, n = word_hashes(texts)
    starts = np.cumsum(n) - n
    size = np.where(n > words, n - words + 1, np.minimum(n, 1))  # fewer words: the whole sequence
    doc = np.repeat(np.arange(len(n)), size)
    at = starts[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    x = run_hashes(h, at, at + np.minimum(words, n[doc])) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])] if len(x) else np.zeros(0, bool)
    return x[new], np.bincount(doc[new], minlength=len(n))


def _sketches(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """(doc_id, same long, size, fp, keys) of every row: same is a hash of the shingle set, keys its KEYS smallest hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("size", pa.int64()), ("fp", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x, n = shingle_sets(part.column(1), words)
                starts = np.cumsum(n) - n
                fp = np.stack([majority(mix64(x + salt(k + 1)), starts, n) for k in range(lanes)], axis=1)
                same = run_hashes(mix64(x), starts, starts + n)
                few = np.minimum(n, KEYS)
                at = np.repeat(starts - np.cumsum(few) + few, few) + np.arange(few.sum())
                keys = pa.ListArray.from_arrays(np.r_[0, np.cumsum(few)].astype(np.int32), x[at].view(np.int64))
                yield batch(schema, part.column(0), same.view(np.int64), n, _lists(fp.reshape(-1).view(np.int64), lanes), keys)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, same long, size long, fp array<long>, keys array<long>")


def _sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """Written (id, hashes) of chosen (id, doc_id): the distinct shingle hashes of that text of the document whose set has
    the hash id. Copies of a row go where the join has brought them together, so the sets are not shuffled."""
    schema = pa.schema([("id", pa.int64()), ("same", pa.int64()), ("size", pa.int64()), ("hashes", pa.binary())])

    def sets(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x, n = shingle_sets(part.column(1), words)
                ends = np.cumsum(n)
                yield batch(schema, part.column(0), run_hashes(mix64(x), ends - n, ends).view(np.int64), n, [y.tobytes() for y in np.split(x, ends[:-1])])

    few = may_be_in(docs, "doc_id", chosen.select("doc_id")).where("_may").drop("_may")  # texts of no chosen row are not shuffled
    texts = few.join(chosen, "doc_id").dropDuplicates(["doc_id", "id", "text"])
    known = texts.select("id", "text").mapInArrow(sets, "id long, same long, size long, hashes binary")
    found = materialise(known.where(F.col("id") == F.xxhash64("same", "size")).select("id", "hashes"), "sets")  # other texts of a doc_id go
    if found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found
    once = materialise(found.dropDuplicates(["id"]), "sets")  # texts of one doc_id that differ in case or spaces
    release(found)
    return once


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least the Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    z = np.sort(np.concatenate([x, y]), kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return both >= similarity * (len(x) + len(y) - both)


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of links (u, v) whose shingle sets have at least the similarity."""

    def run(batches):
        for b in batches:
            keep = [alike(*(np.frombuffer(z.as_buffer(), np.uint64) for z in pair), similarity) for pair in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"{c}_set"))
    return links.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def _candidates(fp: np.ndarray, table: np.ndarray, size: np.ndarray, label: np.ndarray, own: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Of a cell's rows a lower triangle of the pairs of different labels whose sizes, pivot distances and bits may do."""
    out = np.zeros((len(fp), len(fp)), bool)
    for i in range(1, len(fp)):
        at = np.flatnonzero((label[:i] != label[i]) & (own[:i] | own[i]) & (size[:i] >= similarity * size[i]) & (size[i] >= similarity * size[:i]))
        at = at[(np.abs(table[at] - table[i]) <= radius).all(axis=1)]
        out[i, at[_near(fp[at], fp[i], radius)]] = True
    return out


def _shared(sets: list[np.ndarray], kinds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many hashes each two sets share: products of 0/1 columns, of the hashes that several sets have."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    often = np.bincount(which) > 1
    column = (np.cumsum(often) - 1)[which]
    keep = often[which]
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both, width = np.zeros((n, n), np.float32), max(1, (1 << 24) // n)
    for first in range(0, int(often.sum()), width):
        a, z = np.searchsorted(column, [first, first + width])
        x = np.zeros((n, width), np.float32)
        x[row[a:z], column[a:z] - first] = 1
        both += x @ x.T
    return both


def linked_cell(fp: np.ndarray, table: np.ndarray, sets: list[np.ndarray], label: np.ndarray, own: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links of similar sets that join all rows of a cell which similar sets join, with what their labels join already.

    Pairs of one label so far are not looked at; of the others, those whose pivot distances, bits and sizes may do are
    compared exactly: one by one, or, where most pairs may do, all at once by a product of matrices, whichever is less
    work. A pair of rows that are both not its own is another cell's."""
    size, label = np.array(list(map(len, sets))), label.copy()
    may = _candidates(fp, table, size, label, own, radius, similarity)
    pairs = int(may.sum())
    both = None
    if pairs > len(sets):
        kinds, which = np.unique(np.concatenate(sets), return_inverse=True)
        if pairs * PAIR_COST > 2 * len(sets) ** 2 * int((np.bincount(which) > 1).sum()):
            both = _shared(sets, kinds, which)
            may &= both >= similarity * (size[:, None] + size[None] - both)
    for i in np.flatnonzero(may.any(axis=1)).tolist():
        for j in np.flatnonzero(may[i]).tolist():
            if label[j] != label[i] and (both is not None or alike(sets[i], sets[j], similarity)):
                yield i, j
                label[label == label[j]] = label[i]


def _by_cell(of_cell):
    """Streams rows sorted by key, and gives each cell's rows to of_cell."""

    def whole(parts):
        return of_cell(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])

    def run(batches):
        held = []
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for x, y in zip(cut, cut[1:], strict=False):
                if x == y:
                    continue
                if held and held[0].column(0)[0].as_py() != key[x]:
                    yield whole(held)
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield whole(held)

    return run


def _with_candidates(rows: DataFrame, radius: int, lanes: int, similarity: float) -> DataFrame:
    """rows (key, id, label, own, body, size), cells of bounded size -> written (key, id, label, own): those that may be
    similar to a row of their cell. Only their sets are read and shuffled."""

    def chosen(rows: pa.RecordBatch):
        fp, table = _read_bodies(rows.column(4), lanes)
        label, own, size = (rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 5))
        may = _candidates(fp, table, size, label, own, radius, similarity)
        return rows.select([0, 1, 2, 3]).filter(pa.array(may.any(axis=0) | may.any(axis=1)))

    dealt = rows.select("key", "id", "label", "own", "body", "size").repartition("key").sortWithinPartitions("key", "id")
    return materialise(dealt.mapInArrow(_by_cell(chosen), "key long, id long, label long, own boolean"), "chosen")


def _similar_in_cells(rows: DataFrame, radius: int, lanes: int, similarity: float) -> DataFrame:
    """rows (key, id, label, own, body, hashes), cells of bounded size -> written (u, v): verified links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(rows: pa.RecordBatch):
        fp, table = _read_bodies(rows.column(4), lanes)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(5)]
        ids, label = (rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        found = np.array(list(linked_cell(fp, table, sets, np.unique(label, return_inverse=True)[1], rows.column(3).to_numpy(zero_copy_only=False), radius, similarity)), np.int64).reshape(-1, 2)
        return batch(schema, ids[found[:, 0]], ids[found[:, 1]])

    dealt = rows.select("key", "id", "label", "own", "body", "hashes").repartition("key").sortWithinPartitions("key", "id")
    return materialise(dealt.mapInArrow(_by_cell(links), "u long, v long"), "alike")


def similar_links(late: DataFrame, pairs: DataFrame, kinds: DataFrame, table: DataFrame, docs: DataFrame, words: int, radius: int, lanes: int, similarity: float) -> DataFrame:
    """(u, v): verified links that connect the ids of each cell of late (key, id), with those of pairs (u, v) that hold.

    A cell is dealt in parts of bounded rows and bytes, joined each within itself. Of cells of several parts, one row of
    each component that came out meets in one more cell; what is left then is compared whole: the rows of a cell's
    largest component stand in one part each, those of all others in every part, and only rows of different components
    are compared. So a hot group of copies costs its rows once, and no link is lost. Rows are first compared by their
    bodies; sets are made of those alone that may be similar to another one."""
    body = table.select("id", "body")
    bodies = body.join(kinds.select("id", "size"), "id")
    sets: list[DataFrame] = []

    def chosen(rows: DataFrame) -> DataFrame:
        return _with_candidates(rows.join(bodies, "id"), radius, lanes, similarity)

    def known_sets(ids: DataFrame) -> DataFrame:
        """Sets of ids, and of those before. Where few are new, their written table is small enough to be broadcast."""
        new = ids.distinct()
        for x in sets:
            new = new.join(x.select("id"), "id", "left_anti")
        new = materialise(kinds.join(new, "id", "left_semi").select("id", F.col("low").alias("doc_id")), "ends")
        if not sets or not new.isEmpty():
            sets.append(_sets(docs, new, words))
        return functools.reduce(DataFrame.unionByName, sets)

    def linked(rows: DataFrame, sets: DataFrame) -> DataFrame:
        return _similar_in_cells(rows.join(body, "id").join(sets, "id"), radius, lanes, similarity)

    sizes = late.join(kinds.select("id", "size"), "id").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("size") * 8 / CELL_BYTES)).cast("int").alias("parts"))
    rows = materialise(late.join(sizes, "key").withColumn("s", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")), "dealt")
    first = chosen(rows.select(F.xxhash64("key", "s").alias("key"), "id", F.col("id").alias("label"), F.lit(True).alias("own")))
    made = known_sets(pairs.select(F.explode(F.array("u", "v")).alias("id")).unionByName(first.select("id")))
    links = materialise(_verified(pairs, made, similarity), "verified").unionByName(linked(first, made))
    big = rows.where("parts > 1")
    if big.isEmpty():
        return links

    def labelled(found: DataFrame) -> DataFrame:
        """big with the component of each row, of cells that hold several."""
        roots = components(found)
        named = big.join(roots, big.id == roots.node, "left").select("key", "id", "s", "parts", F.coalesce("root", "id").alias("label"))
        several = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select("key")
        return materialise(named.join(several, "key", "left_semi"), "labels")

    def more(rows: DataFrame) -> DataFrame:
        may = chosen(rows)
        return links if may.isEmpty() else links.unionByName(linked(may, known_sets(may.select("id"))))

    now = labelled(links)
    firsts = now.groupBy("key", "label").agg(F.min("id").alias("id"))
    groups = firsts.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n"))
    links = more(firsts.join(groups, "key").select(F.xxhash64("key", F.pmod(F.xxhash64("id"), F.col("n"))).alias("key"), "id", "label", F.lit(True).alias("own")))
    now = labelled(links)
    largest = now.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("m")).select("key", F.col("m.label").alias("most"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    spread = now.join(largest, "key").withColumn("t", F.explode(F.when(F.col("label") == F.col("most"), F.array("s")).otherwise(every)))
    return more(spread.select(F.xxhash64("key", "t").alias("key"), "id", "label", (F.col("t") == F.col("s")).alias("own")))


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 2) -> DataFrame:
    """(doc_id, group_id) of every distinct doc_id: group_id is the smallest doc_id of its group of near copies.

    Similarity is the exact Jaccard similarity of sets of `words`-word shingles (fewer words: the whole sequence). A
    Jaccard similarity j is the cosine 2j / (1 + j), whose angle over pi is the expected share of differing bits of a
    SimHash; pairs beyond that share by more than SLACK standard errors are discarded, the others verified. Null texts
    count as empty; texts without a word are copies of each other. Rows with a null doc_id are left out; of several rows
    of one doc_id each text counts, and the group is the smallest of theirs."""
    share, bits = np.arccos(2 * similarity / (1 + similarity)) / np.pi, 64 * lanes
    radius = round(share * bits + SLACK * np.sqrt(share * (1 - share) * bits))
    before = written()
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fps = materialise(_sketches(own, words, lanes), "fps")
    kinds = materialise(fps.groupBy("same", "size").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).withColumn("id", F.xxhash64("same", "size")), "kinds")
    table = pivot_table(kinds.select("id", "fp", "keys"), lanes)
    pairs, late = _streamed(table.withColumn("key", F.explode("keys")), radius, lanes, PAIRS)
    pairs = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    links = similar_links(late, pairs, kinds, table, own, words, radius, lanes, similarity)
    roots = components(links)
    named = kinds.join(roots, kinds.id == roots.node, "left").select("same", "size", "low", F.coalesce("root", "id").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("group_id"))
    named = named.join(lowest, "root").select("same", "size", "group_id")
    return finished(fps.join(named, ["same", "size"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id")), "groups", before)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: all columns of the documents that stay. Rows with a null doc_id stay."""
    gone = materialise(near_duplicate_groups(docs).where("group_id < doc_id").select(F.col("doc_id").alias("_gone")), "gone")
    marked = may_be_in(docs, "doc_id", gone)
    rest = marked.where("_may").drop("_may").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    return marked.where("not _may").drop("_may").unionByName(rest)  # most rows surely stay: their texts are not shuffled


def op5_simhash(spark, sf_dir):
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
