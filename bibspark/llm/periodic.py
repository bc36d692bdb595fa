"""Operator 12, periodic runs of words, by suffix trees and Lyndon roots.

A run is a stretch with smallest period q that has at least LEAST words and POWER periods and cannot be extended.

1. Stretches: in a run of POWER periods every three words stand at least three times, and all of them follow each other.
   Maximal sequences of such triples are searched, the rest of a text holds no run. This is repeated inside the
   stretches (at most ROUNDS times: it only narrows the search).
2. Ukkonen's algorithm builds the suffix tree of a stretch and that of its reversal. The tour of a tree, with the depth
   of each node's parent, answers the longest common extension of two places by one range minimum in constant time.
3. The longest Lyndon word at each place, for an order of the words and for the opposite one, ends at the next smaller
   suffix. Every run has such a word as its root: each is extended to both sides, and what has POWER periods is a run.

Words are split at ASCII white space and compared as they are. A text is one task's work, in time and memory linear in
its words (times their logarithm for the range minima).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import batch, read_table

LEAST = 6
POWER = 4
ROUNDS = 8
NONE = np.zeros((0, 3), np.int64)


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Intervals of ids, outside of which no run lies; a run lies in one of them as a whole."""
    if len(ids) < LEAST:
        return []
    _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, gram = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True)
    at = np.arange(len(gram))
    for _ in range(ROUNDS):
        place = np.cumsum(np.r_[True, at[1:] != at[:-1] + 1]) - 1  # sequences of neighbouring triples
        _, kind, count = np.unique(place * len(gram) + gram[at], return_inverse=True, return_counts=True)
        keep = (count[kind] >= 3) & (np.bincount(place)[place] >= LEAST - 2)
        if keep.all():
            break
        at = at[keep]
        if not len(at):
            return []
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    last = np.r_[cut[1:], len(at)] - 1
    return [(a, z + 3) for a, z in zip(at[cut].tolist(), at[last].tolist(), strict=True) if z + 3 - a >= LEAST]


class SuffixTree:
    """Of symbols above 0, closed by a 0: rank and opposite (places of the suffixes in both orders) and extensions."""

    def __init__(self, symbols: list[int], ranks: bool = True):
        text = [*symbols, 0]
        n, width = len(text), max(text) + 1
        start, stop, child = _ukkonen(text, width)
        key = np.fromiter(child.keys(), np.int64, len(child))
        kid = np.fromiter(child.values(), np.int64, len(child))
        del child
        order = np.argsort(key)
        key, kid = key[order], kid[order]
        up = np.zeros(len(start), np.int64)
        up[kid] = key // width
        first = np.searchsorted(key // width, np.arange(len(start) + 1)).tolist()
        length = (np.array(stop) - np.array(start)).tolist()
        del start, stop
        kids, parent = kid.tolist(), up.tolist()
        tour, depth, stack = [], [0] * len(parent), [0]
        while stack:
            v = stack.pop()
            tour.append(v)
            depth[v] = depth[parent[v]] + length[v]
            stack += kids[first[v] : first[v + 1]][::-1]
        tour, depth = np.array(tour), np.array(depth)
        leaf = np.diff(first) == 0
        self.entry = np.zeros(n, np.int32)  # of each suffix's leaf in the tour
        entered = np.zeros(len(depth), np.int32)
        entered[tour] = np.arange(len(tour))
        self.entry[n - depth[leaf]] = entered[leaf]
        table = depth[up[tour]].astype(np.int32)
        self.minima = [table]  # of the 1, 2, 4, ... entries from each on
        while 1 << len(self.minima) <= len(table):
            half = 1 << len(self.minima) - 1
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))
        if ranks:
            self.rank = np.argsort(np.argsort(self.entry)).tolist()
            ended = (key % width == 0).tolist()  # the end of the text comes first in both orders
            back, stack = [], [0]
            while stack:
                v = stack.pop()
                a, z = first[v], first[v + 1]
                if a == z:
                    back.append(v)
                elif ended[a]:
                    stack += kids[a + 1 : z]
                    stack.append(kids[a])
                else:
                    stack += kids[a:z]
            opposite = np.zeros(n, np.int64)
            opposite[n - depth[np.array(back)]] = np.arange(n)
            self.opposite = opposite.tolist()

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols from the different places i and j on."""
        a, z = np.minimum(self.entry[i], self.entry[j]) + 1, np.maximum(self.entry[i], self.entry[j])
        level = np.frexp(z - a + 1)[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.minima[k][a[own]], self.minima[k][z[own] + 1 - (1 << k)])
        return out


def _ukkonen(text: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Edges' starts and stops by the node they lead to (0: the root), and nodes by parent * width + symbol."""
    n = len(text)
    start, stop, link, child = [0], [0], [0], {}
    node = edge = length = left = 0  # the place reached, and how many suffixes end there without a leaf
    for i, c in enumerate(text):
        left += 1
        fresh = -1  # a new node whose link is not known yet
        while left:
            if not length:
                edge = i
            key = node * width + text[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(start)
                start.append(i), stop.append(n), link.append(0)
                if fresh >= 0:
                    link[fresh], fresh = node, -1
            else:
                begin = start[to]
                size = stop[to] - begin
                if length >= size:
                    node, edge, length = to, edge + size, length - size
                    continue
                if text[begin + length] == c:
                    length += 1
                    if fresh >= 0:
                        link[fresh] = node
                    break
                middle = len(start)
                start.append(begin), stop.append(begin + length), link.append(0)
                child[key] = middle
                start[to] = begin + length
                child[middle * width + text[begin + length]] = to
                child[middle * width + c] = middle + 1
                start.append(i), stop.append(n), link.append(0)
                if fresh >= 0:
                    link[fresh] = middle
                fresh = middle
            left -= 1
            if node:
                node = link[node]
            elif length:
                length, edge = length - 1, i - left + 1
    return start, stop, child


def _next_smaller(rank: list[int]) -> np.ndarray:
    """Of each place but the last the next one with a smaller rank; the last one's is the smallest."""
    out = [0] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:-1], np.int64)


def runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period."""
    found = [NONE]
    for a, z in stretches(ids):
        _, own = np.unique(ids[a:z], return_inverse=True)
        symbols, m = (own + 1).tolist(), z - a
        tree = SuffixTree(symbols)
        at = np.tile(np.arange(m), 2)
        period = np.concatenate([_next_smaller(tree.rank), _next_smaller(tree.opposite)]) - at
        near = POWER * period <= m
        at, period = at[near], period[near]
        end = at + period + tree.extension(at, at + period)
        del tree
        start = at - SuffixTree(symbols[::-1], ranks=False).extension(m - at, m - at - period)
        good = end - start >= np.maximum(LEAST, POWER * period)
        found.append(np.stack([start[good] + a, (end - start)[good], period[good]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def by_start(found: np.ndarray) -> np.ndarray:
    return found[np.lexsort((found[:, 2], found[:, 0]))]


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def periodic_runs(docs: DataFrame, altered=None, with_text: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed) of every row.

    start to exponent_milli are those of the longest run (ties: smallest start, then period), null without a run.
    collapsed: the text's words, joined by one space, without those that a run repeats (all but its first period); null
    unless with_text. Null texts are empty; repeated rows and null ids stay; other columns are ignored. altered(doc_id, n)
    gives for a text's n words the numbers of those that stand in their places, or None."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256", "collapsed")])

    def one(doc, raw):
        words = (raw or b"").split()
        if words and altered and (places := altered(doc, len(words))) is not None:
            words = [words[i] for i in places]
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        found = by_start(runs(ids))
        best = (None,) * 4
        if len(found):
            i = np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]
            start, length, period = found[i].tolist()
            best = start, length, period, 1000 * length // period
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, found[:, 0] + found[:, 2], 1)
            np.add.at(change, found[:, 0] + found[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        text = b" ".join(words)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in found.tolist())
        return doc, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text else None

    def run(batches):
        for b in batches:
            rows = [one(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield batch(schema, *zip(*rows, strict=True)) if rows else batch(schema, *[[]] * len(schema))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, COLUMNS)


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's rule: where 10 divides crc32(doc_id), the words from a on repeat the p words that begin there."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def op12_runs(spark, sf_dir):
    return periodic_runs(read_table(spark, sf_dir, "documents"), made_periodic, with_text=False).drop("collapsed")
