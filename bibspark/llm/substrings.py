"""Operator 1, substring dedup by collinear chaining.

1. Seeds: K-word shingles whose hash falls into one of EVERY classes. The choice depends on these words alone, so a seed
   that both sides of a fuzzy passage have is kept on both.
2. Each seed of a document is linked to its first occurrence (smallest doc_id) in the corpus and to the last one before
   the document. Seeds that several documents have are linked the same way by the LONG words that begin with them: then
   the first document of such a run stands for all that have it, so a passage is found too where its parts stand in other
   earlier documents. A fuzzy passage has no such run; so seeds that three documents have are linked by a pair too: the
   seed and the first one SPANS words further on, which documents that have but pieces of the passage lack. That is at
   most six rows per seed and never all pairs.
3. Per pair of documents, links on one diagonal become anchors, and ordered anchors are chained: a chain's score is its
   anchors' words less GAP for each word skipped on either side; a Fenwick tree of prefix maxima finds each anchor's best
   predecessor.
4. The words of both sides of a chain are aligned: equal words along anchors, on diagonals or longest common
   subsequences in gaps, and on the diagonal beyond both ends. Maximal segments of the alignment (a match counts 1, a
   word skipped -2, or -1 where that finds none) that have MIN_WORDS words and SIMILARITY are passages.

Texts are met by streaming each document's requests after its text within a partition sorted by document. A document of
many requests is dealt in parts, each with its own copy of the text. Words are split at ASCII white space after
lower-casing A-Z and compared by hashes.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bibspark.llm.common import batch, finished, gathered, materialise, mix64, read_table, run_hashes, salt, word_hashes, written

K = 3
EVERY = 4
LONG = 50
SPANS = (20, 44)  # words from a seed to the other one of its pair: by a bit of the seed's hash, so both sides choose alike
GAP = 0.1
MIN_WORDS = 50
SIMILARITY = 0.8
SKIPPED = (2, 1)  # matches that a skipped word outweighs: first sharp ends, then passages with dense changes near an end
NEAR, DRIFT = 64, 16  # words that neighbouring links of a passage lie apart, and diagonals that they differ by
PAD = 64  # words beyond a chain's ends
LEAST = 8  # words of a chain's anchors
REQUESTS = 512  # of one document in a part


def seeds_of(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the flat words, and hashes, of the seeds of all texts."""
    size = len(words) - K + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for i in range(K):
        h = mix64(h + words[i : i + size] + salt(i + 1))
    whole = np.ones(len(words), bool)
    ends = np.cumsum(n)
    for i in range(1, K):
        last = ends - i
        whole[last[(last >= 0) & (n >= i)]] = False
    at = np.flatnonzero(whole[:size] & (h < np.uint64((1 << 64) // EVERY)))
    return at, mix64(h[at])


def pairs_of(at: np.ndarray, h: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each seed's pair (0: none): the first seed of its text SPANS words further on, within NEAR words."""
    out = np.zeros(len(at), np.int32)
    if not len(at):
        return out
    span = np.where(h >> np.uint64(40) & np.uint64(1), *map(np.int64, SPANS))
    to = np.minimum(np.searchsorted(at, at + span), len(at) - 1)
    good = (at[to] >= at + span) & (at[to] - at <= span + NEAR) & (at[to] + K <= end)
    out[good] = (mix64(h[good] + mix64(h[to[good]] + salt(9))) >> np.uint64(32)).astype(np.uint32).view(np.int32) | 1
    return out


def seeds(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, pos, run, pair): seeds, a 32-bit hash of the LONG words that begin there (0: there are fewer), and
    that of the seed's pair."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("run", pa.int32()), ("pair", pa.int32())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                words, n = word_hashes(part.column(1))
                at, h = seeds_of(words, n)
                ends = np.cumsum(n)
                doc = np.searchsorted(ends, at, "right")
                runs = np.zeros(len(at), np.int32)
                long = at + LONG <= ends[doc]
                runs[long] = (run_hashes(words, at[long], at[long] + LONG) >> np.uint64(32)).astype(np.uint32).view(np.int32) | 1
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield batch(schema, h.view(np.int64), ids[doc], (at - (ends - n)[doc]).astype(np.int32), runs, pairs_of(at, h, ends[doc]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "hash long, doc_id long, pos int, run int, pair int")


LINK, EDGE, HEAD, RUN, PAIR = range(5)
LINKED = "kind int, hash long, doc_id long, pos int, source long, source_pos int"


def _linked(within: bool):
    """Rows (hash, doc_id, pos, run, pair) sorted so -> (kind, hash, doc_id, pos, source, source_pos).

    LINK: to the first document of the hash (in this partition) and to the one before, at their first positions (within:
    also to the first position in the document itself). RUN: rows of a hash that several documents have, under the hash of
    their run. PAIR: rows of a hash that three documents have, under the hash of their pair. What other partitions hold of a partition's first hash is not known here: its first row comes back as EDGE. HEAD: the rows of the last hash that the next partition lacks."""
    schema = pa.schema([("kind", pa.int32()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("source", pa.int64()), ("source_pos", pa.int32())])

    def out(kind, h, d, p, source=None, source_pos=None):
        none = [pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int32())]
        return batch(schema, np.full(len(d), kind, np.int32), h, d, p, *(none if source is None else [source, source_pos]))

    def grouped(kind, h, d, p, x):
        """Rows under the hash of what belongs to them."""
        return out(kind, mix64(h.view(np.uint64) + x.astype(np.uint64) + salt(kind - RUN)).view(np.int64), d, p)

    def run(batches):
        carry, start = None, None
        for b in gathered(batches):
            h, d, p, r, t = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            start = h[0] if start is None else start
            n = 0 if carry is None else len(carry[0])
            if n:
                h, d, p, r, t = (np.r_[x, y] for x, y in zip(carry, (h, d, p, r, t), strict=True))
            i = np.arange(len(h))
            new = np.r_[True, h[1:] != h[:-1]]
            own = new | np.r_[True, d[1:] != d[:-1]]
            first, mine = np.maximum.accumulate(np.where(new, i, 0)), np.maximum.accumulate(np.where(own, i, 0))
            before = np.where(mine > first, mine[np.maximum(mine - 1, 0)], first)
            for to, at in ((first, np.flatnonzero((i >= n) & (d[first] != d))), (before, np.flatnonzero((i >= n) & (before != first) & (d[before] != d))), (mine, np.flatnonzero((i >= n) & (p - p[mine] >= MIN_WORDS)) if within else ())):
                if len(at):
                    yield out(LINK, pa.nulls(len(at), pa.int64()), d[at], p[at], d[to[at]], p[to[at]])
            last = np.r_[np.flatnonzero(new)[1:], len(h)][np.cumsum(new) - 1] - 1
            many = np.flatnonzero((r != 0) & (d[first] != d[last]) | (r != 0) & (h == start))
            if len(many):
                yield grouped(RUN, h[many], d[many], p[many], r[many])
            group = np.cumsum(new) - 1
            three = np.flatnonzero((t != 0) & ((np.bincount(group, own)[group] >= 3) | (h == start)))
            if len(three):
                yield grouped(PAIR, h[three], d[three], p[three], t[three])
            if not n:
                yield out(EDGE, h[:1], d[:1], p[:1])
            keep = sorted({int(first[-1]), int(before[-1]), int(mine[-1])})
            carry = h[keep], d[keep], p[keep], r[keep], t[keep]
        if carry is not None:
            yield out(HEAD, *carry[:3])
            for kind, x in ((RUN, carry[3]), (PAIR, carry[4])):  # the next partition may hold more of this hash
                some = np.flatnonzero(x)
                yield grouped(kind, *(c[some] for c in carry[:3]), x[some])

    return run


def _links(rows: DataFrame, within: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows (hash, doc_id, pos, run, pair) -> the written table of _linked(), and its links (doc_id, source, pos, source_pos).

    Sorted by ranges of (hash, doc_id, pos), so a hot hash is many partitions' work. There each range's first document
    stands for the hash within the range, and is itself linked to the first document of all and to the one before."""
    dealt = rows.repartitionByRange("hash", "doc_id", "pos").sortWithinPartitions("hash", "doc_id", "pos")
    table = materialise(dealt.mapInArrow(_linked(within), LINKED), "links")
    ends = table.where(F.col("kind").isin(HEAD, EDGE)).select("kind", "hash", "doc_id", "pos")
    earlier = Window.partitionBy("hash").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)  # of a hash: few rows a range
    head = F.col("kind") == HEAD
    ends = ends.withColumns({"first": F.min(F.when(head, F.struct(F.col("doc_id").alias("source"), F.col("pos").alias("source_pos")))).over(earlier), "last": F.max(F.when(head, F.struct(F.col("doc_id").alias("source"), (-F.col("pos")).alias("back")))).over(earlier)})
    seams = ends.where(~head & F.col("first").isNotNull()).select("doc_id", "pos", F.explode(F.array("first", F.struct(F.col("last.source").alias("source"), (-F.col("last.back")).alias("source_pos")))).alias("to")).select("doc_id", "pos", "to.source", "to.source_pos")
    return table, table.where(F.col("kind") == LINK).select("doc_id", "pos", "source", "source_pos").unionByName(seams)


def seed_matches(docs: DataFrame, within: bool = False) -> DataFrame:
    """(doc_id, source, pos, source_pos, n): n equal words of two documents.

    Links of seeds, of long runs and of pairs to the same words in other, earlier documents (within: in the same one
    too). A pair's two seeds count as 2 * K words where the first one stands; alignment compares all words anyway."""
    table, links = _links(seeds(docs), within)
    out = links.withColumn("n", F.lit(K))
    for kind, n in ((RUN, LONG), (PAIR, 2 * K)):
        rows = table.where(F.col("kind") == kind).select("hash", "doc_id", "pos", F.lit(0).alias("run"), F.lit(0).alias("pair"))
        out = out.unionByName(_links(rows, within)[1].withColumn("n", F.lit(n)))
    return out


def anchors_of(q: np.ndarray, s: np.ndarray, n: np.ndarray, pair: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(pair, q, s, length), by pair and q: links merged where they overlap or touch on a diagonal of one pair."""
    pair = np.zeros(len(q), np.int64) if pair is None else pair
    order = np.lexsort((n, q, q - s, pair))
    pair, q, s, n = pair[order], q[order], s[order], n[order]
    same = (pair[1:] == pair[:-1]) & ((q - s)[1:] == (q - s)[:-1])
    group = np.r_[True, ~same]
    width = int((q + n).max()) + 1
    base = (np.cumsum(group) - 1) * width  # ends of earlier diagonals stay below every end of this one
    end = np.maximum.accumulate(base + q + n) - base
    new = group | np.r_[True, q[1:] > end[:-1]]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(q)] - 1
    pair, q, s, n = pair[at], q[at], s[at], end[last] - q[at]
    order = np.lexsort((s, q, pair))
    return pair[order], q[order], s[order], n[order]


def chains(anchors: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Best-scoring disjoint chains of anchors sorted by q."""
    if len(anchors) == 1:
        return [anchors]
    ends = sorted({s + n for _, s, n in anchors})
    rank = {e: i + 1 for i, e in enumerate(ends)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ends) + 1)
    score, before = [0.0] * len(anchors), [-1] * len(anchors)
    waiting: list[tuple[int, int]] = []
    for i, (q, s, n) in enumerate(anchors):
        while waiting and waiting[0][0] <= q:
            qe, j = heapq.heappop(waiting)
            se = anchors[j][1] + anchors[j][2]
            value, at = (score[j] + GAP * (qe + se), j), rank[se]
            while at < len(tree):
                if tree[at] < value:
                    tree[at] = value
                at += at & -at
        at, best = int(np.searchsorted(ends, s, "right")), (-1e18, -1)
        while at:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        gain = best[0] - GAP * (q + s)
        score[i], before[i] = n + max(0.0, gain), best[1] if gain > 0 else -1
        heapq.heappush(waiting, (q + n, i))
    used, out = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(anchors[i])
            i = before[i]
        if own:
            out.append(own[::-1])
    return out


def split_chain(own: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A chain cut where more than NEAR words are skipped on a side: these outweigh what one passage has left."""
    out = [[own[0]]]
    for a in own[1:]:
        q, s, n = out[-1][-1]
        if max(a[0] - (q + n), a[1] - (s + n)) > NEAR:
            out.append([])
        out[-1].append(a)
    return out


def _promising(doc: np.ndarray, src: np.ndarray, q: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of links sorted by pair and q: those of pairs with a long link, or with two links close to each other."""
    pair = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])]) - 1
    good = np.zeros(pair[-1] + 1, bool)
    good[pair[n > K]] = True
    for lag in (1, 2, 3):
        near = (pair[lag:] == pair[:-lag]) & (q[lag:] != q[:-lag]) & (q[lag:] - q[:-lag] <= NEAR) & (np.abs((q - s)[lag:] - (q - s)[:-lag]) <= DRIFT)
        good[pair[lag:][near]] = True
    return good[pair]


def _needed(doc: np.ndarray, src: np.ndarray, q: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of links sorted by pair and q, positions of those that add something: no seed inside a long run of its pair, and of
    long runs to one place of the source, as periodic texts have at every word, one in LONG words."""
    pair = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])]) - 1
    order = np.lexsort((-n, q, pair))
    p, a, k = pair[order], q[order], n[order]
    width = int((q + n).max()) + 1
    cover = np.maximum.accumulate(np.where(k > K, p * width + a + k, 0))
    seed = order[(k <= K) & (cover < p * width + a + k)]
    long = np.flatnonzero(n > K)
    long = long[np.lexsort((q[long], s[long], pair[long]))]
    tile = np.stack([pair[long], s[long], q[long] // LONG])
    return np.sort(np.r_[seed, long[np.r_[True, (tile[:, 1:] != tile[:, :-1]).any(axis=0)]] if len(long) else long])


def _chain_rows(matches: DataFrame) -> DataFrame:
    """(doc_id, source, anchors array<int>) of each chain of promising pairs: q, s, length of its anchors, flat."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("anchors", pa.list_(pa.int32()))])

    def rows(parts):
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if not len(cols[0]):
            return None
        keep = _needed(*cols)
        cols = [c[keep] for c in cols]
        keep = _promising(*cols)
        doc, src, q, s, n = (c[keep] for c in cols)
        if not len(doc):
            return None
        pair = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])]) - 1
        ids = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        at, q, s, n = anchors_of(q, s, n, pair)
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        out, flat = [], np.stack([q, s, n], axis=1).tolist()
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i = ids[at[a]]
            for own in chains([tuple(x) for x in flat[a:z]]):
                for part in split_chain(own):
                    if sum(n for *_, n in part) >= LEAST:
                        out.append((doc[i], src[i], list(chain.from_iterable(part))))
        return batch(schema, *zip(*out, strict=True)) if out else None

    def run(batches):
        held = []
        for b in gathered(batches):
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut or (held and held[-1][0][0] != cols[0][0]):
                if (got := rows([*held, [c[:cut] for c in cols]])) is not None:
                    yield got
                held = []
            held.append([c[cut:] for c in cols])
        if held and (got := rows(held)) is not None:
            yield got

    dealt = matches.repartition("doc_id").sortWithinPartitions("doc_id", "source", "pos", "source_pos")
    return dealt.select("doc_id", "source", F.col("pos").cast("long"), F.col("source_pos").cast("long"), F.col("n").cast("long")).mapInArrow(run, "doc_id long, source long, anchors array<int>")


def _slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (owner, chain, lo, hi), a written table -> (chain, lo, words binary): hashes of the owner's words lo to
    hi, 4 bytes of each (a passage has at least 40 equal ones in order)."""
    parts = wanted.groupBy("owner").agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("parts")).where("parts > 1")
    parts = materialise(parts.withColumnRenamed("owner", "many"), "parts")  # none but documents of many requests
    texts = docs.select(F.col("doc_id").cast("long").alias("owner"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chain"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "text")
    texts = texts.join(parts, F.col("owner") == F.col("many"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    asks = wanted.join(parts, F.col("owner") == F.col("many"), "left").select("owner", F.lit(1).alias("kind"), "chain", "lo", "hi", F.lit(None).cast("string").alias("text"), F.pmod("chain", F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    schema = pa.schema([("chain", pa.int64()), ("lo", pa.int32()), ("words", pa.binary())])

    def run(batches):
        owner, text, words = None, None, None
        for b in batches:
            kinds, owners = b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            chains, los, his = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            out = []
            for i in np.flatnonzero((kinds == 1) | np.r_[kinds[1:] == 1, True]):  # requests, and the texts before them
                if kinds[i] == 0:
                    owner, text, words = owners[i], b.column(5).slice(i, 1), None
                elif owners[i] == owner:
                    if words is None:
                        words = (word_hashes(text)[0] >> np.uint64(32)).astype(np.uint32)
                    out.append((chains[i], los[i], words[los[i] : his[i]].tobytes()))
            if out:
                yield batch(schema, *zip(*out, strict=True))

    columns = ["owner", "kind", "chain", "lo", "hi", "text", "part"]
    both = texts.select(*columns).unionByName(asks.select(*columns)).repartition("owner", "part").sortWithinPartitions("owner", "part", "kind", "chain").drop("part")
    return both.mapInArrow(run, "chain long, lo int, words binary")


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a longest common subsequence of a and b; of two of one length, those on their diagonal."""
    if len(a) == len(b):
        at = np.flatnonzero(a == b)
        return at, at
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    eq = a[:, None] == b[None]
    for i in range(len(a)):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + eq[i]))
    i, j, out = len(a), len(b), []
    while i and j:
        if eq[i - 1, j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    at = np.array(out[::-1], np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def matched(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of aligned equal words of a and b, ascending on both sides, along a chain of anchors."""
    q, s, _ = anchors[0]
    n = min(q, s)
    left = np.flatnonzero(a[q - n : q] == b[s - n : s]) - n
    out = [(left + q, left + s)]
    at_q, at_s = q, s
    for q, s, n in anchors:
        if q > at_q and s > at_s:
            x, y = _common(a[at_q:q], b[at_s:s])
            out.append((x + at_q, y + at_s))
        eq = np.flatnonzero(a[q : q + n] == b[s : s + n])
        out.append((eq + q, eq + s))
        at_q, at_s = q + n, s + n
    n = min(len(a) - at_q, len(b) - at_s)
    right = np.flatnonzero(a[at_q : at_q + n] == b[at_s : at_s + n])
    out.append((right + at_q, right + at_s))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _segments(q: np.ndarray, s: np.ndarray, skipped: float) -> list[tuple[int, int]]:
    """Maximal scoring segments (first and last match): a match counts 1, a skipped word -skipped; in linear time."""
    cut = np.flatnonzero(np.r_[True, (q[1:] - q[:-1] > 1) | (s[1:] - s[:-1] > 1)])
    stop = np.r_[cut[1:], len(q)]
    gap = np.r_[0.0, skipped * (np.maximum(q[cut[1:]] - q[stop[:-1] - 1], s[cut[1:]] - s[stop[:-1] - 1]) - 1)]
    kept: list[list] = []  # first, last, sum before, sum after, the nearest kept segment to the left with a smaller sum before
    total = 0.0
    for a, z, g in zip(cut.tolist(), stop.tolist(), gap.tolist(), strict=True):
        before, after = total - g, total - g + z - a
        total = after
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                kept.append([a, z - 1, before, after, j])
                break
            a, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, z) for a, z, *_ in kept]


def align(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(q start, q end, s start, s end, equal words) of the passages along a chain whose anchors are positions in a and b."""
    q, s = matched(a, b, anchors)
    out: list[tuple[int, int, int, int, int]] = []
    if len(q) < SIMILARITY * MIN_WORDS:
        return out
    for skipped in SKIPPED:
        for x, y in _segments(q, s, skipped):
            parts = [(x, y)]
            if y - x + 1 < SIMILARITY * max(q[y] - q[x] + 1, s[y] - s[x] + 1):  # too loose as a whole: its denser segments
                parts = [(x + u, x + v) for u, v in _segments(q[x : y + 1], s[x : y + 1], SIMILARITY / (1 - SIMILARITY))]
            for u, v in parts:
                words, equal = max(q[v] - q[u], s[v] - s[u]) + 1, v - u + 1
                met = any(q[u] < z and q[v] >= w for w, z, *_ in out)
                if q[v] - q[u] + 1 >= MIN_WORDS and equal >= SIMILARITY * words and not met:
                    out.append((int(q[u]), int(q[v]) + 1, int(s[u]), int(s[v]) + 1, equal))
    return out


def _of_first_source(batches):
    """Passages sorted by document and source, without those inside a passage that an earlier source, or the same, has."""
    doc, starts, held = None, [], []  # held: ends of the document's passages that no other one contains
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        for k, (d, lo, hi) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)):
            if d != doc:
                doc, starts, held = d, [], []
            i = bisect_right(starts, lo)
            if i and held[i - 1] >= hi:
                keep[k] = False
                continue
            i = bisect_left(starts, lo)
            j = i
            while j < len(held) and held[j] <= hi:
                j += 1
            starts[i:j], held[i:j] = [lo], [hi]
        yield b.filter(pa.array(keep))


def _sha(text):
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


def repeated_ids(docs: DataFrame) -> DataFrame:
    """(again, longest): of each doc_id of several rows the text that counts: the longest, of these the smallest."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again"))
    again = materialise(again, "again")
    rows = docs.select("doc_id", "text").join(again, F.col("doc_id") == F.col("again"))
    best = rows.groupBy("again").agg(F.min(F.struct(F.coalesce(-F.length("text"), F.lit(1)).alias("size"), "text")).alias("best"))
    return materialise(best.select("again", F.col("best.text").alias("longest")), "longest")


def one_row_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, text) with one row for each doc_id."""
    ids = repeated.select("again")
    once = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("again"), "left_anti")
    return once.unionByName(repeated.select(F.col("again").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("longest").alias("text")))


COLUMNS = "doc_id long, start_word long, end_word long, source_doc_id long, source_start_word long, source_end_word long, equal_words long, similarity double"


def passages(docs: DataFrame, within_documents: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_start_word, source_end_word, equal_words, similarity).

    One row for each passage of a document that repeats a passage of an earlier one (its source: the first document that
    has its seeds or long runs, or the last one before this document where the first has less of it). Copies of whole
    documents are passages too. within_documents: passages that repeat at least MIN_WORDS words further on in their own
    document also count (their source is the document itself). Rows with a null doc_id are left out; null texts are
    empty; of several rows of one doc_id the longest text counts (the smallest of these); texts without seeds have no
    passage; other columns are ignored."""
    before = written()
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    repeated = repeated_ids(docs)
    docs, kept = one_row_each(docs, repeated), written()
    found = _chain_rows(seed_matches(docs, within_documents)).distinct()
    found = finished(found.withColumn("chain", F.xxhash64("doc_id", "source", "anchors")), "chains", kept)
    last = lambda k: F.element_at("anchors", -k)
    low = lambda x: F.greatest(F.lit(0), x - PAD)
    q_side = found.select(F.col("doc_id").alias("owner"), F.lit(0).alias("side"), "chain", low(F.element_at("anchors", 1)).alias("lo"), (last(3) + last(1) + PAD).alias("hi"))
    s_side = found.select(F.col("source").alias("owner"), F.lit(1).alias("side"), "chain", low(F.element_at("anchors", 2)).alias("lo"), (last(2) + last(1) + PAD).alias("hi"))
    slices = materialise(_slices(docs, q_side.unionByName(s_side).select("owner", F.xxhash64("chain", "side").alias("chain"), "lo", "hi")), "slices")
    own = lambda k: slices.select(F.col("chain").alias(f"c{k}"), F.col("lo").alias(f"lo{k}"), F.col("words").alias(f"w{k}"))
    joined = found.withColumns({"c0": F.xxhash64("chain", F.lit(0)), "c1": F.xxhash64("chain", F.lit(1))}).join(own(0), "c0").join(own(1), "c1")
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start_word", "end_word", "source_doc_id", "source_start_word", "source_end_word", "equal_words")] + [("similarity", pa.float64())])

    def run(batches):
        for b in batches:
            out = []
            for doc, src, flat, lo0, w0, lo1, w1 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = [(q - lo0, x - lo1, n) for q, x, n in zip(flat[::3], flat[1::3], flat[2::3], strict=True)]
                for q0, q1, s0, s1, equal in align(np.frombuffer(w0, np.uint32), np.frombuffer(w1, np.uint32), own):
                    if doc != src or s1 + lo1 <= q0 + lo0:  # of one document: without overlap
                        out.append((doc, q0 + lo0, q1 + lo0, src, s0 + lo1, s1 + lo1, equal, equal / max(q1 - q0, s1 - s0)))
            if out:
                yield batch(schema, *zip(*out, strict=True))

    rows = joined.select("doc_id", "source", "anchors", "lo0", "w0", "lo1", "w1").mapInArrow(run, COLUMNS).distinct()
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "source_doc_id", "start_word", F.desc("end_word"), "source_start_word").mapInArrow(_of_first_source, COLUMNS)
    return finished(rows, "passages", before)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (and the white space before each)."""
    at = [m.span() for m in WORD.finditer(text)]
    gone = np.zeros(len(at) + 1, bool)
    for a, z in spans:
        gone[a:z] = True
    out, done, i = [], 0, 0
    while i < len(at):
        if gone[i]:
            j = i
            while gone[j]:
                j += 1
            out.append(text[done : at[i - 1][1] if i else 0])
            done = at[j - 1][1]
            i = j
        else:
            i += 1
    return "".join(out) + text[done:]


def remove_passages(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: all columns of docs; repeated passages are cut from the later documents' texts.

    Of several rows of one doc_id those whose text counts are cut, the others stay as they are. A document of which
    nothing but white space is left goes (texts that were empty before stay). A column n_chars
    follows the new text."""
    spans = passages(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("cuts")).withColumnRenamed("doc_id", "cut_id")
    other = repeated_ids(docs).select("again", _sha(F.col("longest")).alias("longest_sha"))
    spans = spans.join(other, F.col("cut_id") == F.col("again"), "left").select("cut_id", "longest_sha", "cuts")
    counts = F.col("longest_sha").isNull() | (F.col("longest_sha") == _sha(docs.text))
    joined = docs.join(spans, (docs.doc_id == spans.cut_id) & counts, "left").drop("cut_id", "longest_sha")
    names, fields = docs.columns, docs.schema
    at = names.index("text")

    def run(batches):
        for b in batches:
            texts = [cut_words(t, [(c["start_word"], c["end_word"]) for c in cuts]) if cuts and t else t for t, cuts in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            left = [bool(t and t.split()) or not cuts for t, cuts in zip(texts, b.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(left, pa.bool_()))

    cut = joined.mapInArrow(run, StructType(fields.fields))
    return cut.withColumn("n_chars", F.length("text").cast(fields["n_chars"].dataType)) if "n_chars" in names else cut


def op1_substrings(spark, sf_dir):
    return passages(read_table(spark, sf_dir, "documents"))
