"""Operator 10, approximate nearest neighbours by an adaptive dimension scan of probed lists.

Vectors are divided by the largest norm M. Largest inner products become smallest Euclidean distances by one more
coordinate, sqrt(1 - |x|^2), and a fixed random rotation spreads each distance evenly over the dimensions. Vectors are
dealt to the lists of k-means centroids, about sqrt(n) of them, which are fitted on a bounded sample of SAMPLE vectors;
every vector is indexed.

A query probes its nearest lists. How many is measured on the sample by one rule for all sizes: so many that TARGET of the
sample's own nearest neighbours lie in them, and at least so many that they hold k vectors. Its nearest list comes first
and gives the distance of its k-th neighbour so far; in each other list column blocks of the rotated vectors are added
up, and after each block a candidate is given up if its partial distance, scaled to all dimensions, exceeds that distance
by more than sampling error allows. Survivors get their exact inner product in double precision. Lists are split into
blocks of vectors and of queries, so no task holds an unbounded group.

A query scans a share of the table that falls with the structure of the vectors: of vectors in clusters a few lists, so
about sqrt(n) vectors; of isotropic ones, whose neighbours lie in any direction, most of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibspark.llm.common import finished, materialise, read_table, written

SAMPLE = 32_768
LISTS = 2_048  # at most: sixteen sampled vectors each
TRIED = 512  # sampled queries that the number of probes is measured with
TARGET = 0.97
COLUMNS = 16
EPSILON = 2.1
VECTORS, QUERIES = 4_096, 2_048  # per task group
PAIRS = 65_536  # of queries and vectors, or of vectors and lists, that are held at once
SLACK = 1e-5


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<double>): vectors that are null, empty, zero or hold a null or non-finite component take no part;
    nor do those of another length than the most frequent one, or a null vec_id."""
    x = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    )
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == (sizes.n if sizes else 0))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def augmented(x: np.ndarray, largest: float, query: bool = False) -> np.ndarray:
    """Vectors over the largest norm, with one more coordinate, rotated. A query has zero there:
    |q - x|^2 = |q|^2 + 1 - 2 qx."""
    x = x / largest
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - (x**2).sum(1), 0))
    return (np.c_[x, more] @ rotation(x.shape[1] + 1)).astype(np.float32)


def centroids(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_list(x, c)
        n = np.bincount(near, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def slices(n: int, wide: int) -> list[slice]:
    """n rows in slices of at most PAIRS cells, at `wide` cells a row (a row at least)."""
    step = max(1, PAIRS // max(1, wide))
    return [slice(i, i + step) for i in range(0, n, step)]


def nearest_list(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """order_of_lists()[:, 0]."""
    half = 0.5 * (centre * centre).sum(1)
    return np.concatenate([(x[s] @ centre.T - half).argmax(1) for s in slices(len(x), len(centre))])


def order_of_lists(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argsort(-(x @ centre.T - 0.5 * (centre * centre).sum(1)), axis=1, kind="stable")


def probes_for(sample: np.ndarray, asked: np.ndarray, centre: np.ndarray, k: int, target: float) -> int:
    """The least number of nearest lists that hold `target` of the sample's k nearest vectors of each asked one.

    sample and asked: augmented vectors, as candidates and as queries; the row of asked i is not its own neighbour."""
    list_of = nearest_list(sample, centre)
    ranks = []
    step = max(1, len(sample) // TRIED)
    for i in range(0, len(sample), step * 64):
        at = np.arange(i, min(i + step * 64, len(sample)), step)
        near = -(asked[at] @ sample.T) + 0.5 * (sample * sample).sum(1)
        near[np.arange(len(at)), at] = np.inf
        few = min(k, len(sample) - 1)
        if few:
            best = np.argpartition(near, few - 1, axis=1)[:, :few]
            place = np.argsort(order_of_lists(asked[at], centre), axis=1)
            ranks.append(np.take_along_axis(place, list_of[best], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), target, method="higher")) + 1 if ranks else len(centre)


def scan_block(q: np.ndarray, limit: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs that no column block gave up. limit: squared distance that each query has to beat."""
    dims = q.shape[1]
    qi, xi, part = None, None, None
    for start in range(0, dims, COLUMNS):
        seen = min(start + COLUMNS, dims)
        a, b = q[:, start:seen], x[:, start:seen]
        if part is None:
            part = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
            keep = part * (dims / seen) <= (limit * (1 + EPSILON / np.sqrt(seen)) ** 2)[:, None]
            qi, xi = np.nonzero(keep)
            part = part[qi, xi]
        else:
            part = part + ((a[qi] - b[xi]) ** 2).sum(1)
            error = (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < dims else 1 + SLACK
            keep = part * (dims / seen) <= limit[qi] * error + SLACK
            qi, xi, part = qi[keep], xi[keep], part[keep]
    return qi, xi


def _indexer(centre: np.ndarray, largest: float):
    """(vec_id, x) -> with the list of each."""

    def run(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"vec_id": f.vec_id, "list": nearest_list(augmented(np.stack(f.x.to_list()).astype(float), largest), centre), "x": f.x})

    return run


def _asker(centre: np.ndarray, held: np.ndarray, probes: int, least: int, largest: float):
    """(query, vec_id, x) -> a row for each list that a query probes: the first `probes`, and more until they hold `least` vectors. A frame's
    rows times its lists are many, each with the vector, so they are yielded in pieces."""

    def run(frames):
        for f in frames:
            for s in slices(len(f), len(centre)):
                g = f.iloc[s]
                near = order_of_lists(augmented(np.stack(g.x.to_list()).astype(float), largest, True), centre)
                covered = np.cumsum(held[near], axis=1) - held[near]
                rank = np.arange(near.shape[1])[None]
                i, j = np.nonzero((rank < probes) | (covered < least))
                yield pd.DataFrame({"query": g["query"].to_numpy()[i], "query_id": g.vec_id.to_numpy()[i], "list": near[i, j], "probe": j, "x": g.x.to_numpy()[i]})

    return run


OUT = "query long, query_id long, vec_id long, score double"


def _searcher(k: int, largest: float):
    """Scans one group: the queries and the vectors of a block of a list; at most k of its vectors for each query."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        qx, vx = np.stack(queries.x.to_list()).astype(float), np.stack(vectors.x.to_list()).astype(float)
        keys, qids, vids = queries["query"].to_numpy(), queries.query_id.to_numpy(), vectors.vec_id.to_numpy()
        q, x, limit = augmented(qx, largest, True), augmented(vx, largest), queries["limit"].to_numpy(float)
        found = []
        for part in slices(len(q), len(x)):
            a, b = scan_block(q[part], limit[part], x)
            a = a + part.start
            other = qids[a] != vids[b]
            a, b = a[other], b[other]
            score = np.einsum("ij,ij->i", qx[a], vx[b])
            order = np.lexsort((vids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
            rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
            found.append(pd.DataFrame({"query": keys[a], "query_id": qids[a], "vec_id": vids[b], "score": score})[rank < k])
        return pd.concat(found)

    return run


def _search(queries: DataFrame, vectors: DataFrame, k: int, largest: float) -> DataFrame:
    """queries (query, query_id, list, limit, x) against vectors (vec_id, list, x) of the same list, in bounded groups."""
    n_v = vectors.groupBy("list").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("v_parts"))
    n_q = queries.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_parts"))
    parts = materialise(n_v.join(n_q, "list"), "parts")  # one row per list
    v = vectors.join(F.broadcast(parts), "list").withColumn("v_part", F.pmod(F.xxhash64("vec_id", "x"), F.col("v_parts"))).withColumn("q_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts").cast("long") - 1)))
    q = queries.join(F.broadcast(parts), "list").withColumn("q_part", F.pmod("query", F.col("q_parts"))).withColumn("v_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_parts").cast("long") - 1)))
    key = ["list", "v_part", "q_part"]
    return q.select(*key, "query", "query_id", "limit", "x").groupBy(*key).cogroup(v.select(*key, "vec_id", "x").groupBy(*key)).applyInPandas(_searcher(k, largest), OUT)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries (vec_id, x) its k nearest of vectors (vec_id, x) found.

    Rows with the query's own vec_id are no candidates. Ties go to the smaller vec_id; repeated rows of another vec_id
    are candidates each. Repeated equal rows of a query are one query; rows of one vec_id with different vectors are
    queries of their own. Vectors may be of any finite size. No vectors or no queries: no rows. Fewer than k candidates:
    all of them."""
    before = written()
    vectors = materialise(vectors, "vectors")
    size = F.array_max(F.transform("x", F.abs))
    norm = F.col("m") * F.sqrt(F.aggregate(F.transform("x", lambda v: v / F.col("m")), F.lit(0.0), lambda s, v: s + v * v))
    top = vectors.withColumn("m", size).agg(F.max(norm), F.count("*")).first()
    if not top[1]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = float(min(top[0], np.finfo(float).max))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("x").toPandas()
    raw = np.stack(rows.x.to_list()).astype(float)
    sample = augmented(raw, largest)
    centre = centroids(sample, max(1, min(round(top[1] ** 0.5), LISTS, len(sample))))
    probes = probes_for(sample, augmented(raw, largest, True), centre, k, target)

    indexed = materialise(vectors.mapInPandas(_indexer(centre, largest), "vec_id long, list int, x array<double>"), "lists")
    held = np.zeros(len(centre), np.int64)
    for r in indexed.groupBy("list").count().collect():  # at most LISTS rows
        held[r["list"]] = r["count"]
    own = indexed.groupBy("vec_id").count().agg(F.max("count")).first()[0]  # rows of one vec_id, which may be the query's

    keyed = queries.select("vec_id", "x").distinct().select(F.xxhash64("vec_id", "x").alias("query"), "vec_id", "x")
    asked = materialise(keyed.mapInPandas(_asker(centre, held, probes, k + own, largest), "query long, query_id long, list int, probe int, x array<double>"), "probes")
    first = materialise(_search(asked.where("probe = 0").withColumn("limit", F.lit(1e300)), indexed, k, largest), "own")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query", F.col("score").alias("kth"))
    # over M: |q - x|^2 = |q|^2 + 1 - 2 qx
    length = F.aggregate(F.transform("x", lambda v: v / largest), F.lit(0.0), lambda s, v: s + v * v)
    rest = asked.where("probe > 0").join(kth, "query", "left").withColumn("limit", F.coalesce(length + 1 - 2 * (F.col("kth") / largest / largest), F.lit(1e300)))
    found = first.unionByName(_search(rest, indexed, k, largest))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return finished(ranked, "nearest", before)


def op10_ann(spark, sf_dir):
    vectors = valid_vectors(read_table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
