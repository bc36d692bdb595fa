"""Operator 10 against brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from bibspark.llm import ann


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in x], "vec_id long, embedding array<double>").selectExpr("*", "1 as list", "2 as x", "3 as score")


def test_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:720] = x[700]  # ties
    bad = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] + [1.0] * 23), (2004, [float("inf")] * 24), (2005, [1.0]), (None, [1.0] * 24)]
    vectors = ann.valid_vectors(frame(spark, [*((i, v.tolist()) for i, v in enumerate(x)), *bad]))
    assert vectors.count() == 1500
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert len(by) == 75
    hit = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in {r.vec_id for r in rows}
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        s = x @ x[q]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rows)
        s[q] = -np.inf
        hit += len({r.vec_id for r in rows} & set(np.lexsort((np.arange(1500), -s))[:20]))
    assert hit / (75 * 20) >= 0.9


def test_few_vectors(spark):
    v = ann.valid_vectors(frame(spark, [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0]), (3, [0.0, 1.0])]))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(v, v.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20), (0, 2, 3), (0, 3, 3), (20, 1, 0), (20, 2, 3), (20, 3, 3)]
    empty = ann.valid_vectors(frame(spark, []))
    assert ann.nearest(empty, empty).count() == 0


def recall(spark, x, k=20):
    v = ann.valid_vectors(frame(spark, [(i, r.tolist()) for i, r in enumerate(x)]))
    found = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), k).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(len(x)), -s))[: min(k, len(x) - 1)].tolist())
        hit, total = hit + len(want & found[q]), total + len(want)
        assert len(found[q]) == len(want)
    return hit / total


@pytest.mark.parametrize("n", [15, 60, 900, 3000])
def test_recall_by_size(spark, n):
    """One rule at all sizes, for vectors without structure and for clusters."""
    rng = np.random.default_rng(n)
    assert recall(spark, rng.standard_normal((n, 16))) >= 0.9
    assert recall(spark, rng.standard_normal((20, 16))[rng.integers(0, 20, n)] + 0.2 * rng.standard_normal((n, 16))) >= 0.9


def test_clusters_need_few_lists():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((64, 16))[rng.integers(0, 64, 4000)] + 0.05 * rng.standard_normal((4000, 16))
    largest = np.sqrt((x * x).sum(1)).max()
    sample, asked = ann.augmented(x, largest), ann.augmented(x, largest, True)
    centre = ann.centroids(sample, 63)
    few = ann.probes_for(sample, asked, centre, 20, 0.95)
    y = rng.standard_normal((4000, 16))
    largest = np.sqrt((y * y).sum(1)).max()
    sample, asked = ann.augmented(y, largest), ann.augmented(y, largest, True)
    assert 2 * few < ann.probes_for(sample, asked, ann.centroids(sample, 63), 20, 0.95)


def test_repeated_queries_and_large_components(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 4)) * 1e150
    rows = [*((i, v.tolist()) for i, v in enumerate(x)), (20, x[20].tolist()), (40, x[1].tolist())]
    v = ann.valid_vectors(frame(spark, rows))
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), 10).collect()
    ids = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in (0, 20, 40)}
    s = x @ x[20]
    want = [(i, s[i]) for i in range(50) if i != 20] + [(40, x[1] @ x[20])]
    assert ids[20] == [i for i, _ in sorted(want, key=lambda t: (-t[1], t[0]))[:10]] and len(ids[0]) == 10
    assert len(ids[40]) == 20  # two different vectors of one id: two queries


def test_full_groups_take_bounded_memory():
    """A full group without a limit, as of each query's own list, is not held as all its pairs at once."""
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((ann.VECTORS, 32)), rng.standard_normal((300, 32))
    of = lambda ids, rows, **more: pd.DataFrame({"vec_id": ids, "x": list(rows), **more})
    queries, vectors = of(range(9000, 9300), q, query=range(300), limit=1e300).assign(query_id=range(9000, 9300)), of(range(len(x)), x)
    tracemalloc.start()
    got = ann._searcher(20, 20.0)(queries, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert got.groupby("query").vec_id.apply(list).to_dict() == {i: best[i].tolist() for i in range(300)}


def test_probes_come_in_pieces():
    """The rows of a frame's queries times their lists are not one frame, and are the same."""
    rng = np.random.default_rng(5)
    centre, held = rng.standard_normal((800, 33)).astype(np.float32), np.full(800, 3)
    x = rng.standard_normal((500, 32))
    frame = pd.DataFrame({"query": range(500), "vec_id": range(500), "x": list(x)})
    found = list(ann._asker(centre, held, 400, 20, 10.0)([frame, frame.iloc[:0]]))
    assert max(map(len, found)) <= ann.PAIRS and sum(map(len, found)) == 500 * 400
    near = ann.order_of_lists(ann.augmented(x, 10.0, True), centre)
    rows = pd.concat(found)
    assert (rows["list"].to_numpy().reshape(500, 400) == near[:, :400]).all() and (rows.probe.to_numpy().reshape(500, 400) == np.arange(400)).all()
    assert (ann.nearest_list(ann.augmented(x, 10.0, True), centre) == near[:, 0]).all()
