"""Periodic runs against a search by every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from bibspark.llm import registry
from bibspark.llm.periodic import SuffixTree, by_start, periodic_runs, runs, stretches


def slow_runs(x):
    """By period: maximal stretches of equal words q apart, without those that have a smaller period."""
    found, n = {}, len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(6, 4 * q) and not any(q % p == 0 and s <= start and end <= e for (s, e), p in found.items()):
                found.setdefault((start, end), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_row(doc, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(slow_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(found), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def made(rnd, size, kinds):
    """Random words with repeated blocks, some of them broken or nested."""
    out = []
    while len(out) < size:
        if rnd.random() < 0.4:
            block = [rnd.randrange(kinds) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 7)
            out += block[: len(block) - rnd.randrange(len(block))] * rnd.choice([1, 1, 2, 5])
        else:
            out += [rnd.randrange(kinds) for _ in range(rnd.randint(1, 12))]
    return out[:size]


@pytest.mark.parametrize("kinds", [1, 2, 3, 30])
def test_runs(kinds):
    rnd = random.Random(kinds)
    for size in [*range(0, 40), *[rnd.randint(40, 220) for _ in range(120)]]:
        x = made(rnd, size, kinds) if size else []
        assert [tuple(r) for r in by_start(runs(np.array(x, np.int64))).tolist()] == sorted(slow_runs(x), key=lambda r: (r[0], r[2]))


def test_extensions():
    rnd = random.Random(3)
    x = [1 + v for v in made(rnd, 150, 3)]
    tree = SuffixTree(x)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(151), np.arange(151)))
    i, j = i[i != j], j[i != j]

    def slow(a, b):
        n = 0
        while a + n < 150 and b + n < 150 and x[a + n] == x[b + n]:
            n += 1
        return n

    assert tree.extension(i, j).tolist() == [slow(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(range(151), key=tree.rank.__getitem__) == sorted(range(151), key=lambda k: [*x[k:], 0])
    assert sorted(range(151), key=tree.opposite.__getitem__) == sorted(range(151), key=lambda k: [*(-v for v in x[k:]), -9])


def test_long_texts():
    """Half a million equal words are one run; as many words without a run are no stretch."""
    got = runs(np.zeros(200_000, np.int64))
    assert got.tolist() == [[0, 200_000, 1]]
    assert stretches(np.random.default_rng(1).integers(0, 5000, 500_000)) == []


def test_rows(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{v}" for v in made(rnd, rnd.randint(0, 150), 4))) for i in range(200)]
    rows += [(None, "a b " * 9), (5, None), (6, ""), (7, " \t\n"), (8, "A a A a A a A a"), (9, "x y x y x y x y x y x y x y"), (10, "\r".join("ab" * 20)), (10, "\r".join("ab" * 20))]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, start int, words string")
    from bibspark.llm.periodic import made_periodic

    got = periodic_runs(df, made_periodic)
    assert sorted(map(str, (tuple(r)[:8] for r in got.collect()))) == sorted(str(slow_row(*r)) for r in rows)
    assert all(r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() for r in got.collect())
    assert periodic_runs(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["op12_runs"](spark, sf)
    want = [slow_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 12_000]
    ids = {w[0] for w in want}
    assert sorted(map(str, (tuple(r) for r in got.collect() if r.doc_id in ids))) == sorted(map(str, want)) and len(want) > 150
