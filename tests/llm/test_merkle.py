"""Merkle manifests against a plain tree in Python."""

import hashlib
import random
import threading
import zlib

import pytest

from bibspark.llm import registry
from bibspark.llm.common import shared_dir
from bibspark.llm.merkle import manifest, verified

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root, and of each leaf its steps (sibling on the left, sibling on the right)."""
    level, at, steps = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(at):
            steps[i].append((level[p - 1] if p % 2 else "", level[p + 1] if p % 2 == 0 and p + 1 < len(level) else ""))
        level, at = [h(*level[i : i + 2]) for i in range(0, len(level), 2)], [p // 2 for p in at]
    return level[0], steps


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, outer = tree([inner[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for (_, _, own, r), steps in zip(sorted(groups[g], key=lambda x: x[:3]), inner[g][1], strict=True):
            path = steps + outer[k]
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1, r[4])) if tampered else own
            for left, right in path:
                now = h(left, now, right)
            out.append((r[0], own, inner[g][0], root, h(*(a + b for a, b in path)), now, now == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = verified(manifest(df))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"en": 700, "de": 17, "ä": 33, "z": 1, None: 5, "": 16}])
def test_against_plain_tree(spark, sizes):
    rnd = random.Random(5)
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((rnd.choice([i, i, i, -i, None]), rnd.choice(["s", None, "ü"]), lang, rnd.choice([0, 7, None, 2**63 - 1]), rnd.choice(["", None, "a:b-", "wörter und mehr " * 20])))
    rows += rows[:9] * 2  # repeated rows are leaves of their own
    check(spark, rows)


def test_empty(spark):
    assert verified(manifest(spark.createDataFrame([], SCHEMA))).collect() == []


def test_several_operators_at_once(spark):
    """Operators in threads of one driver give their own results, and leave nothing but these in the shared folder."""
    sf = "/root/testdata/sf0.001"
    names, got = ["op4_chat", "op5_simhash", "op9_decontaminate", "op11_merkle"], {}
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    list_all = lambda: {f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)))}
    want = {n: sorted(map(str, registry.QUERIES[n](spark, sf).collect())) for n in names}
    before = list_all()

    def run(name):
        got[name] = sorted(map(str, registry.QUERIES[name](spark, sf).collect()))

    threads = [threading.Thread(target=run, args=(n,)) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == want
    assert len(list_all() - before) == len(names)
