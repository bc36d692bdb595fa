"""Operators 5, 1 and 9 against brute force, and on awkward tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from bibspark.llm import decontaminate, simhash, substrings
from bibspark.llm.common import word_hashes
from bibspark.llm.graph import components

DOCS = "doc_id long, text string"
EXTRA = [f"{i} as {c}" for i, c in enumerate(("fp", "id", "key", "hash", "label", "chain", "owner", "item", "w", "n", "gone"))]


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Distinct texts, exact copies, copies with few changes, nulls, empties, repeated rows and one very long text."""
    rows, r = [], random.Random(5)
    for i in range(60):
        rows.append((i, " ".join(words(r.choice([3, 40, 300]), i))))
    for i in range(60, 90):
        w = rows[i - 60][1].split()
        for _ in range(i % 3):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "ONE"), (None, "one"), (None, None), (7, rows[7][1]), (105, " ".join(words(30_000, 99)))]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *EXTRA)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs) > 0)


def test_simhash_brute_force(docs):
    got = simhash.simhash_components(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(r.text) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    low = {c: min((rows[i].doc_id for i in range(len(rows)) if label[i] == c and rows[i].doc_id is not None), default=None) for c in set(label)}
    want = sorted((str(r.doc_id), fps[i], str(low[label[i]])) for i, r in enumerate(rows))
    assert sorted((str(g.doc_id), g.fp & (1 << 64) - 1, str(g.component_id)) for g in got) == want


def test_exact_cells_are_complete():
    """Fingerprints that differ in at most three bits share a cell."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    keys = simhash.exact_cells(3)
    assert (keys(x[:, None]) == keys(y[:, None])).any(axis=1).all()


def test_large_cells_are_split(spark, monkeypatch):
    """Cells beyond the limit go through salted sub-cells and lose no link."""
    monkeypatch.setattr(simhash, "CELL", 20)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)})
    rows = spark.createDataFrame([(i, [f - (1 << 64) if f >> 63 else f]) for i, f in enumerate(fps)], "id long, fp array<long>")
    links = simhash.near_links(simhash.pivot_table(rows, 1, simhash.exact_cells(3)), 3, 1)
    roots = {r.root for r in components(links).collect()}
    assert roots == {0}


def test_near_duplicates_stage(docs):
    kept = {r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()}
    assert kept >= set(range(60)) | {100, 103, 105, None} and not kept & {60, 63, 66, 101, 102, 104}  # exact copies go
    assert simhash.keep_one_of_each_group(docs).columns == docs.columns


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a, b))
    return len(x & y) / len(x | y)


def near_copies(n, seed, size=120):
    """A text and copies of it with random changed words, by similarity."""
    r = random.Random(seed)
    base = words(size, seed)
    out = [base]
    for _ in range(n - 1):
        w = list(base)
        for i in r.sample(range(size), r.randint(0, 7)):
            w[i] = f"n{r.randrange(10**6)}"
        out.append(w)
    return out


def roots_of(texts, similarity=0.8):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= similarity:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return root


def test_near_duplicate_groups_brute_force(spark):
    """Groups of exact similarity 0.8, single linkage: none is merged too much, and 0.95 of the copies are found."""
    texts = [w for k in range(40) for w in near_copies(6, 500 + k, 60 + 10 * (k % 8))]
    want = [6 * (i // 6) + r for i in range(len(texts)) for r in [roots_of(texts[6 * (i // 6) : 6 * (i // 6) + 6])[i % 6]]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], DOCS)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert all(want[got[i]] == want[i] for i in range(len(texts)))
    copies = [i for i in range(len(texts)) if want[i] != i]
    found = sum(got[i] == want[i] for i in copies) / len(copies)
    print(found, len(copies))
    assert found >= 0.95


def test_large_near_copy_cells(spark, monkeypatch):
    """Cells beyond the limit go through finer cells, trees of parts and salted pairs; one great group stays one."""
    monkeypatch.setattr(simhash, "CELL", 12)
    base = words(200, 9)
    texts = []
    for i in range(150):
        w = list(base)
        w[i % 200], w[(7 * i) % 200] = f"x{i}", f"y{i}"
        texts.append(" ".join(w))
    line = " ".join(words(25, 10))
    texts += [line + " " + " ".join(words(12, 600 + i)) for i in range(60)]  # a common line, similarity below 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert all(got[i] == 0 for i in range(150)) and all(got[i] == i for i in range(150, 210))


def test_repeated_ids_in_near_copies(spark):
    w = words(40, 11)
    rows = [(1, " ".join(w)), (1, "other words here"), (2, " ".join(w[:-1])), (3, "other words here"), (4, " ".join(w)), (None, " ".join(w))]
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}


def test_pivots_discard_and_keep():
    """No pair within the radius is discarded; of unrelated pairs the table discards nearly all."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)[:, None]
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, (2000, 1)).astype(np.uint64)
    a, b = simhash.coordinates(x), simhash.coordinates(y)
    assert (np.abs(a - b) <= 3).all() and a.shape[1] >= 32
    assert (np.abs(a - np.roll(a, 1, axis=0)).max(axis=1) > 3).mean() > 0.99


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(none).count() == 0
    assert simhash.keep_one_of_each_group(none).count() == 0
    assert substrings.passages(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 5), (7, 9), (9, 8), (None, 4)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components(path).collect()} == {0}


@pytest.fixture(scope="module")
def shared(spark):
    passage, other = words(80, 1000), words(70, 1001)
    fuzzy = list(passage)
    for i in range(9, 80, 16):
        fuzzy[i] = "zz"
    rows = [
        (1, " ".join(words(100, 1) + passage + words(50, 2))),
        (2, " ".join(words(30, 3) + passage + words(200, 4))),
        (3, " ".join(fuzzy + words(60, 5))),
        (4, " ".join(words(400, 6))),
        (5, " ".join(words(20, 7) + other)),
        (6, " ".join(other + words(20, 8) + passage[:30])),
        (7, " ".join(words(10, 9) + passage[:25] + words(30, 10))),
        (8, None),
        (None, " ".join(passage)),
        (2, " ".join(words(30, 3) + passage + words(200, 4))),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *EXTRA)


def test_passages(shared):
    got = {(r.doc_id, r.source_doc_id): r for r in substrings.passages(shared).collect()}
    assert set(got) == {(2, 1), (3, 1), (6, 5)}
    r = got[2, 1]
    assert (r.start_word, r.end_word, r.source_start_word, r.source_end_word, r.equal_words, r.similarity) == (30, 110, 100, 180, 80, 1.0)
    assert got[3, 1].end_word >= 78 and got[3, 1].similarity >= 0.9


def test_passages_are_cut(shared):
    left = {r.doc_id: r.text for r in substrings.remove_passages(shared).collect()}
    assert left[2].split() == words(30, 3) + words(200, 4)
    assert left[6].split() == words(20, 8) + words(80, 1000)[:30]
    assert left[4].split() == words(400, 6) and left[8] is None
    assert substrings.cut_words("a b  c\nd", [(1, 3)]) == "a\nd"


def test_fenwick_chain_is_best():
    """The chain's score is that of a quadratic scan."""
    r = random.Random(3)
    for _ in range(30):
        anchors = sorted({(r.randrange(60), r.randrange(60), r.randint(1, 6)) for _ in range(12)})
        best = []
        for q, s, n in anchors:
            prior = [b - substrings.GAP * ((q - (x + m)) + (s - (y + m))) for (x, y, m), b in zip(anchors, best, strict=False) if x + m <= q and y + m <= s]
            best.append(n + max([0, *prior]))
        found = max(substrings.chains(anchors), key=lambda c: sum(a[2] for a in c) - sum(substrings.GAP * ((b[0] - a[0] - a[2]) + (b[1] - a[1] - a[2])) for a, b in zip(c, c[1:], strict=False)))
        score = sum(a[2] for a in found) - sum(substrings.GAP * ((b[0] - a[0] - a[2]) + (b[1] - a[1] - a[2])) for a, b in zip(found, found[1:], strict=False))
        assert abs(score - max(best)) < 1e-9


def test_seeds_depend_on_their_own_words():
    """A seed is kept or not whatever stands around it, and none reaches into the next text."""
    w = words(200, 1)
    a, na = word_hashes(pa.array([" ".join(words(50, 2) + w + words(50, 3)), " ".join(w[:3]), "", None]))
    b, nb = word_hashes(pa.array([" ".join(w)]))
    (at_a, in_a), (at_b, in_b) = substrings.seeds_of(a, na), substrings.seeds_of(b, nb)
    inside = (at_a >= 50) & (at_a + substrings.K <= 250)
    assert in_a[inside].tolist() == in_b.tolist() and (at_a[inside] - 50).tolist() == at_b.tolist()
    assert at_a.max(initial=0) + substrings.K <= na[0]


def test_contamination(spark):
    item = words(30, 50)
    docs = [(1, " ".join(words(5000, 51) + item + words(100, 52))), (2, " ".join(item[:15])), (3, " ".join(words(300, 53))), (4, " ".join(item).upper()), (5, None), (None, " ".join(item)), (6, "a b"), (7, " ".join(item[:29])), (1, " ".join(words(5, 54))), (8, "x y A B c"), (9, "b a"), (4, " ".join(item).upper())]
    items = [(10, " ".join(item)), (11, None), (12, "A  b"), (None, "a b"), (13, "")]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", *EXTRA)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *EXTRA)
    got = {(r.doc_id, r.item_id): round(r.containment, 3) for r in decontaminate.contaminated(d, i).collect()}
    assert got == {(1, 10): 1.0, (4, 10): 1.0, (7, 10): round(25 / 26, 3), (6, 12): 1.0, (8, 12): 1.0}
    assert {r.doc_id for r in decontaminate.clean_documents(d, i).collect()} == {2, 3, 5, 9, None}


def test_contamination_brute_force(spark):
    """Items of 1 to 120 words, changed words, in documents of all sizes: the exact pairs of containment 0.8."""
    r = random.Random(17)
    items = [words(r.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 80, 120]), 800 + k) for k in range(60)]
    docs = []
    for k, item in enumerate(items):
        w = list(item)
        for i in r.sample(range(len(w)), min(len(w) - 1, r.choice([0, 0, 1, 2, 3]))):
            w[i] = "changed"
        docs.append((words(r.choice([0, 10, 300]), 900 + k) + w[: r.choice([len(w), len(w), max(1, 9 * len(w) // 10)])] + words(r.choice([0, 200]), 1900 + k)))
    parts = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = {}
    for a, d in enumerate(docs):
        for b, item in enumerate(items):
            own = parts(item, min(5, len(item)))
            share = len(own & parts(d, min(5, len(item)))) / len(own)
            if share >= 0.8:
                want[a, b] = round(share, 6)
    as_rows = lambda x, c: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(x)], f"{c} long, text string")
    got = {(g.doc_id, g.item_id): round(g.containment, 6) for g in decontaminate.contaminated(as_rows(docs, "doc_id"), as_rows(items, "item_id")).collect()}
    assert got == want and len(want) > 20


def test_parts_in_other_earlier_documents(spark):
    """A passage is found where its parts first occur, or last occur before, in other documents: against brute force."""
    rows, want, r = [], set(), random.Random(8)
    for case in range(12):
        p, at = words(60, 2000 + case), 10 * case
        pad = lambda w, k: " ".join(words(r.randint(5, 40), 7000 + 10 * at + 2 * k) + w + words(9, 7001 + 10 * at + 2 * k))  # noqa: B023, E731
        parts = [[p[:40], p[20:]], [p[:33], p[30:]], [p[:36], p[36:]], [p[:30], p[30:]]][case % 4]
        texts = [[*parts, p, p], [parts[0], p, parts[1], p], [p, *parts, p]][case // 4]
        rows += [(at + k, pad(w, k)) for k, w in enumerate(texts)]
        want.add((at + 3, at + max(k for k in range(3) if texts[k] is p)))
    flat = {i: t.split() for i, t in rows}
    runs = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in flat.items()}
    assert want == {(a, b) for a in runs for b in runs if b < a and runs[a] & runs[b]}
    got = {(g.doc_id, g.source_doc_id) for g in substrings.passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert want <= got


def test_links_over_range_seams(spark):
    """A seed of many partitions is linked to the one before from everywhere, and through range heads to its first document."""
    w = " ".join(words(60, 3))
    docs = spark.createDataFrame([(i, w) for i in range(400)], DOCS)
    got = {(m.doc_id, m.source) for m in substrings.seed_matches(docs).collect()}
    assert got >= {(i, i - 1) for i in range(1, 400)} and all(b < a for a, b in got)
    heads = {b for a, b in got if b != a - 1} | {0}
    assert len(heads) <= 40 and all((b, 0) in got for b in heads if b) and all(any((i, b) in got for b in heads) for i in range(2, 400))


def fuzzy_recall(spark, each=20):
    """{(words, change): share found} of planted fuzzy passages whose own similarity, by brute force, is 0.8 or more,
    and {similarity, to the lower 0.05: share of the passages' words found}."""
    rows, cases, r = [], [], random.Random(12)
    for size in (60, 80, 200):
        for change in ("every 5th", "every 6th", "every 8th", "every 10th", 0.05, 0.1, 0.15, 0.2):
            for _ in range(each):
                p, at = words(size, 30_000 + 3 * len(rows)), len(rows)
                q = list(p)
                for i in range(size):
                    if (r.random() < change) if isinstance(change, float) else i % int(change.split()[1][:-2]) == 2:
                        q[i] = f"zz{i}"
                rows += [(at, " ".join(words(30, 50_000 + at) + p + words(20, 60_000 + at))), (at + 1, " ".join(words(15, 70_000 + at) + q + words(40, 80_000 + at)))]
                if (same := sum(a == b for a, b in zip(p, q, strict=True))) >= 0.8 * size:
                    cases.append((size, change, at, 5 * int(20 * same / size)))
    got: dict = {}
    for g in substrings.passages(spark.createDataFrame(rows, DOCS)).collect():
        assert g.doc_id == g.source_doc_id + 1
        got.setdefault(g.source_doc_id, set()).update(range(g.start_word, g.end_word))
    kinds, bands = {}, {}
    for size, change, at, band in cases:
        kinds.setdefault((size, change), []).append(at in got)
        bands.setdefault(band, []).append(len(got.get(at, set()) & set(range(15, 15 + size))) / size)
    return {k: sum(v) / len(v) for k, v in kinds.items()}, {k: (round(sum(v) / len(v), 3), len(v)) for k, v in sorted(bands.items())}


def test_fuzzy_passages(spark):
    kinds, bands = fuzzy_recall(spark)
    print(kinds, bands)
    assert min(v for (_, change), v in kinds.items() if change != "every 5th") >= 0.9
    assert min(v for v, _ in bands.values()) >= 0.8


def test_split_boilerplate(spark):
    """Every pair of documents that share 56 equal words is linked, at least through a document that has them too,
    though parts of each passage stand in other earlier documents; nothing else is found. Against brute force."""
    r = random.Random(31)
    pool = [words(180, 40_000 + k) for k in range(12)]
    rows = []
    for i in range(200):
        own = words(r.randint(5, 60), 41_000 + i)
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            size = r.choice([30, 45, 45, 60, 90, 180])
            a = r.randrange(180 - size + 1)
            own += p[a : a + size] + words(r.randint(1, 20), 42_000 + 10 * i + size)
        rows.append((i, " ".join(own)))
    flat = {i: t.split() for i, t in rows}
    seen: dict = {}
    want = {}
    for i in range(200):  # words of each document that lie in a run of 56 words of an earlier document
        w = flat[i]
        here = [tuple(w[k : k + 56]) for k in range(len(w) - 55)]
        want[i] = {k + j for k, x in enumerate(here) if seen.get(x, i) < i for j in range(56)}
        for x in here:
            seen.setdefault(x, i)
    got: dict = {}
    for g in substrings.passages(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(g.doc_id, set()).update(range(g.start_word, g.end_word))
    found = sum(len(got.get(i, set()) & want[i]) for i in want) / sum(map(len, want.values()))
    print(found)
    assert found >= 0.99


def test_whole_passage_though_its_parts_came_first(spark):
    """180 words of two documents, of which each 45 stood in another document before."""
    p = words(180, 77)
    rows = [(k, " ".join(words(20, 43_000 + k) + p[45 * k : 45 * k + 45] + words(20, 43_100 + k))) for k in range(4)]
    rows += [(10, " ".join(words(9, 43_200) + p + words(9, 43_201))), (11, " ".join(words(30, 43_300) + p + words(5, 43_301))), (12, " ".join(p))]
    got = {(g.doc_id, g.source_doc_id, g.end_word - g.start_word) for g in substrings.passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert {(11, 10, 180), (12, 10, 180)} <= got


def test_repeats_within_a_document(spark):
    p = words(70, 78)
    docs = spark.createDataFrame([(1, " ".join(p + words(30, 79) + p + words(10, 80)))], DOCS)
    assert substrings.passages(docs).count() == 0
    got = [(g.doc_id, g.start_word, g.end_word, g.source_doc_id, g.source_start_word) for g in substrings.passages(docs, within_documents=True).collect()]
    assert got == [(1, 100, 170, 1, 0)]


def test_many_requests_to_one_document(spark, monkeypatch):
    """A document whose words many others ask for is dealt in parts, and each answer is found."""
    monkeypatch.setattr(substrings, "REQUESTS", 7)
    p = words(60, 81)
    docs = spark.createDataFrame([(i, " ".join(p + words(8, 44_000 + i))) for i in range(90)], DOCS)
    assert {g.doc_id for g in substrings.passages(docs).collect()} == set(range(1, 90))


def test_repeated_ids_of_different_texts(spark):
    """Of rows of one doc_id the longest text counts, never a null one; positions are those of that text."""
    p = words(60, 900)
    long, short = " ".join(words(50, 901) + p), " ".join(p[:55])
    rows = [(5, None), (5, " ".join(p)), (7, short), (7, long), (9, " ".join(words(10, 902) + p)), (9, None), (11, None), (11, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *EXTRA)
    got = sorted((g.doc_id, g.start_word, g.end_word, g.source_doc_id, g.source_start_word, g.source_end_word) for g in substrings.passages(docs).collect())
    assert got == [(7, 50, 110, 5, 0, 60), (9, 10, 70, 5, 0, 60)]
    left = sorted((g.doc_id, g.text or "") for g in substrings.remove_passages(docs).collect())
    assert left == sorted([(5, ""), (5, " ".join(p)), (7, " ".join(words(50, 901))), (7, short), (9, ""), (9, " ".join(words(10, 902))), (11, ""), (11, "")])


def _family(rnd, rows, groups):
    """Variants of one text: groups whose members are alike, and which are nearly alike to each other."""
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    kept = [base[:]]
    for _ in range(groups - 1):
        t = base[:]
        for i in rnd.sample(range(150), rnd.randint(5, 12)):
            t[i] = f"g{rnd.randrange(10**6)}"
        kept.append(t)
    out = []
    for k in range(rows):
        t = kept[k % groups][:]
        for i in rnd.sample(range(150), rnd.choice([0, 1, 1, 2, 3])):
            t[i] = f"d{rnd.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def _groups_of(texts, similarity=0.8):
    """Connected components of exact similarity, by counting shared shingles."""
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared: dict = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("rows, cell", [(20, 2048), (240, 2048), (600, 64)])
def test_nearly_alike_groups(spark, monkeypatch, rows, cell):
    """Links are verified inside the cells, small, large and dealt in parts: the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "CELL", cell)
    texts = _family(random.Random(rows), rows, max(3, rows // 12))
    want = _groups_of(texts)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(rows)] == want
    assert 1 < len(set(want)) < rows


def test_nearly_alike_groups_in_a_large_cell(spark):
    """More rows in one cell than CELL, by the cells' own size."""
    texts = _family(random.Random(7), simhash.CELL + 500, 40)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == _groups_of(texts)


def _decoyed(seed, n, length, piece, similarity):
    """n pairs of documents with a fuzzy passage, whose pieces also stand scattered in one document before them all, and in
    one between the two of each pair; and the words of the passage in each later document."""
    rnd = random.Random(seed)
    fresh = iter(range(10**9))
    word = lambda: f"v{next(fresh)}"
    prose = lambda k: [word() for _ in range(k)]
    first, rows, at = [], [], {}
    for i in range(n):
        a = prose(length)
        b = list(a)
        for k in range(piece, length, piece + 1):
            if rnd.random() < (1 - similarity) * (piece + 1):
                b[k] = word()
        pieces = [a[k : k + piece] for k in range(0, length, piece + 1)]
        rnd.shuffle(pieces)
        scattered = lambda: [w for p in pieces for w in [*p, *prose(30)]]  # noqa: E731, B023
        first += scattered()
        at[10 * i + 12] = (40, 40 + length)
        rows += [(10 * i + 10, prose(30) + a + prose(30)), (10 * i + 11, scattered()), (10 * i + 12, prose(40) + b + prose(25))]
    return [(0, first), *rows], at


@pytest.mark.parametrize("length, piece, least", [(120, 14, 10), (120, 7, 8), (200, 30, 10)])
def test_passages_whose_pieces_stand_elsewhere(spark, length, piece, least):
    """Of ten passages; with pieces of seven words few pairs of seeds are left whole."""
    rows, at = _decoyed(piece, 10, length, piece, 1 - 1 / (piece + 1))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOCS)
    found = {i: set() for i in at}
    for r in substrings.passages(docs).collect():
        if r.doc_id in found and r.source_doc_id == r.doc_id - 2:
            found[r.doc_id] |= set(range(r.start_word, r.end_word))
    shares = [len(found[i] & set(range(*at[i]))) / length for i in at]
    assert sum(s >= 0.9 for s in shares) >= least, shares


def test_sets_only_of_rows_that_may_be_similar(spark, monkeypatch):
    """A common line brings many unlike texts into one cell: their sets are not read."""
    monkeypatch.setattr(simhash, "CELL", 12)
    line = " ".join(words(25, 10))
    texts = [line + " " + " ".join(words(60, 600 + i)) for i in range(60)]
    texts += [texts[0] + " more", texts[1] + " more"]
    read = []
    monkeypatch.setattr(simhash, "_similar_in_cells", lambda rows, *a, run=simhash._similar_in_cells: read.append(rows.count()) or run(rows, *a))
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {i: i for i in range(60)} | {60: 0, 61: 1}
    assert sum(read) <= 40, read  # of 62 rows in up to six cells


def test_texts_that_stay_are_not_shuffled(spark, docs, monkeypatch):
    """The stage's plan moves no text of a row that surely stays, whatever may be broadcast; its rows are those of the plain join."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gone = simhash.near_duplicate_groups(docs).where("group_id < doc_id").select(F.col("doc_id").alias("x"))
        want = sorted(map(str, docs.join(gone, docs.doc_id == gone.x, "left_anti").collect()))
        for bits in (1 << 25, 1 << 3, 1):  # with few bits rows that stay meet the ids too
            monkeypatch.setattr("bibspark.llm.common.FILTER_BITS", bits, raising=False)
            kept = simhash.keep_one_of_each_group(docs)
            assert sorted(map(str, kept.collect())) == want
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert plan.startswith("Union")
        first = plan[: plan.index("\n+-")]
        assert "SortMergeJoin" not in first and "LeftAnti" not in first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
