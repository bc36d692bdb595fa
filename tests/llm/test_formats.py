"""Operators 3, 4, 7, 8: exact against the library, brute force and round trips."""

import gzip
import random
import re

import pytest
from tokenizers import Tokenizer

from bibspark.llm import bpe, chat, license_scan, warc

ODD = "aAzZ éÉßΣσς İı\u0085\u001c  '’s'S'll 'RE 12٣½\n\t!?#$é漢字🙂‍\u0000"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(reference):
    r = random.Random(1)
    texts = ["", " ", "aaaaaaaaaaaaaaaa", "<|startoftext|>x<|endoftext|>", "<|StartOfText|>", "hello world " * 500]
    texts += ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) + r.choice(["", "<|endoftext|>", "can't WE'LL"]) for _ in range(800)]
    mine = bpe.tokenizer(bpe.default_path()).encode(texts)
    for t, ids, e in zip(texts, mine, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, t
        assert bpe.tokenizer(bpe.default_path()).decode(e.ids) == reference.decode(e.ids, skip_special_tokens=False)


def test_bpe_letters_of_any_unicode_version(reference):
    """Random strings over all planes, newest capitals among them, as the library encodes them."""
    rnd = random.Random(16)
    own = bpe.tokenizer(bpe.default_path())
    newest = "\ua7cb\ua7cc\ua7da\ua7dc\u1c89\U00010d50\U00010d65"
    texts = ["".join(rnd.choice(newest) if rnd.random() < 0.1 else chr(rnd.choice([rnd.randrange(0x20, 0xD800), rnd.randrange(0xE000, 0x20000), rnd.randrange(0xA640, 0xA800)])) for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    differ = [t for t, ids in zip(texts, own.encode(texts), strict=True) if ids.tolist() != reference.encode(t, add_special_tokens=False).ids]
    assert not differ, [hex(ord(c)) for c in differ[0]]


def test_bpe_frames(spark):
    docs = spark.createDataFrame([(1, "Hello, world"), (2, None), (None, ""), (1, "Hello, world")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    path = bpe.default_path()
    ids = bpe.encode(docs, path)
    assert sorted((str(r.doc_id), len(r.ids)) for r in ids.collect()) == [("1", 3), ("1", 3), ("2", 0), ("None", 0)]
    assert {r.text for r in bpe.decode(ids, path).collect()} == {"hello</w> ,</w> world</w>", ""}
    assert bpe.encoded_digests(docs, path).count() == 4
    assert bpe.encode(docs.limit(0), path).count() == 0


CONTROL = ["", "\\", "<|turn|>", "<|end|>\n", "<\\|", "\\\\<|", "\\n", "a<|b|>\\", "\\### Assistant: </turn> ok"]


def test_chat_roundtrip():
    r = random.Random(2)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "sys\ntem", ""]), "".join(r.choice([*CONTROL, "x", "\n"]) for _ in range(r.randint(0, 6)))) for _ in range(r.randint(0, 5))]
        text, loss = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in loss] == [t for role, t in turns if role == "assistant"]


def test_branches(spark):
    #      1 - 2 - 4        tree a; 3 is a second answer to 1; 5 follows 3
    rows = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "r1", 1.0), ("a", 4, 2, "user", "t", 1.0), ("a", 3, 1, "assistant", "r2", 5.0), ("a", 5, 3, "user", None, None), ("b", 1, 99, "user", "lone", 0.0)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): (r["rank"], [t.text for t in r.turns]) for r in chat.branches(m).collect()}
    assert got == {("a", 5): (1, ["q", "r2", None]), ("a", 4): (2, ["q", "r1", "t"]), ("b", 1): (1, ["lone"])}
    assert {(r.tree, r.leaf) for r in chat.branches(m, top=1).collect()} == {("a", 5), ("b", 1)}
    assert chat.branches(m.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [("c", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(100)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    r = chat.branches(m).first()
    assert [t.text for t in r.turns] == [str(i) for i in range(100)]


def test_warc_roundtrip(spark, tmp_path):
    pages = [(1, "http://a/ b", "<p>x</p>\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", "<p>x</p>\r\n\r\nWARC/1.1\r\n"), (4, "é", ""), (5, "z", "ü" * 10), (6, "y", "\r\n\r\n"), (7, "x", "long" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as last", "3 as value")
    warc.write_warc(df, str(tmp_path / "w"))
    got = {warc.page_of(r.record_id): r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {k: (r.warc_type, warc.page_of(r.refers_to)) for k, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 4), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    for page, _, html in pages:
        raw = (html or "").encode()
        assert (got[page].status, got[page].payload_bytes, got[page].payload_digest) == ("ok", len(raw), warc.base32_sha1(raw))


def test_salvage():
    records = [warc.record(i, "u", f"payload {i}".encode() * 20, None, False) + warc.END for i in range(6)]
    plain = b"".join(records)
    assert [h["warc-record-id"] for _, _, h, _ in warc.salvage(plain)] == [f"<urn:page:{i}>" for i in range(6)]
    cut = plain[: len(records[0])] + records[1][:100] + b"junk" + b"".join(records[2:])
    got = list(warc.salvage(cut))
    assert [h and h["warc-record-id"] for _, _, h, _ in got] == ["<urn:page:0>", None, *(f"<urn:page:{i}>" for i in range(2, 6))]
    assert (got[1][0], got[1][1]) == (len(records[0]), len(records[0]) + 104)
    flipped = bytearray(plain)
    flipped[len(records[0]) + len(records[1]) - 30] ^= 1
    assert [h is None for _, _, h, _ in warc.salvage(bytes(flipped))] == [False, True, False, False, False, False]
    members = [gzip.compress(r) for r in records]
    assert len([1 for _, _, h, _ in warc.salvage(b"".join(members)) if h]) == 6
    broken = members[0] + members[1][:-9] + b"".join(members[2:])
    ids = [h and h["warc-record-id"] for _, _, h, _ in warc.salvage(broken)]
    assert ids[0] == "<urn:page:0>" and ids[-4:] == [f"<urn:page:{i}>" for i in range(2, 6)] and None in ids
    assert list(warc.salvage(b"")) == []


def test_license(spark):
    texts = {1: "Released under the MIT License, the mit-license. MIT license", 2: "GNU General Public License general PUBLIC license", 3: None, 4: "", 5: "mit licenses apache  license", 6: "Licensed under the extra Apache License, Version 2.0 today", 7: "license " * 5000}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, "MIT License")], "doc_id long, text string").selectExpr("*", "1 as hash", "2 as pos", "3 as label", "4 as template")
    base = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]
    got = {}
    for r in license_scan.license_spans(docs).collect():
        if r.base:
            got.setdefault(r.doc_id, set()).add((r.label, r.start))
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        want = {(name, k) for name, p in base for k in range(len(w)) if w[k : k + len(p)] == p}
        assert got.get(i, set()) == want
    fuzzy = {(r.doc_id, r.label) for r in license_scan.license_spans(docs).collect() if not r.base}
    assert (6, "apache-2.0") in fuzzy and (1, "mit") in fuzzy and not any(i == 7 for i, _ in fuzzy)
    assert license_scan.license_spans(docs.limit(0)).count() == 0


def test_license_texts(spark):
    """Whole license texts with holders, changed, inserted and dropped words; unrelated text with some of their words."""
    r = random.Random(3)
    docs, want = [], {}
    for k, (label, base, text) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        if base or len(w) < license_scan.SHORT:
            continue
        if len(w) > 60:
            for _ in range(4):
                w[r.randrange(len(w))] = "changed"
            w.insert(r.randrange(len(w)), "Inserted (words) here")
            del w[r.randrange(len(w))]
        docs.append((k, "Copyright 2020 A. Holder.\n" + " ".join(w).upper() + ". int main() { return 0; }"))
        want[k] = label
    docs.append((900, " ".join(r.choice(docs)[1].split()[r.randrange(9)] for _ in range(400))))
    got = {}
    for s in license_scan.license_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        if not s.base and s.end - s.start >= license_scan.SHORT - 4:
            got.setdefault(s.doc_id, set()).add(s.label)
    assert all(want[k] in got.get(k, set()) for k in want) and 900 not in got


def test_license_query(spark, tmp_path):
    """The registered query's columns against brute force, with nulls, repeated rows and a null doc_id."""
    texts = [(1, "The MIT license, and mit-License"), (2, None), (3, ""), (1, "The MIT license, and mit-License"), (None, "Apache License Version 2.0"), (4, "no words of it")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(map(str, license_scan.op8_license(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()))
    row = lambda *v: str(spark.createDataFrame([v], "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string").first())
    assert rows == sorted([row(1, 6, 2, 1, 4, "mit")] * 2 + [row(2, 0, 0, None, None, ""), row(3, 0, 0, None, None, ""), row(None, 5, 1, 0, 0, "apache"), row(4, 4, 0, None, None, "")])


def test_oracles(spark):
    """Queries that SQL can express, against DuckDB, over whole tables."""
    import duckdb
    import pandas as pd

    from bibspark.llm import registry

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("conversations", "pages", "documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        got, want = registry.QUERIES[name](spark, sf).toPandas(), c.sql(sql).df()
        rows = lambda d: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want), name


@pytest.mark.parametrize("split", [3_000, 1 << 27])
def test_warc_ranges(spark, tmp_path, split):
    """Archives read by ranges of any size give what salvage() gives of the whole: marks in payloads, damage, junk, gaps."""
    r = random.Random(split)
    html = lambda i: r.choice(["x" * r.randint(0, 900), "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * r.randint(1, 9), "\r\n\r\nWARC/1." * r.randint(1, 40), "é" * 300])
    parts = [warc.record(i, f"http://a/{i}", html(i).encode(), None, False) + warc.END for i in range(45)]
    parts[5] = parts[5][: len(parts[5]) // 2]
    parts[20] = parts[20].replace(b"Content-Length", b"Content-Length", 1)[:-9] + b"#####" + parts[20][-4:]
    parts[33] = b"junk \x00\xff junk" * 20 + parts[33]
    parts[40] = parts[40].replace(b"Content-Length: ", b"Content-Length: 99", 1)
    raw = b"".join(parts)
    (tmp_path / "part-0").write_bytes(raw)
    (tmp_path / "part-1").write_bytes(b"")
    (tmp_path / "part-2").write_bytes(b"no record at all")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((x.start, x.end, x.status, x.record_id or "", bytes(x.payload or b"")) for x in warc.read_warc(spark, str(tmp_path)).where("path like '%part-0'").collect())
        rest = [(x.path[-6:], x.status, x.end) for x in warc.read_warc(spark, str(tmp_path)).where("path not like '%part-0'").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(a, z, "gap" if h is None else "ok", h["warc-record-id"] if h else "", warc.http_payload(x)[0] if h else b"") for a, z, h, x in warc.salvage(raw)]
    records = lambda rows: [x for x in rows if x[2] != "gap"]
    assert records(got) == records(want) and len(records(want)) >= 42
    covered = lambda rows: {p for a, z, *_ in rows if _[0] == "gap" for p in range(a, z)}
    assert covered(got) == covered(want)
    assert rest == [("part-2", "gap", 16)]


def test_warc_members(spark, tmp_path):
    records = [warc.record(i, "u", f"payload {i}".encode() * 20, None, False) + warc.END for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = sorted(x.record_id for x in warc.read_warc(spark, str(tmp_path), compressed=True, glob="*.gz").collect())
    assert got == [f"<urn:page:{i}>" for i in range(4)]


def test_warc_very_long_url(spark, tmp_path):
    """A header of more than 1 MiB is read like any other."""
    pages = spark.createDataFrame([(1, "http://a/" + " " * 400_000, "one"), (2, "http://b", "two")], "page_id long, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w")
    got = {(r.record_id, r.status, bytes(r.payload), len(r.target_uri)) for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert got == {("<urn:page:1>", "ok", b"one", 1_200_009), ("<urn:page:2>", "ok", b"two", 8)}


def test_warc_payload_of_marks(spark, tmp_path):
    """Payloads made of version marks take time in proportion to their size, and come back whole."""
    import time

    from bibspark.llm.warc import read_warc, write_warc

    def seconds(n):
        rows = [(1, "u", "WARC/1." * n), (2, "v", "plain"), (3, "w", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * (n // 8))]
        folder = str(tmp_path / str(n))
        write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
        at = time.time()
        got = {r.record_id: r.payload for r in read_warc(spark, folder).where("status = 'ok'").collect()}
        assert got == {f"<urn:page:{i}>": t.encode() for i, _, t in rows}
        return time.time() - at

    seconds(100)
    few, many = seconds(20_000), seconds(160_000)
    assert many < 4 * few + 8, (few, many)
