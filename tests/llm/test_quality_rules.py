"""Base counts against plain Python, tokens against the libraries, and bands."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bibspark.llm import registry
from bibspark.llm.common import RAW, span_hashes, word_spans
from bibspark.llm.quality_rules import WINDOW, bands, entropies, fertility, judged, keep_judged, paths, scripts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, lang string, text string, n_words string, kept int"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, n_dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            n_dup += line in seen
            seen.add(line)
    count, covered = {}, set()
    for i in range(len(words) - 4):
        count.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in count.values():
        if len(places) > 1:
            covered.update(j for i in places for j in range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), n_dup, len(covered), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def made(rnd):
    words = ["a", "B", "ä", "日本", "x#y", "<|>", "the", "of", "\U0001f600", "é", " x"]
    out = []
    for _ in range(rnd.randint(0, 30)):
        out.append(rnd.choice(words[: rnd.choice([2, 16])]) + rnd.choice([" ", "  ", "\n", "\t", "\r\n", "\n\n"]))
    return "".join(out) * rnd.choice([1, 1, 1, 2, 3])


def test_base_counts(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["en", None, ""]), made(rnd)) for i in range(400)]
    rows += [(None, None, None), (1, "en", ""), (2, None, "\n\n \n"), (3, "en", "a b c d e " * 4000), (3, "en", "a b c d e " * 4000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    got = sorted(((str(r.doc_id), base(r)) for r in judged(df).collect()), key=str)
    assert got == sorted(((str(i), plain(t)) for i, _, t in rows), key=str)
    assert judged(df.limit(0)).collect() == []
    kept = {r.doc_id for r in keep_judged(df).collect()}
    assert kept == {r.doc_id for r in judged(df).where("kept").collect()} and keep_judged(df).columns == df.columns


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op13_rules"](spark, SF).collect()
    assert {r.doc_id: base(r) for r in got} == {i: plain(t) for i, t in texts.items()}
    assert all(r.kept == (not r.base_failed and not r.rejected) for r in got)
    passed = [r for r in got if not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.9 * len(passed)


def test_tokens():
    """Word by word, with the words that a worker remembers, as the libraries encode texts of single spaces."""
    own = fertility(*paths())
    rnd = random.Random(2)
    texts = [" ".join(made(rnd).split()) for _ in range(60)] + ["", "Ein schöner Tag in München."]
    for _ in range(2):
        low, _, start, stop, n = word_spans(pa.array(texts), RAW)
        slots = own.slots(low, start, stop, span_hashes(low, start, stop))
        at = 0
        for t, k in zip(texts, n.tolist(), strict=True):
            s = slots[at : at + k]
            at += k
            words = [w.decode() for w in t.encode().split()]
            assert own.tokens(s).tolist() == [x for w in words for x in own.bytes.encode_ordinary(f" {w}")]
            ids = [x for w in words for x in own.pieces.encode(w)]
            assert own.n_pieces[s].sum() == len(ids) and own.n_bytes[s].sum() == sum(own.pieces.is_byte(x) for x in ids)
    assert own.tokens(own.slots(*word_of("schöner"))).tolist() == own.bytes.encode_ordinary(" schöner")


def word_of(word):
    low, _, start, stop, _ = word_spans(pa.array([word]), RAW)
    return low, start, stop, span_hashes(low, start, stop)


def test_entropies():
    rnd = np.random.default_rng(1)
    n = np.array([0, 1, 2, 63, 64, 65, 500, 0, 1000])
    tokens = rnd.integers(0, 30, n.sum())
    want, at = [], 0
    for k in n.tolist():
        own, at, many = tokens[at : at + k].tolist(), at + k, max(k // WINDOW, 1)
        groups = [[t for j, t in enumerate(own) if j * many // k == w] for w in range(many)]
        bits = [-sum(g.count(t) / len(g) * math.log2(g.count(t) / len(g)) for t in set(g)) / math.log2(len(g)) if len(g) > 1 else 0.0 for g in groups]
        want.append(sum(bits) / many)
    assert np.allclose(entropies(tokens, n), want)


def test_scripts():
    assert scripts(["", None, "abc", "привет мир a", "日本語", "ひらがなa", "한국어", "العربية", "ελληνικά", "12 34", "über"]) == ["latin", "latin", "latin", "cyrillic", "han", "kana", "hangul", "arabic", "greek", "latin", "latin"]


@pytest.mark.parametrize("copies", [1, 400])
def test_bands(spark, copies):
    """Of ordinary prose nothing goes; other tokens go; copies of one text do not narrow the bands."""
    rnd = random.Random(8)
    vocabulary = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(20).collect() for w in r.text.split()]
    prose = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(20, 300))) for _ in range(200)]
    noise = lambda: "".join(rnd.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(30))
    odd = {900: " ".join(f"{chr(0x1FA00 + i)}{chr(0x1F900 + i)}{chr(0x1C80 + i % 8)}" for i in range(60)), 901: " ".join(noise() for _ in range(80))}
    rows = [(i, "en", t) for i, t in enumerate(prose)] + [(i, "en", t) for i, t in odd.items()] + [(1000 + i, "en", prose[0]) for i in range(copies)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in judged(df).collect()}
    assert not got[900].kept and "fallback_share" in got[900].rejected
    assert not got[901].kept and "chars_per_token" in got[901].rejected
    assert all(got[i].kept for i in range(200)) and all(got[1000 + i].kept for i in range(copies))


def test_bands_of_few_texts(spark):
    """The texts of a band whose measures are all within LOW and HIGH's reach stay, however few they are."""
    rows = spark.createDataFrame([("a", False, 4.0, 0.0, 0.9), ("b", False, 3.0, 0.1, 0.8), ("b", False, 5.0, 0.1, 0.7), ("c", True, 1.0, 0.0, 0.1)], "band string, base_failed boolean, chars_per_token double, fallback_share double, entropy double")
    got = {r.band: r for r in bands(rows).collect()}
    assert set(got) == {"a", "b"} and got["a"].low_chars_per_token == 3.75 and got["a"].high_chars_per_token == 6 and got["a"].high_entropy == math.inf and got["b"].low_chars_per_token <= 3
