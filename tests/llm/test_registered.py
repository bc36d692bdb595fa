"""Every registered query of the numbered operators and the whole pipeline, end to end, over whole small tables."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bibspark.llm import bpe, registry
from bibspark.llm.common import fold
from bibspark.llm.simhash import near_duplicate_groups

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substrings": {"doc_id", "start_word", "end_word", "source_doc_id", "source_start_word", "source_end_word", "equal_words", "similarity"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op3_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op4_chat": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"}, "op6_quality": {"doc_id", "held_out", "score", "predicted"}, "op7_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op8_license": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}, "op9_decontaminate": {"doc_id", "item_id", "n_shared", "n_item", "containment"}, "op10_ann": {"query_id", "rank", "vec_id", "score"},
    "op11_merkle": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}, "op13_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "license_base": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"}, "rules_base": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"},
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def test_names():
    assert set(registry.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", ["op2_toxicity", "op6_quality"])
def test_classifiers(spark, texts, name):
    rows = registry.QUERIES[name](spark, SF)
    assert set(rows.columns) >= COLUMNS[name]
    got = rows.withColumn("own", fold(F.col("doc_id")) == 2).collect()
    least = {"op2_toxicity": 0.3, "op6_quality": 0.7}[name]
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == r.own and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in got)


def test_bpe_digests(spark, texts, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op3_bpe"](spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_simhash_columns(spark, texts):
    got = registry.QUERIES["op5_simhash"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)
    root = {r.doc_id: r.component_id for r in got}
    bits = {r.doc_id: int(r.fingerprint, 16) for r in got}
    ids = sorted(bits)
    assert all(root[a] == root[b] for a in ids for b in ids if (bits[a] ^ bits[b]).bit_count() <= 3) and all(root[i] <= i and root[root[i]] == root[i] for i in ids)


def test_ann_query(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got: dict = {}
    for r in registry.QUERIES["op10_ann"](spark, SF).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hit = total = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        s = {i: float(v @ vectors[q]) for i, v in vectors.items() if i != q}
        best = sorted(s, key=lambda i: (-s[i], i))[:20]
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rows)
        hit, total = hit + len(set(best) & {r.vec_id for r in rows}), total + len(best)
    assert hit / total >= 0.9


@pytest.mark.parametrize("name", ["op1_substrings", "op4_chat", "op7_warc", "op8_license", "op9_decontaminate", "op11_merkle", "op12_runs", "op13_rules"])
def test_columns(spark, name):
    assert set(registry.QUERIES[name](spark, SF).columns) >= COLUMNS[name]


def test_pipeline(spark, texts, library):
    """Each stage on what its predecessor kept; the last one's ids are those of the library for the texts that came in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "near_dedup":
            assert near_duplicate_groups(docs).where("doc_id <> group_id").count() <= 0.05 * (before.count() - docs.count()) + 1
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    left = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    want = {}
    for i, t in left.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), ids, sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want
