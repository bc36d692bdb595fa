"""Operator 8, license scans by diagonal voting.

All rolling word k-grams of every text are hashed (k is GRAMS[0] for short templates and GRAMS[1] for long ones); those
that occur in a template (a table of fixed size, so the test runs where the text is) are written as rows and joined to the
templates' positions. A hit votes for the diagonal (document position - template position); votes are counted per
document, template and diagonal, and neighbouring diagonals are merged, since insertions and deletions move a match to
the next diagonal. Each merged span is verified by aligning it with its template: the longest run of hits that ascends on
both sides has to cover enough of the template's words and of the span's own.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.llm.common import ALNUM, batch, finished, materialise, mix64, read_table, salt, split_words, word_hashes, written
from bibspark.llm.licenses import TEMPLATES

GRAMS = (2, 4)
SHORT = 16  # words of a template that has short k-grams
VOTES = 0.5  # of a template's k-grams, for a span to be aligned
SHARE = 0.75  # of a template's words, in the alignment
DENSE = 0.5  # of the span's words
DRIFT = 3  # words that neighbouring diagonals may lie apart


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words, from the words' hashes."""
    size = len(words) - k + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(size, np.uint64)
    for i in range(k):
        h = mix64(h + words[i : i + size] + salt(10 * k + i + 1))
    return h.view(np.int64)


def template_positions(spark: SparkSession, templates=None) -> DataFrame:
    """(template, label, base, grams, k, words, hash, at) of all templates."""
    rows = []
    for i, (label, base, text) in enumerate(templates or TEMPLATES):
        n = len(split_words(text, ALNUM))
        k = GRAMS[0] if base or n < SHORT else GRAMS[1]
        h = gram_hashes(word_hashes(pa.array([text]), ALNUM)[0], k)
        rows += [(i, label, base, len(h), k, n, x, at) for at, x in enumerate(h.tolist())]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, k int, words int, hash long, at int")


def gram_hits(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, hash, pos), written: one row without hash per text, and one per k-gram of a template."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64())])
    known = np.sort(np.array([r.hash for r in positions.select("hash").distinct().collect()], np.int64))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids, keys = part.column(0), part.column(1)
                words, n = word_hashes(part.column(2), ALNUM)
                yield batch(schema, ids, keys, n, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()))
                ends = np.cumsum(n)
                for k in GRAMS:
                    h = gram_hashes(words, k)
                    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
                    doc = np.searchsorted(ends, at, "right")
                    inside = at + k <= ends[doc]
                    at, doc = at[inside], doc[inside]
                    if len(at):
                        yield batch(schema, ids.take(pa.array(doc)), keys.take(pa.array(doc)), n[doc], h[at], at - (ends - n)[doc])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return materialise(rows.mapInArrow(run, "doc_id long, text_key long, n_words long, hash long, pos long"), "hits")


def aligned(hits: list[tuple[int, int]], k: int, words: int) -> tuple[int, int, float, float]:
    """(start, end, share of the template's words, share of the span's words) of the longest chain of hits (position,
    place in the template) that ascends on both sides."""
    tails, ends, before = [], [], []
    hits = sorted(set(hits), key=lambda x: (x[0], -x[1]))
    for i, (_, at) in enumerate(hits):
        j = bisect_left(tails, at)
        before.append(ends[j - 1] if j else -1)
        tails[j : j + 1], ends[j : j + 1] = [at], [i]
    i, chain = ends[-1], []
    while i >= 0:
        chain.append(hits[i])
        i = before[i]
    start, end = chain[-1][0], chain[0][0] + k
    own = len({p + x for p, _ in chain for x in range(k)})
    of_template = len({a + x for _, a in chain for x in range(k)})
    return start, end, of_template / words, own / (end - start)


def spans(hits: DataFrame, positions: DataFrame) -> DataFrame:
    """(doc_id, text_key, template, label, base, start, end, share) of all verified spans.

    Repeated rows of one text give each span once."""
    key = ["doc_id", "text_key", "template", "label", "base", "grams", "k", "words"]
    votes = hits.where("hash is not null").join(F.broadcast(positions), "hash").select(*key, (F.col("pos") - F.col("at")).alias("diagonal"), "pos", "at").distinct()
    diagonals = votes.groupBy(*key, "diagonal").agg(F.collect_set(F.struct("pos", "at")).alias("hits"), F.min("pos").alias("first"), F.max("pos").alias("last"))  # a diagonal has at most a template's places
    base = diagonals.where(F.col("base") & (F.size("hits") == F.col("grams")))
    fuzzy = diagonals.where(~F.col("base"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= DRIFT) & (F.col("first") - F.lag("last").over(order) <= F.col("grams") + DRIFT)
    merged = (
        fuzzy.withColumn("chain", F.sum(F.when(near, 0).otherwise(1)).over(order))
        .groupBy(*key, "chain")
        .agg(F.flatten(F.collect_list("hits")).alias("hits"))
        .where(F.size(F.array_distinct(F.transform("hits", lambda x: x["at"]))) >= F.ceil(F.lit(VOTES) * F.col("grams")))
    )
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, template, label, k, words, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start, end, share, dense = aligned([(h["pos"], h["at"]) for h in own], k, words)
                if share >= SHARE and dense >= DENSE:
                    rows.append((doc, text, template, label, False, start, end, share))
            if rows:
                yield batch(schema, *zip(*rows, strict=True))

    found = merged.select("doc_id", "text_key", "template", "label", "k", "words", "hits").mapInArrow(run, "doc_id long, text_key long, template int, label string, base boolean, start long, end long, share double")
    exact = base.select("doc_id", "text_key", "template", "label", "base", F.col("first").alias("start"), (F.col("last") + F.col("k")).alias("end"), F.lit(1.0).alias("share"))
    return exact.unionByName(found)


def license_spans(docs: DataFrame, templates=None) -> DataFrame:
    """All verified spans of docs (doc_id, text; other columns are ignored).

    templates: (label, is a base phrase, text) rows, a bounded list; None: the texts of bibspark.llm.licenses. Null and
    empty texts have no span; a null doc_id is kept."""
    positions = template_positions(docs.sparkSession, templates)
    return spans(gram_hits(docs, positions), positions)


def op8_license(spark, sf_dir):
    """One row per row of documents. Null text: no words. Repeated rows get equal results; a null doc_id is kept."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    before, positions = written(), template_positions(spark)
    hits = gram_hits(docs, positions)
    found = spans(hits, positions)
    base = F.col("base")
    grouped = found.groupBy("doc_id", "text_key").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    texts = hits.where("hash is null").select("doc_id", "text_key", "n_words")
    same = texts.doc_id.eqNullSafe(grouped.doc_id) & (texts.text_key == grouped.text_key)
    rows = texts.join(grouped, same, "left").select(
        texts.doc_id,
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return finished(rows, "licenses", before)


def license_base(spark, sf_dir):
    """The columns of op8_license that SQL can express."""
    return op8_license(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m FROM d)
SELECT doc_id, n AS n_words, len(a) + len(g) + len(m) AS n_base, list_min(a || g || m) - 1 AS first_word, list_max(a || g || m) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM p
"""
