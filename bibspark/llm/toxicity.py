"""Operator 2, toxicity by maximum-scoring segments.

1. Tokens (words and their prefixes) of all documents are counted in hashed buckets (a table of fixed size); of labelled
   documents it is counted by class in how many each bucket occurs. The log-odds of a bucket between toxic and clean
   text, under a Dirichlet prior of half a count and in proportion to its share of the whole corpus, and shrunk by its
   standard error, less a drift, is the score of a token. Shrinkage and drift are chosen from GRID by the cross-validated
   loss over the learnable folds, with at most TRIED labelled documents.
2. A linear scan finds every maximal segment of a document's token scores.
3. Extreme-value statistics: lambda solves sum p_w exp(lambda s_w) = 1 over the corpus' shares p_w; K is fitted to the
   best segments of clean calibration documents. A segment of score S in n tokens has E = K n exp(-lambda S).
4. The significant segments' evidence is aggregated and calibrated to a probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm import logistic
from bibspark.llm.common import LETTERS, batch, bounded_sample, discard, fold, materialise, read_table, split_words, written

BUCKETS = 1 << 17
PREFIXES = (4, 6)  # bytes; unseen forms of a word share them
ALL = BUCKETS * (1 + len(PREFIXES))
SAMPLE = 40_000
FOLDS = (0, 1, 3)
PRIOR = 500.0
GRID = [(shrink, drift) for shrink in (1.0, 2.0, 3.0) for drift in (0.5, 1.0, 2.0)]  # standard errors, score
TRIED = 4_000
E_MOST = 1.0
EULER = 0.5772156649


@dataclass(frozen=True)
class ToxicityModel:
    token_scores: np.ndarray
    drift: float
    lam: float
    log_k: float
    weights: tuple[float, ...]


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every token of all texts, one column for each form (the word, then its prefixes; a word that is no
    longer than a prefix repeats its own bucket), and each text's number of tokens."""
    words = [split_words(t.lower() if t else t, LETTERS) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    mask = np.uint32(BUCKETS - 1)
    out = np.empty((len(flat), 1 + len(PREFIXES)), np.uint32)
    out[:, 0] = np.fromiter(map(crc32, flat), np.uint32, len(flat)) & mask
    for k, p in enumerate(PREFIXES, 1):
        own = np.fromiter((crc32(w[:p]) for w in flat), np.uint32, len(flat)) & mask
        out[:, k] = np.where(size > p, own + np.uint32(k * BUCKETS), out[:, 0])
    return out, n


def count_tokens(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Counts by bucket: first the tokens of all documents, then the labelled documents by fold and class (clean, toxic)."""
    names = ["n", *(f"n{f}_{y}" for f in FOLDS for y in (0, 1))]
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in names)])

    def run(batches):
        total = np.zeros((len(names), ALL), np.int64)
        for b in batches:
            at, n = buckets(b.column(0).to_pylist())
            total[0] += np.bincount(at.reshape(-1), minlength=ALL)
            part = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            for i in np.flatnonzero(part):
                total[part[i], np.unique(at[ends[i] - n[i] : ends[i]])] += 1
        some = np.flatnonzero(total[0])
        for i in range(0, len(some), 16_384):
            yield batch(schema, some[i : i + 16_384].astype(np.int32), *total[:, some[i : i + 16_384]])

    at = F.array_position(F.array(*map(F.lit, FOLDS)), fold(F.col("doc_id")).cast("int"))
    known = sample.select("doc_id", (2 * at - 1 + F.col("label")).cast("int").alias("part"))
    rows = (
        docs.join(F.broadcast(known), "doc_id", "left")
        .select("text", "part")
        .mapInArrow(run, ", ".join(["bucket int", *(f"{c} long" for c in names)]))
        .groupBy("bucket")
        .agg(*(F.sum(c).alias(c) for c in names))
        .toPandas()
    )
    out = np.zeros((len(names), ALL))
    out[:, rows.bucket.to_numpy()] = rows[names].to_numpy().T
    return out


def token_scores(counts: np.ndarray, shrink: float, without: int | None = None) -> np.ndarray:
    """Shrunken log-odds of each bucket, learnt from all folds but one."""
    by_class = counts[1:].reshape(len(FOLDS), 2, -1)
    clean, toxic = by_class[[f != without for f in FOLDS]].sum(axis=0)
    everything = counts[0]
    prior = 0.5 + PRIOR * everything / max(everything[:BUCKETS].sum(), 1)
    odds, var = 0.0, 0.0
    for n, sign in ((toxic, 1), (clean, -1)):
        a = n + prior
        odds = odds + sign * (np.log(a) - np.log(a.sum() - a))
        var = var + 1 / a
    return (np.sign(odds) * np.maximum(np.abs(odds) - shrink * np.sqrt(var), 0)).astype(np.float32)


def scan_scores(odds: np.ndarray, at: np.ndarray, drift: float) -> np.ndarray:
    """Of each token: the odds of largest size among its forms, less the drift."""
    forms = odds[at].astype(np.float64)
    return forms[np.arange(len(at)), np.abs(forms).argmax(axis=1)] - drift if len(at) else np.zeros(0)


def decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with sum share * exp(lambda * scores) = 1 (1 if scores are never positive)."""
    if not (scores[share > 0] > 0).any() or (scores * share).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (share * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return (low + high) / 2


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of token scores, left to right, in linear time."""
    up = s > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, up, False].astype(np.int8)))
    cum = np.r_[0.0, np.cumsum(s, dtype=np.float64)]
    kept: list[list] = []  # start, end, sum before, sum after, the nearest kept segment to the left with a smaller sum before
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        before, after = cum[start], cum[end]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                kept.append([start, end, before, after, j])
                break
            start, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, float(y - x)) for a, b, x, y, _ in kept]


def evidence(found: list[tuple[int, int, float]], n: int, lam: float, log_k: float) -> tuple[list[float], list[float]]:
    """log E of each segment, and the document's features."""
    log_e = [log_k + np.log(n) - lam * x for *_, x in found]
    strong = [-e for e in log_e if e < np.log(E_MOST)]
    best = max((-e for e in log_e), default=-12.0)
    return log_e, [np.log1p(sum(strong)), float(np.clip(best, -12, 40)), np.log1p(len(strong)), np.log1p(n), float(not found)]


def _scan(texts, scores, drift):
    at, n = buckets(texts)
    s = scan_scores(scores, at, drift)
    for part, size in zip(np.split(s, np.cumsum(n)[:-1]), n.tolist(), strict=True):
        yield segments(part), size


def _held(docs: DataFrame, chosen: DataFrame, grid: list[tuple[float, float]], scores: dict):
    """(config, label, fold, n, s): the segments of labelled documents under the scores learnt without their fold."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    schema = pa.schema([("config", pa.int32()), ("label", pa.int32()), ("fold", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for text, y, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, n = buckets([text])
                found = [[x for *_, x in segments(scan_scores(shared.value[shrink, f], at, drift))] for shrink, drift in grid]
                yield batch(schema, list(range(len(grid))), [y] * len(grid), [f] * len(grid), [int(n[0])] * len(grid), found)

    held = chosen.select("doc_id", "label", fold(F.col("doc_id")).cast("int").alias("fold"))
    return docs.join(F.broadcast(held), "doc_id").select("text", "label", "fold").mapInArrow(run, "config int, label int, fold int, n long, s array<double>")


def _features(rows, lam: dict) -> tuple[float, np.ndarray]:
    """log K of the clean documents, and the features of all."""
    tops = [lam[f] * max(s) - np.log(n) for y, f, n, s in zip(rows.label, rows.fold, rows.n, rows.s, strict=True) if not y and len(s)]
    log_k = float(np.median(tops) + np.log(np.log(2))) if tops else 0.0
    return log_k, np.array([evidence([(0, 0, v) for v in s], max(n, 1), lam[f], log_k)[1] for f, n, s in zip(rows.fold, rows.n, rows.s, strict=True)]).reshape(-1, 5)


def _loss(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> float:
    """Log loss of each fold under weights fitted on the others."""
    total = 0.0
    for f in FOLDS:
        own = folds == f
        p = np.clip(logistic.predict(np.array(logistic.fit(x[~own], y[~own])), x[own]), 1e-4, 1 - 1e-4)
        total -= float((y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p)).sum())
    return total


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Token scores from the learnable rows and the whole corpus; shrinkage, drift, K and the calibration from each fold's
    documents under the scores that were learnt without that fold.

    At most `sample` labelled documents are used, all rows of them. Null labels are left out; several labels of a document
    count as the largest."""
    before = written()
    chosen = materialise(bounded_sample(labels, label, sample), "labelled")
    docs = docs.select("doc_id", "text")
    counts = count_tokens(docs, chosen)
    share = counts[0][:BUCKETS] / max(counts[0][:BUCKETS].sum(), 1)
    scores = {(shrink, f): token_scores(counts, shrink, f) for shrink in {x for x, _ in GRID} for f in (*FOLDS, None)}
    lam = {(shrink, drift, f): decay(scores[shrink, f][:BUCKETS] - drift, share) for shrink, drift in GRID for f in (*FOLDS, None)}
    tried = materialise(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRIED), "tried")
    rows = _held(docs, tried, GRID, {k: v for k, v in scores.items() if k[1] is not None}).toPandas()
    losses = []
    for k, (shrink, drift) in enumerate(GRID):
        own = rows[rows.config == k]
        _, x = _features(own, {f: lam[shrink, drift, f] for f in FOLDS})
        losses.append(_loss(x, own.label.to_numpy(float), own.fold.to_numpy()))
    shrink, drift = GRID[int(np.argmin(losses))]
    rows = _held(docs, chosen, [(shrink, drift)], {(shrink, f): scores[shrink, f] for f in FOLDS}).toPandas()
    log_k, x = _features(rows, {f: lam[shrink, drift, f] for f in FOLDS})
    discard(docs.sparkSession, before)
    return ToxicityModel(scores[shrink, None], drift, lam[shrink, drift, None], log_k, tuple(logistic.fit(x, rows.label.to_numpy(float))))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, n_tokens, toxicity, passages) of every row of docs.

    passages: the significant segments (E of at most E_MOST) as token spans with score and E. Null and empty texts
    have no passage and the score of an empty text; repeated rows stay; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("toxicity", pa.float64()), ("passages", pa.list_(passage))])

    def run(batches):
        m = shared.value
        weights = np.array(m.weights)
        for b in batches:
            x, spans, sizes = [], [], []
            for found, n in _scan(b.column(1).to_pylist(), m.token_scores, m.drift):
                log_e, row = evidence(found, max(n, 1), m.lam, m.log_k)
                x.append(row)
                sizes.append(n)
                spans.append([{"start": a, "end": z, "score": v, "e_value": float(np.exp(e))} for (a, z, v), e in zip(found, log_e, strict=True) if e < np.log(E_MOST)])
            yield batch(schema, b.column(0), sizes, logistic.predict(weights, np.array(x).reshape(-1, 5)), spans)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, toxicity double, passages array<struct<start:long,end:long,score:double,e_value:double>>")


def op2_toxicity(spark, sf_dir):
    """One row per row of documents: repeated rows stay; null and empty texts get the score of an empty text; a row with
    a null doc_id is scored and not held out."""
    docs = read_table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
