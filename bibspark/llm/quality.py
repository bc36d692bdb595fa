"""Operator 6, quality by compression: zstandard dictionaries from good and bad labelled text.

A text is cut into blocks, each compressed once with the dictionary of good text and once with that of bad text (and
once with none). The difference of the two sizes, normalised by the text's size, becomes a calibrated probability.
Blocks keep the dictionaries useful over a whole long text. The classifier is fitted on a bounded sample of labelled
rows (SAMPLE rows, texts of at most SAMPLE_BYTES each); everything else covers all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bibspark.llm import logistic
from bibspark.llm.common import bounded_sample, fold, read_table

SAMPLE = 12_000
SAMPLE_BYTES = 16_384
DICTIONARY = 112_640
BLOCK = 2_048
LEVEL = 3
FOLDS = (0, 1, 3)


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def sizes(raw: bytes, compressors) -> list[int]:
    """Compressed bytes of all blocks of raw, for each compressor."""
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def compressors(good: bytes, bad: bytes):
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    out = [zstandard.ZstdCompressor(**plain)]
    for d in (good, bad):
        data = zstandard.ZstdCompressionDict(d)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=data, **plain))
    return out


def features(texts: list[str | None], found) -> np.ndarray:
    """Per text: the normalised difference, how compressible it is alone, and the log of its bytes."""
    out = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if raw:
            plain, good, bad = sizes(raw, found)
            n = len(raw)
            diff = (bad - good) / (bad + good)
            out[i] = diff, plain / n, np.log1p(n), diff * np.log1p(n)
    return out


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train one, the text itself."""
    blocks = [s[i : i + BLOCK] for s in samples for i in range(0, len(s), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, d=8, k=256).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY] or b"\0" * 8


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Dictionaries from a bounded sample of the learnable rows; calibration on each fold's rows in turn.

    Null labels are left out; several labels of a document count as the largest. Without any label all texts score
    alike."""
    chosen = bounded_sample(labels, label, sample)
    rows = (
        docs.select(F.col("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
        .select("doc_id", fold(F.col("doc_id")).alias("fold"), "text", "label")
        .orderBy("doc_id", "text")
        .limit(sample)
        .collect()
    )
    x, y = [], []
    for f in FOLDS:  # each fold's documents under dictionaries built without them
        own = [r for r in rows if r.fold == f]
        x.append(features([r.text for r in own], compressors(*_dictionaries([r for r in rows if r.fold != f]))))
        y += [r.label for r in own]
    return QualityModel(*_dictionaries(rows), tuple(logistic.fit(np.concatenate(x), y)))


def _dictionaries(rows) -> list[bytes]:
    """Of good and of bad text, from amounts of text that do not differ too much."""
    texts = {k: [(r.text or "").encode("utf-8", "surrogatepass") for r in rows if r.label == k] for k in (0, 1)}
    few = min(sum(map(len, texts[0])), sum(map(len, texts[1])))
    return [build_dictionary(_of_bytes(texts[k], max(4 * few, 1 << 20))) for k in (1, 0)]


def _of_bytes(texts: list[bytes], most: int) -> list[bytes]:
    out, total = [], 0
    for t in texts:
        if total < most:
            out.append(t)
            total += len(t)
    return out


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with a column quality_score in 0..1, for every row. Null and empty texts are scored as empty."""
    names = [c for c in docs.columns if c != "quality_score"]
    fields = docs.select(*names).schema
    weights = np.array(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad))

    def run(batches):
        found = compressors(*shared.value)
        for b in batches:
            got = logistic.predict(weights, features(b.column(names.index("text")).to_pylist(), found))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*names, "quality_score"])

    return docs.select(*names).mapInArrow(run, StructType([*fields.fields, StructField("quality_score", DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The pipeline's stage: all columns of the documents whose score reaches the threshold."""
    return score(docs, fit(docs, labels)).where(F.col("quality_score") >= threshold).drop("quality_score")


def op6_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    found = score(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"),
    )
