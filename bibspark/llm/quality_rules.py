"""Operator 13, quality rules by tokeniser fertility.

Two public vocabularies measure each text: a byte-level one its characters per token and the entropy of its tokens, one
with byte fallback the share of tokens that are single bytes (of WINDOW tokens more than the text has, so that one rare
sign in a short text is no share to speak of). A text is encoded word by word (both vocabularies keep a
word and the space before it together), and words seen before are remembered, so the libraries meet each word once a
worker. Entropy is that of windows of about WINDOW tokens that cover the whole text, as a share of the largest possible,
so that long and short texts compare.

Bands: of each language (texts without one: of each script) the quantiles LOW, 1/2 and HIGH over all texts that pass the
base rules, equal measures counted once, so that copies do not narrow them. A measure is rejected beyond LOW or HIGH by
more than WIDTH times their distance from the median, and by more than SLACK. Measures are rounded before, so a group's
quantiles are exact and its distinct values bounded.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import RAW, batch, finished, materialise, read_table, run_hashes, span_hashes, word_spans, written

LEAST_WORDS = 10
WINDOW_WORDS = 5
REPEATED = 20  # percent of the words, at most
SYMBOLS = b"#*$%&|<>"
WINDOW = 64
LOW, HIGH, WIDTH = 0.05, 0.95, 2.0
#: measure -> (digits, least distance below LOW and above HIGH; None: not rejected on that side)
SLACK = {"chars_per_token": (2, 0.25, 2.0), "fallback_share": (3, None, 0.1), "entropy": (3, 0.05, None)}
WORDS_KEPT = 200_000  # words a worker remembers; beyond them it begins anew
PART = 512  # texts measured at once
#: First code point of ranges of scripts, ascending.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]


def paths() -> tuple[str, str]:
    """The byte-level vocabulary and the one with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


UNSEEN = regex.compile(r"[\p{Z}\p{C}]")


def encoded(words: list[str], encode, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of words, and of each word how many: encoded as one text, in which each word has one token that opens it.

    Words of characters that encode() may drop or take for spaces are encoded one by one; a list whose openings do not
    match for another reason is halved."""
    odd = [UNSEEN.search(w) is not None for w in words]
    if len(words) > 1 and any(odd):
        parts = {i: encoded([w], encode, opens) for i, (w, x) in enumerate(zip(words, odd, strict=True)) if x}
        ids, n = encoded([w for w, x in zip(words, odd, strict=True) if not x], encode, opens)
        rest = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        own = [parts[i][0] if x else next(rest) for i, x in enumerate(odd)]
        return np.concatenate(own), np.array(list(map(len, own)), np.int64)
    ids = np.array(encode(" ".join(words)) if words else [], np.int64)
    at = np.flatnonzero(opens[ids])
    if len(at) == len(words) and (not len(ids) or len(at) and at[0] == 0):
        return ids, np.diff(np.r_[at, len(ids)])
    if len(words) < 2:
        return ids[: len(ids) * len(words)], np.full(len(words), len(ids), np.int64)
    half = len(words) // 2
    (a, m), (b, n) = encoded(words[:half], encode, opens), encoded(words[half:], encode, opens)
    return np.r_[a, b], np.r_[m, n]


class Fertility:
    """Of words: ids in the byte-level vocabulary, number of tokens and of byte tokens in the other."""

    def __init__(self, ranks: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.opens = np.zeros(max(table.values()) + 1, bool)
        self.opens[[i for t, i in table.items() if t.startswith(b" ")]] = True
        size = self.pieces.vocab_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(size)])
        self.piece_opens = np.array([self.pieces.id_to_piece(i).startswith("\u2581") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.n_ids, self.n_pieces, self.n_bytes = (np.zeros(0, np.int64) for _ in range(4))

    def slots(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Of each word of word_spans() the place of its counts."""
        kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slot) + len(kinds) > WORDS_KEPT:
            self.forget()
        keys = kinds.tolist()
        fresh = [k for k, x in enumerate(keys) if x not in self.slot]
        if fresh:
            words = [low[start[i] : stop[i]].tobytes().decode("utf-8", "replace") for i in first[fresh].tolist()]
            ids, n_ids = encoded(words, lambda t: self.bytes.encode_ordinary(f" {t}"), self.opens)
            pieces, n_pieces = encoded(words, self.pieces.encode, self.piece_opens)
            for k in fresh:
                self.slot[keys[k]] = len(self.slot)
            self.ids, self.n_ids = np.r_[self.ids, ids], np.r_[self.n_ids, n_ids]
            self.n_pieces, self.n_bytes = np.r_[self.n_pieces, n_pieces], np.r_[self.n_bytes, per_text(self.is_byte[pieces], n_pieces)]
        return np.array([self.slot[x] for x in keys], np.int64)[which]

    def tokens(self, slots: np.ndarray) -> np.ndarray:
        """Ids of words, flat."""
        n = self.n_ids[slots]
        first = (np.cumsum(self.n_ids) - self.n_ids)[slots]
        return self.ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@functools.lru_cache(2)
def fertility(ranks: str, pieces: str) -> Fertility:
    """One per Python worker and pair of files."""
    return Fertility(ranks, pieces)


def per_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of n values."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def repeated_words(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text the words in windows of WINDOW_WORDS words that stand in it twice or more (by 64-bit hashes)."""
    starts, size = np.cumsum(n) - n, np.maximum(n - WINDOW_WORDS + 1, 0)
    doc = np.repeat(np.arange(len(n)), size)
    at = starts[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    x = run_hashes(h, at, at + WINDOW_WORDS) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((x, doc))
    same = (x[order][1:] == x[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = at[order[np.r_[False, same] | np.r_[same, False]]] if len(at) else at
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW_WORDS, -1)
    return per_text((np.cumsum(change[:-1]) > 0).astype(np.int64), n)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def entropies(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text the mean over its windows of their tokens' entropy, as a share of the largest (0: under two tokens)."""
    many = np.maximum(n // WINDOW, 1)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    window = (np.cumsum(many) - many)[doc] + at * many[doc] // n[doc]
    size = np.bincount(window, minlength=many.sum())
    cells, count = np.unique(window * (1 << 20) + tokens, return_counts=True)
    own = cells >> 20
    bits = np.bincount(own, -count * np.log2(count / size[own]), minlength=len(size)) / np.maximum(size, 1)
    share = np.divide(bits, np.log2(np.maximum(size, 2)), out=np.zeros(len(size)), where=size > 1)
    return per_text(share, many) / many


def scripts(texts: list[str | None]) -> list[str]:
    """The commonest script of a text's letters above the ASCII signs (none: latin)."""
    edges, names = np.array([a for a, _ in SCRIPTS]), [b for _, b in SCRIPTS]
    out = []
    for t in texts:
        if not t or t.isascii():
            out.append("latin")
            continue
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = code[(code >= 0xC0) | ((code | 32) >= 0x61) & ((code | 32) <= 0x7A)]
        out.append(names[int(np.bincount(np.searchsorted(edges, code, "right") - 1).argmax())] if len(code) else "latin")
    return out


MEASURES = "doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, entropy double"


def measures(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """MEASURES of every row of docs (doc_id, lang, text): band is the language, or else the script."""
    schema = pa.schema([("doc_id", pa.int64()), ("band", pa.string()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")], *[(c, pa.float64()) for c in SLACK]])
    symbol = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))

    def run(batches):
        own = fertility(ranks, pieces)
        for b in batches:
            for i in range(0, b.num_rows, PART):
                ids, langs, column = (c[i : i + PART] for c in b.columns)
                texts = column.to_pylist()
                low, at, start, stop, n = word_spans(column, RAW)
                h = span_hashes(low, start, stop)
                sizes = np.diff(at)
                chars = per_text(((low & 0xC0) != 0x80) & (low != 32), sizes)
                slots = own.slots(low, start, stop, h)
                n_ids, n_pieces = per_text(own.n_ids[slots], n), per_text(own.n_pieces[slots], n)
                ratio = lambda x, y: np.divide(x, y, out=np.zeros(len(y)), where=y > 0)
                values = (ratio(chars, n_ids), per_text(own.n_bytes[slots], n) / (n_pieces + WINDOW), entropies(own.tokens(slots), n_ids))
                named = [f"language {x}" if x is not None else None for x in langs.to_pylist()]
                if None in named:
                    named = [x or f"script {y}" for x, y in zip(named, scripts(texts), strict=True)]
                yield batch(schema, ids, named, n, chars, per_text(symbol[low], sizes), [repeated_lines(t) for t in texts], repeated_words(h, n), n_ids, *[np.round(v, d) for v, (d, *_) in zip(values, SLACK.values(), strict=True)])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, MEASURES)


def bands(rows: DataFrame) -> DataFrame:
    """Measured rows -> (band, low_<measure>, high_<measure>): what a measure may be in each language or script."""
    kinds = rows.where("not base_failed").select("band", *SLACK).distinct()
    cuts = kinds.groupBy("band").agg(*[F.percentile(c, F.array(F.lit(LOW), F.lit(0.5), F.lit(HIGH))).alias(c) for c in SLACK])
    out = [F.col("band")]
    for c, (_, small, large) in SLACK.items():
        low, mid, high = (F.col(c)[k] for k in range(3))
        out.append((low - F.greatest(WIDTH * (mid - low), F.lit(small)) if small else F.lit(float("-inf"))).alias(f"low_{c}"))
        out.append((high + F.greatest(WIDTH * (high - mid), F.lit(large)) if large else F.lit(float("inf"))).alias(f"high_{c}"))
    return cuts.select(*out)


def judged(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """MEASURES of every row of docs (doc_id, lang, text) with base_failed, kept and rejected (the measures outside).

    Null texts are empty: no words, so base_failed, which is under LEAST_WORDS words or over REPEATED percent in
    repeated windows. kept is false for these and where a measure leaves the bands. Repeated rows and null ids stay;
    other columns are ignored; an empty table gives no row."""
    own = paths()
    rows = measures(docs, ranks or own[0], pieces or own[1])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rows = materialise(rows.withColumn("base_failed", failed), "measures")
    limits = materialise(bands(rows), "bands")
    joined = rows.join(limits, "band", "left")
    out = [F.when((F.col(c) < F.col(f"low_{c}")) | (F.col(c) > F.col(f"high_{c}")), F.lit(c)) for c in SLACK]
    joined = joined.withColumn("rejected", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*out))))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("rejected") == 0)).drop(*limits.columns[1:])


def keep_judged(docs: DataFrame) -> DataFrame:
    """All columns of the documents that the rules keep; rows of one doc_id are judged each, and stay if one of them is."""
    good = judged(docs).where("kept").select(F.col("doc_id").alias("good")).distinct()
    return docs.join(good, docs.doc_id.eqNullSafe(good.good), "left_semi")


def op13_rules(spark, sf_dir):
    before = written()
    rows = judged(read_table(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return finished(rows.select(*columns, "n_tokens", *SLACK, "rejected"), "rules", before)


def rules_base(spark, sf_dir):
    """The columns of op13_rules that SQL can express."""
    return op13_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, u.i, count(*) OVER (PARTITION BY doc_id, u.s) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: {'i': i, 's': array_to_string(w[i:i + 4], ' ')})) AS u FROM d)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM g WHERE n > 1) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
