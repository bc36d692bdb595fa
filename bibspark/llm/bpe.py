"""Operator 3, BPE encoding and decoding in batched numpy merge rounds.

Symbols of many words stand in one flat array. In each round the rank of every adjacent pair is found by binary search
over the sorted pair keys, each word's lowest rank is taken, and all its occurrences (left to right, not overlapping)
are merged at once. Since a merge's result occurs only in later merges, this equals merging one pair at a time.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import batch, bounded_batches, read_table

WORDS_KEPT = 120_000  # encoded words a Python worker remembers; when full, only those of the batch at hand stay
NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b if b in own else 256 + n))
        n += b not in own
    return out


def newer_letters(path: str) -> tuple[dict[int, str], dict[int, str]]:
    """What the tokenizers library, for this file, takes otherwise than Python and `regex`, whose Unicode versions differ.

    Lower case of capitals that Python does not know; and for letters and numbers that only one of the two knows a sign of
    the class that the library puts them in."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    every = [*map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000)))]
    low = {}
    if t.normalizer is not None:
        letters = [c for c in every if not c.isspace() and c != "Σ" and unicodedata.normalize("NFC", c) == c]
        low = {ord(c): x for c in letters if (x := t.normalizer.normalize_str(c)) != c.lower()}
    count = lambda s: len(t.pre_tokenizer.pre_tokenize_str(s))
    letter, number, signs = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), {}
    later = [c for c in map(chr, range(0x20000, 0x34000)) if letter.match(c)]
    for c in every + later:
        if unicodedata.category(c) == "Cn":  # assigned after Python's version
            own = "a" if letter.match(c) else "1" if number.match(c) else "\ue000"
            is_now = "1" if count(c + c) == 2 else "a" if count("a" + c) == 1 else "\ue000"
            if own != is_now:
                signs[ord(c)] = is_now
    return low, signs


class WordBpe:
    """A tokenizer file with a word-end suffix: NFC, white space and case folding, split pattern, byte letters, merges."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.tokens = [""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in col], np.int64) for col in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = (left << 20) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], np.arange(len(key))[order], made
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.capitals, self.signs = newer_letters(path)
        self.odd, self.newest = frozenset(map(chr, self.signs)), frozenset(map(chr, self.capitals))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known = self.specials()

    def specials(self) -> dict[str, tuple[str, str, bytes]]:
        """Words that are known so far: ids as decimal text, decoded text, ids as int32 bytes."""
        return {s: (str(i), s, np.int32(i).tobytes()) for s, i in self.special.items()}

    def pieces(self, text: str | None) -> list[str]:
        """Words of the split pattern; special tokens stay whole, as themselves."""
        if not text:
            return []
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text) if "<|" in text else [text]):
            if i % 2:
                out.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    if not self.newest.isdisjoint(set(part)):
                        part = part.translate(self.capitals)
                part = part.lower()
                if not part.isascii() and not self.odd.isdisjoint(set(part)):
                    out += [part[m.start() : m.end()] for m in self.split.finditer(part.translate(self.signs))]
                else:
                    out += self.split.findall(part)
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of ids of each."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw)), size)
        done_sym, done_word = [], []
        while len(sym):
            key = (sym[:-1] << 20) | sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            low = np.repeat(lowest, size)
            over = low == NONE  # words with nothing left to merge
            done_sym.append(sym[over])
            done_word.append(word[over])
            hit = (rank == low) & ~over
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])  # in runs of overlapping hits every second one counts
            at_run = np.repeat(run, np.diff(np.r_[run, len(hit)])) if len(run) else np.zeros(0, np.int64)
            first = run[0] if len(run) else len(hit)
            odd = np.zeros(len(hit), bool)
            odd[first:] = (np.arange(first, len(hit)) - at_run) % 2 == 1
            hit &= ~odd
            sym = np.where(hit, self.made[np.where(hit, rank, 0)], sym)
            stay = ~over & ~np.r_[False, hit[:-1]]
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate([np.zeros(0, np.int64), *done_sym]), np.concatenate([np.zeros(0, np.int64), *done_word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(raw))

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids (as decimal text) and the decoded text of words."""
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known = self.specials() | {p: self.known[p] for p in pieces if p in self.known}
        for i in range(0, len(fresh), 100_000):
            part = fresh[i : i + 100_000]
            ids, n = self.encode_words(part)
            at = 0
            all_ids, raw = ids.tolist(), ids.astype(np.int32).tobytes()
            for p, k in zip(part, n.tolist(), strict=True):
                own = all_ids[at : at + k]
                self.known[p] = (" ".join(map(str, own)), self.decode(own), raw[4 * at : 4 * (at + k)])
                at += k

    def decode(self, ids) -> str:
        """Token texts joined by one space; ids outside the vocabulary are left out."""
        return " ".join([self.tokens[i] for i in ids if 0 <= i < len(self.tokens)])

    def known_rows(self, texts: list[str | None]) -> list[list[tuple[str, str, bytes]]]:
        """The remembered words of each text, in order."""
        rows = [self.pieces(t) for t in texts]
        self.learn(set().union(*rows))
        return [[self.known[p] for p in row] for row in rows]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [ids_of(row) for row in self.known_rows(texts)]

    def digest_rows(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of the decoded text of each text."""
        out = []
        for row in self.known_rows(texts):
            ids = " ".join([x[0] for x in row])
            out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), decoded_digest(row)))
        return out


def ids_of(row: list[tuple[str, str, bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join([x[2] for x in row]), np.int32)


def decoded_digest(row: list[tuple[str, str, bytes]]) -> str:
    return hashlib.sha256(" ".join([x[1] for x in row]).encode("utf-8", "surrogatepass")).hexdigest()


@functools.lru_cache(2)
def tokenizer(path: str) -> WordBpe:
    """One per Python worker and file."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return os.environ.get("BPE_FILE") or public_tokenizers.path("word_bpe_49k.json")


def id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *rows]))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text). Null and empty texts have no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                yield batch(schema, b.column(0)[i : i + 256], id_lists(tokenizer(path).encode(b.column(1)[i : i + 256].to_pylist())))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of ids (doc_id, ids). Null ids: empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            yield batch(schema, b.column(0), [tokenizer(path).decode(x or []) for x in b.column(1).to_pylist()])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of what encode() and decode() give, row by row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                texts = b.column(1)[i : i + 512].to_pylist()
                rows = bpe.digest_rows(texts)
                yield batch(schema, b.column(0)[i : i + 512], *zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """The pipeline's last stage: (doc_id, n_tokens, ids, decoded_sha256) of every row of docs."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = bpe.known_rows(b.column(1)[i : i + 256].to_pylist())
                ids = [ids_of(row) for row in rows]
                yield batch(schema, b.column(0)[i : i + 256], list(map(len, ids)), id_lists(ids), [decoded_digest(row) for row in rows])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def op3_bpe(spark, sf_dir):
    return encoded_digests(read_table(spark, sf_dir, "documents"), default_path())
