"""Operator 9, benchmark decontamination: size-partitioned MinHash containment search. DataFrame functions only.

The minima of a test item's hashed shingles are a uniform sample of them, so the share of an item's signature that
occurs anywhere in a document estimates the containment of the item in it, however long the document is. An item of n
shingles that is contained to PERCENT misses at most (100 - PERCENT) % of them, so of a signature that is longer than
that by MARGIN at least MARGIN hashes occur: candidates need so many hits, and none is missed. Items are partitioned by
size; a partition's bounds are its smallest size (documents with too few shingles for it need not be searched) and its
largest signature value (larger document hashes need no look-up). Candidates are verified by exact containment of their
shingles. Words are split at ASCII white space after lower-casing A-Z.

An item of fewer than WORDS words is one shingle of all its words, found wherever they stand in a row in a document.

The join picks its own side to broadcast by the real size of the written signature table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import finished, materialise, read_table, written

WORDS = 5
PERCENT = 80  # least containment
MARGIN = 4


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, r"[\x09-\x0D\x20]+"), "")


def _windows(words: Column, made, length: int = WORDS) -> Column:
    """made(list of word columns) of each `length` consecutive words; none where there are fewer."""
    n = F.size(words)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), lambda i: made([words[i + k] for k in range(length)]))).otherwise(F.array())


def _hashed(w: list[Column]) -> Column:
    return F.xxhash64(*w)


def _spelt(w: list[Column]) -> Column:
    return F.concat_ws(" ", *w)


def item_shingles(words: Column, made) -> Column:
    """Shingles of a test item; fewer words: the whole sequence; none: no shingle."""
    out = _windows(words, made)
    for k in range(1, WORDS):
        out = F.when(F.size(words) == k, _windows(words, made, k)).otherwise(out)
    return out


def document_shingles(words: Column, made, short: list[int]) -> Column:
    """Shingles of a document, and its runs of the numbers of words that short test items have."""
    return F.concat(*[_windows(words, made, k) for k in (WORDS, *short)])


def short_lengths(items: DataFrame) -> list[int]:
    """The numbers of words, below WORDS, of items: at most WORDS - 1 values."""
    n = F.size(words_of(F.col("text")))
    return sorted(r.n for r in items.where("item_id is not null").select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < WORDS)).distinct().collect())


def signatures(items: DataFrame) -> DataFrame:
    """(item_id, part, need, least, most, hash) rows: the smallest hashes of each item, how many of them a candidate has,
    and its partition's bounds.

    An item's rows are taken together; null texts and texts without a word have no signature; null ids are left out."""
    hashed = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).select("item_id", F.explode(item_shingles(F.col("w"), _hashed)).alias("hash"))
    sets = hashed.groupBy("item_id").agg(F.array_sort(F.collect_set("hash")).alias("all"))
    lost = F.floor(F.size("all") * (100 - PERCENT) / 100).cast("int")
    sized = sets.select("item_id", F.size("all").alias("n"), F.floor(F.log2(F.size("all").cast("double"))).cast("int").alias("part"), lost.alias("lost"), F.slice("all", 1, lost + MARGIN).alias("signature"))
    sized = materialise(sized, "signatures")
    bounds = sized.groupBy("part").agg(F.max(F.element_at("signature", -1)).alias("most"), F.min("n").alias("least"))
    return materialise(sized.join(bounds, "part").select("item_id", "part", (F.size("signature") - F.col("lost")).alias("need"), "least", "most", F.explode("signature").alias("hash")), "signature")


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(doc_id, value): a generator of one row, so that what refers to the value does not compute it again."""
    return rows.select("doc_id", F.explode(F.array(value)).alias(name))


def candidates(docs: DataFrame, signature: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, item_id) with enough hits of the item's signature in the document's shingles."""
    bounds = [(r.least, r.most) for r in signature.select("part", "least", "most").distinct().orderBy("least").collect()]  # one row a partition
    hashes = document_shingles(F.col("w"), _hashed, short)
    # a document of m shingles meets the partitions whose smallest item it can contain, and of these the largest bound
    limit, largest = F.lit(None).cast("long"), None
    for least, most in bounds:
        largest = most if largest is None else max(largest, most)
        limit = F.when(100 * F.size("all") >= PERCENT * least, F.lit(largest)).otherwise(limit)
    rows = _once(_once(docs, words_of(F.col("text")), "w"), hashes, "all").select("doc_id", "all", limit.alias("limit")).where("limit is not null")
    found = rows.select("doc_id", F.explode("all").alias("hash"), "limit").where("hash <= limit").drop("limit")
    hits = found.join(signature.select("hash", "item_id", "need", "most"), "hash").select("doc_id", "item_id", "need", "hash").distinct()
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("doc_id", "item_id")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of all pairs with containment >= 0.8.

    docs (doc_id, text) and items (item_id, text); other columns are ignored. Rows of one id are taken together (repeated
    rows count once); rows with a null id are left out; null and empty texts hold nothing. Items of fewer than five words
    are found wherever their words stand in a row."""
    before = written()
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    items = items.where("item_id is not null").select("item_id", "text")
    short = short_lengths(items)
    found = materialise(candidates(docs, signatures(items), short), "candidates")
    wanted = items.select("item_id", F.explode(item_shingles(words_of(F.col("text")), _spelt)).alias("s")).groupBy("item_id").agg(F.collect_set("s").alias("item"))
    wanted = materialise(wanted, "items")
    texts = docs.join(found, "doc_id").join(wanted, "item_id")
    shared = F.array_intersect(F.col("item"), document_shingles(F.col("w"), _spelt, short))
    rows = texts.select("doc_id", "item_id", F.size("item").alias("n_item"), words_of(F.col("text")).alias("w"), "item").select("doc_id", "item_id", "n_item", shared.alias("shared"))
    whole = rows.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("n_shared"))
    out = whole.where(100 * F.col("n_shared") >= PERCENT * F.col("n_item")).select("doc_id", "item_id", F.col("n_shared").cast("long"), F.col("n_item").cast("long"), (F.col("n_shared") / F.col("n_item")).alias("containment"))
    return finished(out, "contaminated", before)


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The pipeline's stage: all columns of the documents that hold no item. Rows with a null doc_id stay."""
    gone = contaminated(docs, items).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def op9_decontaminate(spark, sf_dir):
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), tests AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), lengths AS (
  SELECT DISTINCT least(len(w), 5) AS k FROM tests WHERE len(w) > 0 UNION SELECT 5
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k)
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM tests WHERE len(w) > 0)
), sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id)
SELECT d.doc_id, i.item_id, count(*) AS n_shared, any_value(z.n_item) AS n_item, count(*) / any_value(z.n_item)::DOUBLE AS containment
FROM doc_shingles d JOIN item_shingles i ON d.s = i.s JOIN sizes z ON i.item_id = z.item_id
GROUP BY d.doc_id, i.item_id HAVING 100 * count(*) >= 80 * any_value(z.n_item)
"""
