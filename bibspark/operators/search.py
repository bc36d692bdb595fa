"""Substring search through an inverted index of character trigrams.

Postings (gram, id) are sorted by gram into Parquet files, so a search reads the row groups of a few grams and no other
part of the catalog. What the postings leave is verified on the records themselves, so results are those of a full scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
RAREST = 4  # grams of a query whose postings are read


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case."""

    def of(low: Column) -> Column:
        n = F.length(low)
        return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(low, i, GRAM)))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.lower(text)), of), F.lit(0))  # the text is made once, not once a gram


def haystack() -> Column:
    """What a catalog search looks at: id, title, creators and identifier values."""
    return F.lower(F.concat_ws(" ", "id", "title", F.array_join("creators", " "), F.array_join(F.transform("identifiers", lambda i: i["value"]), " ")))


def build_index(records: DataFrame, path: str, text: Column | None = None, key: str = "id") -> None:
    """Write the postings of records to path/postings, and how many each gram has to path/counts.

    The postings of a frequent gram are dealt over several files (by key within the gram)."""
    rows = records.select(F.col(key).alias("key"), F.explode(grams(haystack() if text is None else text)).alias("gram"))
    rows.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(f"{path}/postings")
    kept = records.sparkSession.read.parquet(f"{path}/postings")
    kept.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def candidates(records: DataFrame, path: str, query: str) -> DataFrame | None:
    """(key) of records that hold the query's rarest grams; None for queries shorter than a gram.

    The driver reads one count for each gram of the query, and then joins the postings of at most RAREST of them."""
    spark, low = records.sparkSession, query.lower()
    own = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not own:
        return None
    known = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(*own)).collect()}
    rare = sorted(own, key=lambda g: (known.get(g, 0), g))[:RAREST]
    postings = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(*rare))
    return postings.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare)).select("key")


def indexed_search(records: DataFrame, path: str, query: str, fmt: str | None = None, text: Column | None = None, key: str = "id") -> DataFrame:
    """Records of a format whose text holds the query in any case, by way of the index at path; the rows of lists.search().

    Queries shorter than a gram scan. Records that came after the index was built are not found."""
    hay = haystack() if text is None else text
    rows = records.where(F.col("format") == fmt) if fmt else records
    found = candidates(records, path, query)
    if found is not None:
        rows = rows.join(found.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi")
    return rows.where(F.lower(hay).contains(query.lower()))
