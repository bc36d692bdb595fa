"""Canonical row encoding and digests that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoded(*values: Column | str) -> Column:
    """Values as one text that no other values give: each with its length before it, a dash alone for null."""
    text = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text])


def row_text(columns: list[str]) -> Column:
    """Columns by name, encoded."""
    return encoded(*sorted(columns))


def row_digest(columns: list[str]) -> Column:
    return F.sha2(row_text(columns), 256)


def multiset_digest(digests: Column) -> Column:
    """An aggregate: the digest of the number of digests and of the sums of their four quarters.

    Sums are added map-side and in any order, so a table of any size needs no group and no sort."""
    quarter = lambda i: F.coalesce(F.sum(F.conv(F.substring(digests, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return F.sha2(F.concat_ws(":", F.count(digests).cast("string"), *map(quarter, range(4))), 256)


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, digest): the digest of a table as a multiset of rows."""
    return rows.select(row_digest(columns).alias("d")).agg(F.count("*").alias("rows"), multiset_digest(F.col("d")).alias("digest"))


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON with its columns in order and nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def seal(columns: list[str]) -> Column:
    """Digest that binds a record: of its canonical JSON."""
    return F.sha2(canonical_json(columns), 256)
