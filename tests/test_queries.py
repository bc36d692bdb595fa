"""Every registered query of the reference's operators against its DuckDB oracle, over whole tables."""

import os

import duckdb
import pytest

from bibspark import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_packets_of_repeated_ids(spark, tmp_path, monkeypatch):
    """Records of one id meet their own packets, in whichever order packets are read."""
    from bibspark.plans import family_queries

    parts = spark.range(600).selectExpr("id as p_partkey", "concat('name ', id) as p_name", "concat('Brand#', id % 7) as p_brand", "'SMALL' as p_type", "cast(id % 50 as int) as p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    read = family_queries.jsons.read_packet
    monkeypatch.setattr(family_queries.jsons, "read_packet", lambda files: read(files).orderBy("title", ascending=False))
    assert registry.QUERIES["roundtrip_differences"](spark, str(tmp_path)).count() == 0
