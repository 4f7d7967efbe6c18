"""Every registered query that has a SQL twin against DuckDB, on the smallest tables that satisfy the views."""

import os

import duckdb
import pytest

from reelmill.plans import media_queries, ordered_queries  # noqa: F401
from reelmill.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.001")
#: The independent twins of the clocks need gaps under half a turn, as from sf0.01 on.
DENSE = {"unwrap_clock": "/root/testdata/sf0.01", "shared_epoch": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def duck():
    made = {}

    def at(sf):
        if sf not in made:
            made[sf] = duckdb.connect()
            for t in "events part lineitem pages".split():
                made[sf].execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        return made[sf]

    return at


def normal(rows, names):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    sf = DENSE.get(name, SF)
    df = QUERIES[name](spark, sf)
    got = normal(df.collect(), df.columns)
    cursor = duck(sf).execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == normal(cursor.fetchall(), names) and got


def test_manifest_files_are_bounded_and_violations_stay(spark, tmp_path):
    from reelmill.plans import media_queries as M

    part = spark.range(25_000).selectExpr("'Brand#12' as p_brand", "id as p_partkey", "id % 50 as p_size")
    part.write.parquet(f"{tmp_path}/sf/part.parquet")
    got = QUERIES["read_manifests"](spark, f"{tmp_path}/sf").collect()
    assert sorted((r.master_uri, r.ordinal, r.uri) for r in got) == [("Brand#12", i, f"v{i}.m3u8") for i in range(25_000)]
    view = M.V.bind(spark, f"{tmp_path}/sf", M.V.v_variants("spark")).filter("ordinal < 1002")
    M._written_masters(view, f"{tmp_path}/masters")
    rows = M._read_masters(spark, f"{tmp_path}/masters", max_bytes=1000).collect()
    assert sorted((r.ordinal, r.uri, r.violation) for r in rows if r.violation) == [(0, None, "playlist_too_large")]
    assert sorted((r.ordinal, r.uri) for r in rows if not r.violation) == [(1000, "v1000.m3u8"), (1001, "v1001.m3u8")]
