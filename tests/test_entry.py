import duckdb
import pytest

import __spark_entry__ as entry_module
from cairn.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name not in ORACLE:
        assert got and all(r[columns.index(c)] for r in got for c in ("crc_ok", "intact") if c in columns)
        return
    con = duck.execute(ORACLE[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    assert got == plain(tuple(r[names.index(c)] for c in columns) for r in con.fetchall())


def test_reassemble_check_of_odd_rows(spark, tmp_path):
    """Empty and null texts, keys that come again with other texts or the same, null keys."""
    long = [(7, ("%d " * 9_000) % tuple(range(k, k + 9_000)), "a") for k in (0, 5)]
    rows = [(1, "", "a"), (2, None, "a"), (3, "one", "a"), (3, "other", "a"), (3, "", "a"), (3, None, "a"), (4, "same", "b"), (4, "same", "b"), (None, "x", None), (None, "y", None), *long]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["reassemble_check"](spark, str(tmp_path)).select("snapshot", "path", "digest").collect()
    assert plain(got) == plain(con.execute(ORACLE["reassemble_check"]).fetchall()) and len(got) == len(rows)


def test_known_counts(spark):
    r = QUERIES["dedup_ratio"](spark, SF).first()
    assert (r.refs, r.objects, r.logical_bytes, r.unique_bytes) == (217, 206, 495892, 466449)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 20
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
