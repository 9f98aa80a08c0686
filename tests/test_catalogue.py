import glob
import os

import duckdb
import pytest

from vectrail.plans import catalogue


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda r: repr(tuple(r))
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["hnsw_filtered", "hnsw_knn", "ivfpq_trained"])
def test_searches_without_sql_ask_every_twentieth_row(spark, sf_dir, name):
    every = {r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 20 = 0").select("vec_id").collect()}
    assert {r["q_id"] for r in catalogue.queries()[name](spark, sf_dir).collect()} == every and len(every) > 20


def test_lateral_search_equals_its_sql_on_odd_vectors(spark, tmp_path, monkeypatch):
    """Null, infinite and repeated vectors, repeated ids and few distances at once."""
    import random

    import pyarrow as pa
    import pyarrow.parquet

    from vectrail.operators import kernels

    monkeypatch.setattr(kernels, "PAIRS", 500)
    rng = random.Random(3)
    rows = [[rng.randint(0, 3) / 2 for _ in range(6)] for _ in range(300)]
    ids = [*range(298), 40, 60]
    rows[0], rows[20], rows[21], rows[60] = None, [float("inf"), *rows[20][1:]], [float("inf"), *rows[21][1:]], None
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([1] * 300, pa.int32())})
    pa.parquet.write_table(table, tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    df = catalogue.queries()["knn_lateral"](spark, str(tmp_path))
    key = lambda r: repr(tuple(r))
    got = sorted(map(tuple, df.collect()), key=key)
    assert len(got) == 3 * 17 and got == sorted(c.sql(catalogue.oracle_sql()["knn_lateral"]).fetchall(), key=key)


def test_lateral_search_takes_few_rows_from_each_task(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = catalogue.queries()["knn_lateral"](spark, sf_dir)
    near, asked = spark.table("vr_near"), rows.filter("vec_id % 20 = 0").count()
    assert found.count() == 3 * asked <= near.count() <= 3 * asked * rows.rdd.getNumPartitions()
