"""Registered queries against their SQL on the smallest tables, and the pipeline."""

import duckdb
import pytest

from tessella.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA).select(*columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.count() < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "bpe encoding"]
