import duckdb

from holdfast.llm import queries

SF = "/root/testdata/sf0.001"


def test_sql_gives_the_same_rows(spark):
    for name, sql in queries.oracle_sql().items():
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.description]
        got = getattr(queries, name)(spark, SF).select(names).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
