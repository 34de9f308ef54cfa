"""Runs a registered query and its DuckDB twin and compares their rows."""

import duckdb

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    return sorted(tuple(str(v[c]) for c in columns) for v in values)


def agree(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = rows(columns, [r.asDict() for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(columns, [dict(zip(names, r)) for r in res.fetchall()])
    assert sorted(names) == columns
    assert got == want
    if not got and sf == SF:  # the smallest tables may hold nothing for it
        return agree(spark, query, sql, LARGER)
    assert got, "a query that finds nothing shows nothing"
