"""Rows of Spark and DuckDB in one comparable form."""

import datetime

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, datetime.datetime):
        v = v.date() if (v.hour, v.minute, v.second) == (0, 0, 0) else v
    return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def same(spark_df, con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(spark_df.columns)
    theirs = rows_of(columns, cursor.fetchall())
    assert rows_of(spark_df.columns, spark_df.collect()) == theirs
    return len(theirs)
