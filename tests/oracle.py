"""A query's rows beside those of its SQL in DuckDB."""

import os

import duckdb


def tables(sf_dir):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return db


def plain(rows, names, order):
    def value(x):
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(value(dict(zip(names, r))[n]) for n in order) for r in rows)


def same(spark_rows, sql, sf_dir):
    """Whether a DataFrame and a query agree in columns and rows, in any order."""
    db = tables(sf_dir)
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(spark_rows.columns)
    want = plain(cursor.fetchall(), names, sorted(names))
    got = plain([tuple(r) for r in spark_rows.collect()], spark_rows.columns, sorted(names))
    assert got == want
