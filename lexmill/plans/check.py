"""Compares registered queries with their SQL on a test data folder: ``python -m lexmill.plans.check FOLDER [NAME...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: round(v, 5) if isinstance(v, float) else v
    return Counter(tuple(flat(r[i]) for i in order) for r in rows)


def differences(spark, folder: str, names: list[str], queries: dict, sql: dict):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in names:
        begun = time.time()
        try:
            df = queries[name](spark, folder)
            mine = rows_of(df.columns, df.collect())
        except Exception as e:
            yield name, time.time() - begun, 0, False, [f"Spark: {str(e)[:300]}"]
            continue
        took = time.time() - begun
        if name not in sql:
            yield name, took, sum(mine.values()), None, []
            continue
        try:
            got = con.execute(sql[name])
        except duckdb.Error as e:
            yield name, took, 0, False, [f"SQL: {str(e)[:300]}"]
            continue
        theirs = rows_of([d[0] for d in got.description], got.fetchall())
        odd = [f"columns {sorted(df.columns)} {sorted(d[0] for d in got.description)}"] if sorted(df.columns) != sorted(d[0] for d in got.description) else []
        odd += [f"mine {r}" for r in list((mine - theirs).elements())[:2]] + [f"sql {r}" for r in list((theirs - mine).elements())[:2]]
        yield name, took, sum(mine.values()), not odd, odd


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from lexmill.plans import queries as q

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name, took, n, same, odd in differences(spark, sys.argv[1], sys.argv[2:] or list(q.QUERIES), q.QUERIES, q.SQL):
        print(f"{name} {took:.1f} s {n} rows {'no SQL' if same is None else 'same' if same else 'DIFFERENT'}", *odd, sep="\n    ", flush=True)
