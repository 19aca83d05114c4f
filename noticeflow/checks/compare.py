"""Run queries and their oracle side by side: `python -m noticeflow.checks.compare DIR [name ...]`."""

import math
import sys
import tempfile
import time

from noticeflow.checks.queries import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores="8"):
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("noticeflow")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _key(row):
    return [("~",) if v is None else (str(type(v).__name__), v) for v in row]


def _plain(v):
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


def oracle_rows(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def compare(spark, sf_dir, name):
    """None when equal, else a description of the difference."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return None
    want = oracle_rows(sf_dir, ORACLE[name])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(args):
    spark = session()
    names = args[1:] or list(QUERIES)
    failed = 0
    for name in names:
        start = time.time()
        try:
            diff = compare(spark, args[0], name)
        except Exception as e:  # noqa: BLE001 - report every query
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += diff is not None
        print(f"{name:24s} {time.time() - start:6.1f}s {'ok' if diff is None else diff}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
