"""Run registered queries beside their SQL twins: python -m tests.compare SF_DIR [NAME...]"""

import glob
import math
import os
import sys
import time

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def differences(spark, con, run, sql, sf_dir):
    """Rows of one side only: (spark's, SQL's), as many as five each."""
    df = run(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return df.columns, rel.columns
    names = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    at = [rel.columns.index(c) for c in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
    mine, theirs = order(mine), order(theirs)
    if mine == theirs:
        return None
    from collections import Counter

    a, b = Counter(mine), Counter(theirs)
    return len(mine), len(theirs), list((a - b).elements())[:3], list((b - a).elements())[:3]


def main(sf_dir, *wanted):
    from pyspark.sql import SparkSession

    from wayfind import catalog

    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = duck(sf_dir), catalog.oracle_sql()
    for name, run in catalog.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            bad = differences(spark, con, run, oracle[name], sf_dir) if name in oracle else ("no SQL", run(spark, sf_dir).count())
        except Exception as fault:  # noqa: BLE001
            bad = f"{type(fault).__name__}: {str(fault)[:600]}"
        print(f"{name}: {'ok' if bad is None else bad} {time.time() - start:.1f} s", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
