"""Runs registered queries against their SQL: python tests/oracle.py [query...]."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql)


def compare(spark, name, call, sql, sf_dir):
    """A message if the query's rows differ from the SQL's, else an empty one."""
    got = call(spark, sf_dir)
    rel = expected(sql, sf_dir)
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {got.columns} against {rel.columns}"
    cols = sorted(got.columns)
    norm = lambda r: tuple("null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    have = sorted(norm(tuple(r[c] for c in cols)) for r in got.collect())
    want = sorted(norm(r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    if have == want:
        return ""
    odd = next(((a, b) for a, b in zip(have, want) if a != b), None)
    return f"{len(have)} rows against {len(want)}; first difference {odd}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or list(sqls):
        t = time.time()
        try:
            said = compare(spark, name, queries[name], sqls[name], sf_dir) if name in sqls else f"no SQL, {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:600]
        print(name, f"{time.time() - t:.1f}s", said or "ok", flush=True)
