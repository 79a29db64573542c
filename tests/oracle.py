"""Runs registered queries and their SQL twins side by side.

    python -m tests.oracle [-d FOLDER] [NAME ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


EXACT = False  # compare doubles bit by bit


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) and EXACT:
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}" if abs(value) < 1e6 else f"{value:.3f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


def compare(spark, con, folder, name, job, sql):
    """Differences as text, empty when the results agree."""
    df = job(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if df.columns else "no columns"
    ref = con.sql(sql)
    expected = rows_of(ref.columns, ref.fetchall())
    if sorted(df.columns) != sorted(ref.columns):
        return f"columns {sorted(df.columns)} / {sorted(ref.columns)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    sql_types = {c: KINDS.get(str(t), str(t)) for c, t in zip(ref.columns, ref.types)}
    if spark_types != sql_types:
        return "types " + str({c: (spark_types[c], sql_types[c]) for c in spark_types if spark_types[c] != sql_types[c]})
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    if bad:
        return f"{len(bad)} rows differ, first:\n   {str(bad[0][0])[:600]}\n   {str(bad[0][1])[:600]}"
    return "" if got else "no rows"


def main():
    import __spark_entry__ as entry
    from revlens.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("--plain", action="store_true", help="a session without the package's settings")
    parser.add_argument("--exact", action="store_true", help="compare doubles bit by bit")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    global EXACT
    EXACT = args.exact
    if args.plain:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "UTC").config(
            "spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    else:
        spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                             "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.d)
    jobs, sqls = entry.queries(), entry.oracle_sql()
    wanted = [n for n in jobs if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            diff = compare(spark, con, args.d, name, jobs[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(diff)
        mark = "FAIL " + diff if diff else "ok" if name in sqls else "ok (rows only)"
        print(f"{name:28s} {time.time() - start:6.2f}s {mark}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    spark.stop()
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
