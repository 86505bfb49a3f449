"""Compare registered queries with their SQL: python tests/compare.py SF_DIR [query ...]"""

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keysieve.plans import oracle  # noqa: E402
from keysieve.plans.corpus import BASE_TABLES  # noqa: E402
from keysieve.plans.queries import registered  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(repr(tuple(row[n] for n in names)) for row in frame.collect())


def expected_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())


def differences(spark, con, sf_dir, name):
    """Empty when a query's rows equal its SQL's rows."""
    sql = oracle.statements().get(name)
    frame = registered()[name](spark, sf_dir)
    got = rows_of(frame)
    if sql is None:
        return [], len(got), None
    names, expected = expected_rows(con, sql)
    if names != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} against {names}"], len(got), len(expected)
    if got == expected:
        return [], len(got), len(expected)
    extra, missing = set(got) - set(expected), set(expected) - set(got)
    return ["got  " + (sorted(extra) or ["-"])[0], "want " + (sorted(missing) or ["-"])[0]], len(got), len(expected)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    folder, only = sys.argv[1], sys.argv[2:]
    connection = connect(folder)
    for query in registered():
        if only and query not in only:
            continue
        try:
            diff, n, m = differences(session, connection, folder, query)
            print("OK  " if not diff else "DIFF", query, n, m, flush=True)
            for line in diff:
                print("    ", line[:700], flush=True)
        except Exception as error:  # noqa: BLE001
            print("FAIL", query, str(error)[:600], flush=True)
