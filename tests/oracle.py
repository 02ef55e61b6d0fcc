"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}" if abs(value) > 5e-7 else "0.000000"
    return str(value)


timing: dict[str, float] = {}

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(df, con, sql: str) -> str:
    """Empty if the results agree, otherwise what differs."""
    names = sorted(df.columns)
    spark_rows = sorted(tuple(normal(r[n]) for n in names) for r in df.collect())
    timing["spark"] = time.time()
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    got = sorted(kinds)
    if got != names:
        return f"columns {names} against {got}"
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} against {kinds[name]}"
    order = [list(kinds).index(n) for n in names]
    sql_rows = sorted(tuple(normal(r[i]) for i in order) for r in result.fetchall())
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows against {len(sql_rows)}"
    wrong = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(sql_rows)} rows differ, first {str(wrong[0])[:600]}"
    return ""


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if not problem else f"DIFFERS {problem}"
            else:
                note = f"rows only: {df.count()}"
                problem = ""
        except Exception as failure:  # keep going over the other queries
            problem = note = f"FAILED {type(failure).__name__}: {str(failure)[:900]}"
        bad += bool(problem)
        end = time.time()
        spark_end = timing.pop("spark", end)
        print(f"{name:28} {spark_end - start:6.1f}s +{end - spark_end:5.1f}s  {note}", flush=True)
    print(f"{bad} bad of {len(queries)}, {len(oracles)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
