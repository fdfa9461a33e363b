"""Run registered queries against their SQL in DuckDB: ``python -m checks.compare [sf_dir] [name...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("clicktrail")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(map(repr, (tuple(r) for r in df.select(*names).collect())))


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    relation = con.sql(sql)
    names = sorted(relation.columns)
    rows = relation.select(*(duckdb.ColumnExpression(n) for n in names)).fetchall()
    return names, Counter(map(repr, rows))


def main() -> None:
    from checks import registry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(registry.queries())
    spark, con = session(), database(sf_dir)
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            names, got = spark_rows(registry.queries()[name](spark, sf_dir))
            took = time.time() - started
            want_names, want = sql_rows(con, registry.oracle_sql()[name])
            ok = names == want_names and got == want
            print(f"{'ok  ' if ok else 'DIFF'} {name} rows={sum(got.values())} sql={sum(want.values())} {took:.2f}s", flush=True)
            if not ok:
                print("   ", names, want_names, list((got - want).items())[:2], list((want - got).items())[:2])
        except Exception as e:
            ok = False
            print("FAIL", name, str(e)[:1500])
        bad += not ok
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
