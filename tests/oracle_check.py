"""Compare queries with their oracles: columns, types and all values, rows in any order.

Run as a script: ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import collections
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def session(cores: str = "8", partitions: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vigilog")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Generated methods above this size are never compiled by the JVM; below it they are.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="vigilog-check-"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def difference(spark, con, sf_dir: str, query, oracle: str) -> str | None:
    """None when the results are equal, else what differs."""
    df = query(spark, sf_dir)
    result = con.sql(oracle)
    mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    theirs = dict(zip(result.columns, map(str, result.types)))
    if mine != theirs:
        pairs = {c: (mine.get(c), theirs.get(c)) for c in {*mine, *theirs} if mine.get(c) != theirs.get(c)}
        return f"schema {pairs}"
    names = sorted(mine)
    rows = collections.Counter(tuple(r[c] for c in names) for r in df.collect())
    place = [result.columns.index(c) for c in names]
    wanted = collections.Counter(tuple(r[p] for p in place) for r in result.fetchall())
    if rows == wanted:
        return None
    extra, missing = rows - wanted, wanted - rows
    return (
        f"{sum(extra.values())} extra, {sum(missing.values())} missing of {sum(wanted.values())};"
        f" {names}\n   extra {sorted(map(str, extra))[:2]}\n   missing {sorted(map(str, missing))[:2]}"
    )


def main() -> None:
    from queryset import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    names = args[1:] or list(QUERIES)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                found = difference(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                found = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        kind = "oracle" if name in ORACLES else "rows"
        print(f"{'ok  ' if found is None else 'FAIL'} {name} ({kind}, {time.time() - start:.1f}s) {found or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")


if __name__ == "__main__":
    main()
