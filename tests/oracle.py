"""Runs queries beside their SQL on the given tables and compares the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) else value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (int, str)):
        return value
    if hasattr(value, "as_integer_ratio"):
        return canonical(float(value))
    return str(value)


def compare(spark, con, function, sql: str, folder: str) -> str | None:
    """None when the rows agree, else a short account of the difference."""
    df = function(spark, folder)
    names = sorted(df.columns)
    ours = Counter(tuple(canonical(row[n]) for n in names) for row in df.collect())
    cursor = con.execute(sql)
    found = [c[0] for c in cursor.description]
    if sorted(found) != names:
        return f"columns {names} != {sorted(found)}"
    order = [found.index(n) for n in names]
    theirs = Counter(tuple(canonical(row[i]) for i in order) for row in cursor.fetchall())
    if ours == theirs:
        return None
    left, right = list((ours - theirs).elements()), list((theirs - ours).elements())
    return (f"{sum(ours.values())} vs {sum(theirs.values())} rows, {len(left)} / {len(right)} differ on {names}:\n"
            f"    ours   {sorted(left, key=str)[:3]}\n    theirs {sorted(right, key=str)[:3]}")


def main(folder: str, pattern: str = "", hot: str = "") -> int:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from sliceweave.session import HOT_ROWS_CONF, local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if hot:
        spark.conf.set(HOT_ROWS_CONF, hot)
    con, failures = connect(folder), 0
    oracles = entry.oracle_sql()
    for name, function in entry.queries().items():
        if pattern and not any(part in name for part in pattern.split(",")):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, function, oracles[name], folder)
            else:
                problem = None if function(spark, folder).count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} {time.time() - start:6.2f}s{'' if name in oracles else ' (rows only)'}"
              + (f"\n  {problem}" if problem else ""), flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(min(1, main(*sys.argv[1:])))
