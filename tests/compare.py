"""Run registered queries against DuckDB on the same tables and compare them as row multisets."""

from __future__ import annotations

import math
import sys
import time
import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else float(repr(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    left = multiset(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = multiset([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} <> {right[0]}", 0
    only_left, only_right = left[1] - right[1], right[1] - left[1]
    n = sum(left[1].values())
    if only_left or only_right:
        return (f"rows {n} vs {sum(right[1].values())}; only spark {sum(only_left.values())} {list(only_left)[:2]}; "
                f"only sql {sum(only_right.values())} {list(only_right)[:2]}"), n
    return None, n


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pagemill.session import build

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build("compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem, n = differences(spark, con, sf_dir, query, oracle[name])
            else:
                problem, n = None, query(spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {n:8d} {'sql ' if name in oracle else 'rows'} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
