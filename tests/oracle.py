"""Runs a query in Spark and its SQL in DuckDB and compares the rows, order aside."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def compare(spark, folder, name, plan, sql, con):
    """None if the rows agree and the plan has no cross join and no Python per row, else a message."""
    df = plan(spark, folder)
    physical = df._jdf.queryExecution().executedPlan().toString()
    found = [x for x in UNWANTED if x in physical]
    if found:
        return f"plan holds {found}"
    got = _rows(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = _rows(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; {[g for g in got if g not in set(want)][:2]} {[w for w in want if w not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {str(bad[0])[:600]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from grainmill.session import build_session

    folder = argv[0]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans, sqls = entry.queries(), entry.oracle_sql()
    argv = list(argv)
    if "--large" in argv:  # treat every table as too large to broadcast or to sort in one task
        argv.remove("--large")
        spark.conf.set("grainmill.broadcast.bytes", "0")
        spark.conf.set("grainmill.task.rows", "0")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
    names = argv[1:] or list(plans)
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, folder, name, plans[name], sqls.get(name), con)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
