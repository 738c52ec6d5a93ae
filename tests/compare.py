"""Run registered queries next to their SQL: ``python -m tests.compare [prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from graphloom.plans import catalog
from graphloom.session import get_spark, local_checkpoints

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if hasattr(value, "asDict"):
        return str({k: cell(v) for k, v in value.asDict().items()})
    if isinstance(value, (list, tuple)):
        return str([cell(v) for v in value])
    return str(value)


def kind(t: str) -> str:
    """Coarse type name shared by both engines."""
    t = t.lower()
    for name, group in {
        "int": ("bigint", "integer", "int", "long", "smallint", "tinyint"), "str": ("string", "varchar"),
        "float": ("double", "float"), "bool": ("boolean",),
    }.items():
        if t in group:
            return name
    return t


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(str, (cell(r[c]) for c in cols))) for r in df.collect())
    took = time.time() - start
    sql = catalog.ORACLES.get(name)
    if sql is None:
        return True, f"rows={len(mine)} no sql {took:.1f}s"
    start = time.time()
    res = con.execute(sql)
    theirs_cols = [d[0] for d in res.description]
    theirs_types = {d[0]: str(d[1]) for d in res.description}
    raw = res.fetchall()
    if sorted(theirs_cols) != cols:
        return False, f"columns {cols} vs {sorted(theirs_cols)}"
    order = [theirs_cols.index(c) for c in cols]
    theirs = sorted(tuple(str(cell(r[i])) for i in order) for r in raw)
    spark_types = dict(df.dtypes)
    odd = [(c, spark_types[c], theirs_types[c]) for c in cols if spark_types[c] != theirs_types[c].lower()
           and (spark_types[c], theirs_types[c]) not in {("string", "VARCHAR"), ("int", "INTEGER"), ("bigint", "BIGINT"), ("double", "DOUBLE"), ("boolean", "BOOLEAN")}]
    note = f"rows={len(mine)}/{len(theirs)} {took:.1f}s sql {time.time() - start:.1f}s" + (f" TYPES {odd}" if odd else "")
    if mine != theirs:
        a, b = set(mine), set(theirs)
        left, right = [r for r in mine if r not in b][:3], [r for r in theirs if r not in a][:3]
        return False, f"{note}\n   cols {cols}\n   spark {left}\n   sql   {right}"
    return not odd, note


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf = argv.pop(0)
    catalog.load()
    spark = local_checkpoints(get_spark(master="local[8]"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in catalog.QUERIES:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            ok, note = compare(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001 - every query is reported
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
