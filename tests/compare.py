"""Runs registered queries beside their SQL: python tests/compare.py SF NAME..."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def against_sql(spark, con, name: str, query, sql: str, sf_dir: str) -> tuple[list[tuple], list[tuple], list[str], list[str]]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    return got, rows_of(names, cur.fetchall()), sorted(df.columns), sorted(names)


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as e

    from strata.session import local_session

    sf_dir = sf if "/" in sf else f"/root/testdata/{sf}"
    spark, con, bad = local_session(), connection(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = e.queries(), e.oracle_sql()
    for name in names or list(queries):
        t = time.time()
        try:
            if name in sqls:
                got, want, a, b = against_sql(spark, con, name, queries[name], sqls[name], sf_dir)
                ok = got == want and a == b
                print(f"{'ok ' if ok else 'BAD'} {name} {len(got)} rows, SQL {len(want)}, {time.time() - t:.1f} s", flush=True)
                if not ok:
                    bad += 1
                    print("   columns", a, b)
                    print("   only here", [x for x in got if x not in set(want)][:3], "\n   only SQL", [x for x in want if x not in set(got)][:3])
            else:
                print(f"run {name} {len(queries[name](spark, sf_dir).collect())} rows, {time.time() - t:.1f} s", flush=True)
        except Exception as x:
            bad += 1
            print(f"ERR {name}: {str(x)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
