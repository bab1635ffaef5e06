"""Run registered queries next to their SQL in DuckDB and compare the rows.

python -m tests.oracle [sf] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame, digits: int) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return "[" + ",".join(str(cell(x)) for x in v) + "]"
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "∅"
        if type(v).__name__ == "NAType":
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if type(v).__name__.startswith("int") or type(v).__name__.startswith("uint"):
            return str(int(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            v = float(v)
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, digits))
        if type(v).__name__ == "Decimal":
            return cell(float(v))
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame, digits: int = 9) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} != {len(duck_df)}"
    a, b = canon(spark_df, digits), canon(duck_df, digits)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cols = sorted(spark_df.columns)
        diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        return f"{len(bad)} of {len(a)} rows differ, first: {diff[:4]}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from habitus.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    sqls, failed = entry.oracle_sql(), []
    names = [n for n in entry.queries() if not wanted or any(n.startswith(w) for w in wanted)]
    for name in names:
        t0 = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sqls:
                want = con.execute(sqls[name]).df()
                problem = compare(got, want)
                state = "ok" if problem is None else f"MISMATCH {problem}"
                if problem is None and len(got) == 0:
                    state = "ok (EMPTY)"
            else:
                problem, state = None, f"rows-only {len(got)}"
            print(f"{name:38s} {t1 - t0:6.2f}s {time.time() - t1:6.2f}s {len(got):7d} {state}"[:600], flush=True)
        except Exception as e:  # report and go on to the next query
            problem = str(e)
            print(f"{name:38s} ERROR {problem[:700]}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} good; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
