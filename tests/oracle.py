"""Compares queries with their SQL: python tests/oracle.py [sf] [name...]."""

import sys
from pathlib import Path

import duckdb

TOP = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata")


def nullable(x):
    """Columns of numbers with nulls: pandas has several types for them."""
    return {c for c in x.columns if x[c].isna().any() and (x[c].dtype == "Int64" or x[c].dtype == "float64" and (x[c].dropna() % 1 == 0).all())}


def frames(spark, query, sql, sf):
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(sql).df()
    got = query(spark, str(DATA / sf)).toPandas()
    assert sorted(got.columns) == sorted(want.columns), (list(got.columns), list(want.columns))
    cols = sorted(got.columns)
    got, want = (x.assign(**{c: x[c].astype("Float64") for c in nullable(got) | nullable(want)}) for x in (got, want))
    return [[tuple(r) for r in x[cols].astype(str).sort_values(cols).itertuples(index=False)] for x in (got, want)]


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(TOP))
    import __spark_entry__ as entry
    from copyloom.session import session

    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and (name[:2] == "op" or name == "pipeline"):
            continue
        t = time.time()
        try:
            if name in sql:
                got, want = frames(spark, query, sql[name], sys.argv[1])
                print(name, "equal" if got == want else f"DIFFER {got[:2]} {want[:2]}", len(got), len(want), round(time.time() - t, 1), flush=True)
            else:
                print(name, query(spark, str(DATA / sys.argv[1])).count(), "rows", round(time.time() - t, 1), flush=True)
        except Exception as e:
            print(name, "FAILED", str(e)[:600], flush=True)
