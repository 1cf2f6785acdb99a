"""Run the registered queries next to their SQL and report differences.

usage: python tests/compare.py <sf_dir> [name prefix ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None:
            return "~"
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat()
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """None when equal, else a short account."""
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want = normal(result.fetchall(), want_names)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if sorted(want_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return f"rows {len(got)}/{len(want)}; only spark {extra}; only sql {missing}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from relaylens.session import build_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                found = difference(df, con, sqls[name])
            else:
                found = None if df.count() else "no rows"
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:700]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s "
              f"{found or ''}"[:1500], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
