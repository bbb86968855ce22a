"""Compares queries with their SQL over one data directory. Usage: python tests/oracle.py DIR [NAME...]"""

import hashlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def views(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return c


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, c, name, query, sql, sf_dir):
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = c.execute(sql)
    cols = [d[0] for d in res.description]
    theirs = rows_of(cols, res.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if len(ours) != len(theirs):
        extra = [x for x in ours if x not in set(theirs)][:2], [x for x in theirs if x not in set(ours)][:2]
        return f"{len(ours)} and {len(theirs)} rows; only in one: {extra}"
    if hashlib.md5(repr(ours).encode()).digest() != hashlib.md5(repr(theirs).encode()).digest():
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{len(bad)} rows differ: {bad[:2]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from quirelake.session import local_session

    spark, c = local_session(), views(sys.argv[1])
    names = sys.argv[2:] or list(e.oracle_sql())
    for name in names:
        t = time.time()
        try:
            why = compare(spark, c, name, e.queries()[name], e.oracle_sql()[name], sys.argv[1])
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{'ok  ' if not why else 'BAD '} {name} {time.time() - t:.1f}s {why[:900]}", flush=True)
