"""Runs registered queries beside their check SQL and compares rows, names and values.

python tests/compare.py [folder] [name ...]   (names may be prefixes)
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def database(folder: str):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        if math.isnan(f):
            return "nan"
        return 0.0 if f == 0 else float(f"{f:.9g}")
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def differences(spark_df, db, sql: str) -> list[str]:
    got_cols = spark_df.columns
    got = spark_df.collect()
    cur = db.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    out = []
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} against {sorted(want_cols)}"]
    if len(got) != len(want):
        out.append(f"{len(got)} rows against {len(want)}")
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} of {len(a)} rows differ, first: {sorted(got_cols)}\n   got  {bad[0][0]}\n   want {bad[0][1]}")
    if not got:
        out.append("(no rows)")
    types = {
        c: (t, str(d[1]))
        for (c, t), d in zip(spark_df.dtypes, sorted(cur.description, key=lambda d: got_cols.index(d[0])))
    }
    kinds = {"bigint": "NUMBER BIGINT INTEGER HUGEINT", "int": "NUMBER INTEGER", "double": "NUMBER DOUBLE", "string": "STRING VARCHAR"}
    for c, (t, d) in types.items():
        if t == "double" and d in ("HUGEINT", "BIGINT", "INTEGER") or d.startswith("DECIMAL") or d == "HUGEINT":
            out.append(f"type of {c}: {t} against {d}")
        elif t in ("bigint", "int") and d not in ("BIGINT", "INTEGER"):
            out.append(f"type of {c}: {t} against {d}")
    return out


def main(argv):
    from probity.plans.catalog import load
    from probity.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:]
    catalog = load()
    spark = local_session()
    db = database(folder)
    failed = 0
    for name, fn in catalog.queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in catalog.sql:
                diff = differences(df, db, catalog.sql[name])
            else:
                n = len(df.collect())
                diff = [] if n else ["(no rows)"]
        except Exception as e:  # noqa: BLE001
            diff = [f"{type(e).__name__}: {str(e)[:700]}"]
        took = time.time() - t
        failed += bool(diff)
        print(f"{'ok  ' if not diff else 'FAIL'} {name} {took:.1f}s" + "".join(f"\n   {d}" for d in diff), flush=True)
    print("failed", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
