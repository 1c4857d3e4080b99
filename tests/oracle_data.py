"""The tables of one data directory in both engines, and a comparison of their rows."""

import glob
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("NEWSMILL_TESTDATA", "/root/testdata/sf0.001")


def connect(folder=DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:26].replace("+00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(columns)
    at = [list(columns).index(n) for n in order]
    return order, Counter(repr(tuple(norm(r[i]) for i in at)) for r in data)
