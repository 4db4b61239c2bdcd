"""Compare a query with its oracle over the tables of a folder."""

import datetime
import math

import duckdb
import numpy as np

from docmill.plans.views import TABLES


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x), 9) + 0.0
    if isinstance(x, (int, np.integer)):
        return int(x)
    return str(x)[:19] if isinstance(x, datetime.date) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([plain(r[i]) for i in order]) for r in data)


def compare(frame, connection, sql):
    found = connection.sql(sql)
    assert rows(frame.columns, frame.collect()) == rows(found.columns, found.fetchall())
