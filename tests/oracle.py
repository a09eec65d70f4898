"""Runs a query and its SQL on the same tables and compares rows without order."""

import math
from pathlib import Path


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5)
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, query, sql):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = query(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    ours, theirs = canonical([tuple(r) for r in found.collect()], found.columns), canonical(result.fetchall(), names)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not bad, bad[:3]
