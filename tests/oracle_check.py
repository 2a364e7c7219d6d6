"""Run registered queries beside their SQL and report every difference."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value)
    return "NULL" if value is None else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, build, sql):
    """Empty text where both agree, else what differs; with row count and times."""
    start = time.time()
    frame = build(spark, sf_dir)
    ours = canonical(frame.columns, [tuple(row) for row in frame.collect()])
    spent = time.time() - start
    if sql is None:
        return "no SQL", len(ours[1]), spent, 0.0
    start = time.time()
    cursor = con.execute(sql)
    theirs = canonical([c[0] for c in cursor.description], cursor.fetchall())
    lapsed = time.time() - start
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}", len(ours[1]), spent, lapsed
    if ours[1] != theirs[1]:
        one, two = set(ours[1]), set(theirs[1])
        only, other = sorted(one - two)[:2], sorted(two - one)[:2]
        return (
            f"{len(ours[1])} != {len(theirs[1])} rows or values; {len(one - two)}/{len(two - one)}"
            f" distinct rows differ: {ours[0]}\n  ours {only}\n  SQL  {other}", len(ours[1]), spent, lapsed,
        )
    return "", len(ours[1]), spent, lapsed


if __name__ == "__main__":
    import __spark_entry__ as entry
    from basketlens.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, builds = duck(sf_dir), entry.oracle_sql(), entry.queries()
    bad = 0
    for name in names or builds:
        try:
            fault, rows, spent, lapsed = compare(spark, con, sf_dir, name, builds[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001
            fault, rows, spent, lapsed = f"ERROR {str(error)[:900]}", -1, 0, 0
        bad += bool(fault)
        print(f"@@ {'ok ' if not fault else 'BAD'} {name} rows={rows} spark={spent:.2f} sql={lapsed:.2f} {fault}", flush=True)
    print(f"@@ {bad} of {len(names or builds)} differ; unregistered SQL {sorted(set(sqls) - set(builds))}")
