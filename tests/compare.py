"""Runs queries next to their SQL twins and compares names, types and values."""

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def compare(spark, con, folder, name, fn, sql):
    """Empty text when equal, else what differs."""
    df = fn(spark, folder)
    names = sorted(df.columns)
    ours = [tuple(_plain(v) for v in row) for row in df.select(*names).collect()]
    theirs_raw = con.execute(sql)
    described = {d[0]: str(d[1]) for d in theirs_raw.description}
    if sorted(described) != names:
        return f"columns {names} against {sorted(described)}"
    order = [list(described).index(n) for n in names]
    theirs = [tuple(_plain(row[i]) for i in order) for row in theirs_raw.fetchall()]
    kinds = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    wrong = {n: (kinds[n], described[n]) for n in names if kinds[n] != described[n]}
    loose = lambda rows: sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))
    a, b = loose(ours), loose(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; types {wrong}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {names}, e.g. {bad[:2]}; types {wrong}"
    return f"types {wrong}" if wrong else ""


def main(folder, only=()):
    sys.path.insert(0, ".")
    import checks
    from terracell.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, fn in checks.QUERIES.items():
        if only and not any(name == o or name.startswith(o + "_") for o in only):
            continue
        start = time.time()
        try:
            if name in checks.SQL:
                message = compare(spark, con, folder, name, fn, checks.SQL[name])
                count = ""
            else:
                count, message = f"{fn(spark, folder).count()} rows, no SQL", ""
        except Exception as error:
            message, count = f"{type(error).__name__}: {str(error)[:600]}", ""
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name} {time.time() - start:.1f}s {count} {message}", flush=True)
    print(f"{failed} failed of {len(checks.QUERIES)}")


if __name__ == "__main__":
    main(sys.argv[1], [a for a in sys.argv[2:] if not a.startswith("-")])
