"""A query against its DuckDB SQL over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def assert_matches(spark, name: str, sf_dir: str) -> None:
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = e.queries()[name](spark, sf_dir)
    con.execute(e.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    assert sorted(got.columns) == sorted(columns)
    want = [dict(zip(columns, row, strict=True)) for row in con.fetchall()]
    order = sorted(columns)
    left = sorted(repr([_plain(r[c]) for c in order]) for r in got.collect())
    right = sorted(repr([_plain(r[c]) for c in order]) for r in want)
    assert left == right
